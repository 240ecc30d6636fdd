"""What the operators of this subpackage share: checkpoints, text buffers, small hash helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
SLICE_BYTES = 4 << 20
HOT_SHARE = 1000  # values with more than this part of all rows are split; at most so many exist
HOT_ROWS = 20_000  # smaller groups stay whole
TABLE_BITS = 1 << 28  # 32 MB, whatever the number of keys
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder named by spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error on a cluster."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="florilege-ckpt-")
    sc.setCheckpointDir(named)


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialises df in the shared checkpoint folder and cuts its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Lets Python workers of this machine import the package; on a cluster, send it with --py-files."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def small_batches(spark: SparkSession) -> None:
    """From now on batches of rows on their way to Python end at SLICE_BYTES, unless the session names another size.

    Spark's own limits, 10,000 rows or 64 MB, are held at once by the executor and by the worker.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(SLICE_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets into them; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.fill_null("") if col.null_count else col
    col = col.cast(pa.large_string())
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, dtype=np.int64, count=len(col) + 1 + col.offset)[col.offset :] if len(col) else np.zeros(1, np.int64)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]]
    return raw, offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows whose text holds about limit bytes, a longer single row alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = buffers(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def spread_join(rows: DataFrame, side: DataFrame, keys: list[str], size: str, salt_by: list[str], how: str = "inner") -> DataFrame:
    """rows joined to side, which has one row for each value of keys; no value's rows land in one task alone.

    side's column `size` tells how many rows a value has. Values with more than a HOT_SHARE-th of all
    rows are HOT_SHARE at most, so they go out as a broadcast; their rows are dealt over salts by a
    hash of salt_by, and side's row is repeated for each salt. side is read several times: pass a
    written table.
    """
    total = side.agg(F.sum(size)).first()[0] or 0
    most = max(HOT_ROWS, total // HOT_SHARE)
    hot = side.where(F.col(size) > most).select(*keys, F.ceil(F.col(size) / F.lit(most)).cast("int").alias("_salts"))
    if not hot.limit(1).count():
        return rows.join(side, keys, how)
    hot = F.broadcast(hot)
    salts = F.coalesce("_salts", F.lit(1))
    dealt = rows.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*salt_by), salts).cast("int")).drop("_salts")
    wide = side.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(wide, [*keys, "_salt"], how).drop("_salt")


def bit_table(keys: DataFrame) -> Broadcast:
    """Bit table of all rows of keys, sent to all tasks: 16 bits a row, TABLE_BITS at most. keys is read twice: pass a written table."""
    bits = min(TABLE_BITS, max(64, 1 << (16 * keys.count()).bit_length()))
    at = keys.select(F.xxhash64(*keys.columns).bitwiseAND(F.lit(bits - 1)).alias("at"))
    words = at.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()  # TABLE_BITS / 64 rows at most
    table = np.zeros(bits // 64, np.uint64)
    table[found["word"].to_numpy()] = found["bit"].to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(table)


def may_hold(table: Broadcast, *cols: str) -> Column:
    """May the bit table hold the row's cols? True for all that it holds and a few others, so that an exact join must follow."""

    def look(hashes: pa.Array) -> pa.Array:
        at = hashes.to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(64 * len(table.value) - 1)
        return pa.array(table.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) == 1)

    return F.arrow_udf(look, "boolean")(F.xxhash64(*cols))


def stored(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared checkpoint folder and reads it back; smaller than checkpoint().

    Files lie under <checkpoint folder>/florilege-<application id>/ and may go when the application has ended. What was
    shuffled for them goes at once, as nothing reads it again; it would else stay until the driver collects garbage.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    at = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/florilege-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_SHUFFLES)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(at)
