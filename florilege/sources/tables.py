"""Written intermediate tables, for what is read many times or would make a plan too deep."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
TABLE_BITS = 1 << 27  # 16 MB at most, whatever the number of keys


def folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error on a cluster."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="florilege-ckpt-")
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back; an executor that is lost later takes nothing with it.

    Files lie under <folder>/florilege-<application id>/ and may go when the application has ended. What was shuffled
    for them goes at once, as nothing reads it again; it would else stay until the driver collects garbage.
    """
    spark = df.sparkSession
    at = f"{folder(spark)}/florilege-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_SHUFFLES)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(at)


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
