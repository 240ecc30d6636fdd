"""A training-corpus pipeline over `documents`: each stage's result is written and read as the next one's input.

Every stage takes rows (doc_id, text, lang, source, n_chars) and whatever other columns there are,
under any name; these pass through all but the last stage as they are. No rows give no rows.
The stages make the session's batches to Python small (common.small_batches), as these hold whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.llm import line_dedup, mixing, packing, simhash_dedup, toxicity
from florilege.llm.common import ship, small_batches, stored, table
from florilege.llm.queries import vocabulary

#: SQL cannot express the fitted toxicity model or the packing order; tests hold the stages against plain versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labels, does not reject.

    Null and empty texts score like any text without hits and stay; long texts are scored whole;
    repeated rows, and rows without a doc_id, are judged each by their own text.
    """
    small_batches(spark)
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line repeats; n_chars follows the text.

    Null texts stay null and have a null n_chars; empty texts stay; a document whose lines all go stays
    with an empty text. Rows that share a doc_id, or have none, lose only lines of their own text; of
    these neither is earlier at the same line number. Very long lines and texts are taken whole.
    """
    small_batches(spark)
    out = line_dedup.drop_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the least doc_id, a null one coming last.

    Of rows that share that doc_id, the one with the least hash over its columns stays; of rows equal
    in all columns, one. Null and empty texts are near copies of each other.
    """
    small_batches(spark)
    return simhash_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents, as many of each source's words as its target asks for.

    Null, empty and blank texts have no words and are taken 0 times; a null source is a source, the
    last; texts of any length are taken whole or not; repeated rows are documents of their own.
    """
    return mixing.mixed_copies(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids as little-endian unsigned 32-bit numbers.

    Null and empty texts give the one id that ends a document; long texts span sequences; repeated
    rows, and rows without a doc_id, are packed each; columns other than doc_id and text end here.
    """
    small_batches(spark)
    return packing.pack(docs, vocabulary(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("curve_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
