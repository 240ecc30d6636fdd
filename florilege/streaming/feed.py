"""An extension: commits as a stream, folded into each subject's latest time and count.

Late commits count until the watermark; windows close behind it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "2 days"


def commit_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Parquet files of commits as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def activity(commits: DataFrame, window: str = "7 days", late: str = LATE) -> DataFrame:
    """(subject, from, commits, last) of commits(commit_ts, subject, sha) in tumbling windows."""
    kept = commits.withWatermark("commit_ts", late).dropDuplicatesWithinWatermark(["sha"])
    counted = kept.groupBy("subject", F.window("commit_ts", window)).agg(F.count(F.lit(1)).alias("commits"), F.max("commit_ts").alias("last"))
    return counted.select("subject", F.col("window.start").alias("from"), "commits", "last")
