"""A report's history is cut to what is asked of it and written once."""

from pyspark.sql import functions as F

from florilege.operators import freshness as FR


def test_history_is_read_once(spark, tmp_path):
    docs = spark.createDataFrame([("d.md", "d", None, None, []), ("e.md", "e", None, None, [])], "path string, id string, expires timestamp, ttl_days int, supersedes array<string>")
    globs = spark.createDataFrame([("d.md", 1, "a/**"), ("e.md", 1, "b")], "path string, ord int, glob string")
    files = spark.createDataFrame([("a/x.ts",), ("b/y.ts",)], "path string")
    commits = spark.createDataFrame([("1", 1), ("2", 2), ("3", 3)], "sha string, n int").select("sha", F.timestamp_seconds(F.col("n") * 86_400 * 20).alias("author_ts"), F.timestamp_seconds(F.col("n") * 86_400 * 20).alias("commit_ts"), F.lit("s").alias("subject"))
    spark.createDataFrame([("1", "d.md"), ("1", "e.md"), ("2", "a/x.ts"), ("3", "b/y.ts"), ("3", "other")], "sha string, path string").write.parquet(f"{tmp_path}/touched-by")
    found = FR.assess(docs, globs, files, commits, spark.read.parquet(f"{tmp_path}/touched-by"), F.timestamp_seconds(F.lit(86_400 * 100)))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("touched-by") == 0
    assert not any("touched-by" in f for f in found.inputFiles())
    assert {(r.path, r.commits_since, r.drift_days) for r in found.collect()} == {("d.md", 1, 20), ("e.md", 1, 40)}
