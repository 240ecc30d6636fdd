"""A handoff's covers are made once, however many of its tiers look at them."""

from pyspark.sql import functions as F

from florilege.operators import reports as RP


def test_covers_are_written(spark, monkeypatch):
    plans, own = [], RP.stored
    monkeypatch.setattr(RP, "stored", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or own(df))
    covers = spark.createDataFrame([("a.md", ["x"])], "path string, files array<string>").withColumn("path", F.pandas_udf(lambda p: p, "string")("path"))
    reports = spark.createDataFrame([("a.md", 5, False), ("b.md", 6, True), ("c.md", 7, False)], "path string, score int, pin boolean")
    scored = spark.createDataFrame([("c.md", 0.5)], "path string, relevance double")
    found = RP.handoff_tiers(covers, reports, scored).orderBy("place").collect()
    assert [(r.path, r.tier) for r in found] == [("a.md", 0), ("b.md", 1), ("c.md", 2)]
    assert sum("EvalPython" in p for p in plans) == 1 and "EvalPython" not in plans[-1]
