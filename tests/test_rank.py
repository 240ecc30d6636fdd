"""Ranks equal in decimals are equal as doubles."""

from decimal import Decimal

from pyspark.sql import functions as F

from florilege.operators import ranking as R


def test_ranks_of_all_scores(spark):
    found = spark.range(101).select(F.col("id").cast("int").alias("score"), F.lit("reference").alias("kind"), F.lit("fresh").alias("freshness")).select("score", R.rank(F.lit(0.5)).alias("rank")).collect()
    assert {r.score: r.rank for r in found} == {s: 0.5 * (0.6 + float(Decimal("0.4") * s) / 100) for s in range(101)}
