"""Running sums over ranges, and paths as expressions, against plain versions."""

import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from florilege.functions import globs as G
from florilege.operators.ranking import running_total


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_running_total_of_groups_that_span_ranges(spark, keys):
    r = random.Random(4)
    # one group of two thirds of the rows, small ones beside it
    rows = [(r.choice("aaaab") if i % 5 else f"x{i % 7}", r.randint(0, 9), i, r.randint(0, 5)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, a int, i int, v int").repartition(5)
    found = running_total(df, [F.desc("a"), F.col("i")], F.col("v"), "total", keys)
    assert found.columns == ["k", "a", "i", "v", "total"] or set(found.columns) == {"k", "a", "i", "v", "total"}
    want = {}
    for k in sorted({x[0] for x in rows}) if keys else [None]:
        own = sorted((x for x in rows if k in (None, x[0])), key=lambda x: (-x[1], x[2]))
        want |= dict(zip((x[2] for x in own), accumulate(x[3] for x in own), strict=True))
    assert {x.i: x.total for x in found.collect()} == want
    # rows of one group lie in several partitions
    assert df.repartitionByRange(4, *keys, F.desc("a"), F.col("i")).where("k = 'a'").select(F.spark_partition_id()).distinct().count() > 1
    assert running_total(df.limit(0), [F.col("i")], F.col("v"), "total", keys).count() == 0


def test_normalized_paths(spark):
    paths = ["", "/", "//", "./", "././a", "a/", "a//b/", "/a/b", "\\\\host\\x", ".\\a\\", "..//a", "./.a/", "a/./b", "///", "a\n/b/", "a\n"]
    found = spark.createDataFrame([(p,) for p in paths], "p string").select("p", G.normalized(F.col("p")).alias("n")).collect()
    assert {r.p: r.n for r in found} == {p: G.normalize_path(p) for p in paths}
