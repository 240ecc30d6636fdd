"""Reports read what was written of claims and history, and globs are compiled in many tasks."""

from florilege.operators import globjoin as GJ
from florilege.plans import queries as Q
from florilege.sources.fixtures import Fixtures


def test_search_reads_no_texts(spark, data):
    found = Q.search_topk(Fixtures(spark, data))
    assert not any("documents.parquet" in f for f in found.inputFiles())


def test_reports_join_written_tables(spark, data):
    plan = Q.check_gate(Fixtures(spark, data))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 4


def test_few_globs_are_many_tasks(spark):
    globs = spark.range(100).selectExpr("concat('a/', id) AS glob").coalesce(1)
    assert GJ.spread(globs.distinct(), "glob").rdd.getNumPartitions() == 4
