"""A mix runs few plans, as each stays in the driver's memory for a while."""

import random

from florilege.llm import mixing


def test_a_mix_runs_few_jobs(spark):
    r = random.Random(8)
    made = [(i, "w " * r.choice((1, 5, 60, 700)), "abc"[i % 3]) for i in range(600)]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string")
    sc = spark.sparkContext
    sc.setJobGroup("mix", "mix")
    try:
        found = mixing.mix(docs).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(sc.statusTracker().getJobIdsForGroup("mix"))
    print("jobs", jobs)
    assert len(found) == 600 and jobs <= 120
