"""Line dedup shuffles the texts that lose lines or may hold near copies, and no others."""

import random

from pyspark.sql import functions as F

from florilege.llm import common, line_dedup
from florilege.llm.common import bit_table, may_hold, stored


def shuffled(spark) -> int:
    """Bytes shuffled so far, by the stages that Spark still knows."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_only_texts_with_repeats_are_shuffled(spark):
    r = random.Random(3)
    made = [(i, " ".join("%016x" % r.getrandbits(64) for _ in range(600))) for i in range(300)]  # 10 KB each that compress little
    shared = "this line stands in both of the two"
    made += [(900, f"first\n{shared}"), (901, f"{shared}\nsecond"), (902, f"{shared} documents"), (903, ""), (904, None)]
    docs = stored(spark.createDataFrame(made, "doc_id long, text string"))
    before = shuffled(spark)
    got = {x.doc_id: x.text for x in line_dedup.line_dedup(docs).collect()}
    assert got == dict(made) | {901: "second", 902: ""}
    assert shuffled(spark) - before < 0.2 * sum(len(t or "") for _, t in made)


def test_a_bit_table_holds_all_its_keys(spark, monkeypatch):
    keys, others = stored(spark.range(5000).select("id", F.col("id").cast("string").alias("s"))), spark.range(5000, 25_000).select("id", F.col("id").cast("string").alias("s"))
    for most, part in ((common.TABLE_BITS, 0.1), (1 << 10, 1.0)):  # a full table holds all others too, which moves them in vain
        monkeypatch.setattr(common, "TABLE_BITS", most)
        held = may_hold(bit_table(keys), "id", "s")
        assert keys.where(held).count() == 5000 and others.where(held).count() <= part * 20_000
    assert keys.where(may_hold(bit_table(keys.limit(0)), "id", "s")).count() == 0
