"""Token estimates without lists of runs."""

import math
import random
import re

from pyspark.sql import functions as F

from florilege.functions import text as T


def test_pieces_of_runs(spark):
    r = random.Random(8)
    texts = ["".join(r.choice(["a", "Zé9", "word" * 4, " ", "\n", "\t", "--", "!?…", "世", "가나", "🙂", "٣", " "]) for _ in range(r.randint(0, 60))) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", *[T._tenths(F.col("t"), n).alias(f"n{n}") for n in (4, 6)], T.token_estimate(F.col("t")).alias("e"))
    assert "aggregate(" not in spark.range(1).select(F.lit("a").alias("t")).select(T._tenths(F.col("t"), 6))._jdf.queryExecution().analyzed().toString()
    for x in rows.collect():
        t = texts[x.i]
        runs = lambda p, n: sum(math.ceil(len(w) / n) for w in re.findall(p, t))
        signs = runs(rf"[^{T.WORD_CHARS}{T.CJK} \t\n\r]+", 2)
        want = {n: 10 * (runs(f"[{T.WORD_CHARS}]+", n) + signs) + 12 * len(re.findall(f"[{T.CJK}]", t)) for n in (4, 6)}
        assert (x.n4, x.n6) == (want[4], want[6])
        assert x.e == (0 if not t.strip() else max(1, (want[6] + 5 * t.count("\n") + 5) // 10))
