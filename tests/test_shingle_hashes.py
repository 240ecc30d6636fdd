"""Hashed shingles and sketches against plain versions."""

import random

from pyspark.sql import functions as F

from florilege.functions import text as T
from florilege.operators import conflicts as C


def fnv1a(text):
    h = 2166136261
    for c in text.encode():
        h = (h ^ c) * 16777619 % 2**32
    return h


def test_hashes_of_whole_batches(spark, monkeypatch):
    r = random.Random(3)
    words = [[r.choice(["a", "bc", "word", "x" * r.randint(1, 30), "ü9", "7"]) for _ in range(r.choice([0, 1, 38, 39, 40, 41, 90, 700]))] for _ in range(60)]
    texts = [None, "", "``` code", " ".join(["w"] * 500)] + [r.choice([" ", "\n", "--", "  "]).join(w) for w in words] + [None]
    monkeypatch.setattr(T, "HASHED_AT_ONCE", 900)  # several passes a batch
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    slow = F.array_sort(F.array_distinct(F.transform(T.shingles(F.col("t")), T.fnv1a)))
    found = df.select("i", slow.alias("slow"), T.fnv1a_shingles(F.col("t")).alias("h"), C.minhash_sketch(F.col("t")).alias("sketch")).collect()
    assert sum(x.h is not None for x in found) > 20 and any(x.h is None for x in found)
    for x in found:
        assert x.h == x.slow and x.sketch == (x.h and x.h[:64])
    assert found[3].h == [fnv1a("w w w w w")]


def test_similarity_of_sketches(spark):
    r = random.Random(5)
    rows = [(sorted(r.sample(range(60), r.randint(0, 30))), sorted(r.sample(range(60), r.randint(0, 30)))) for _ in range(50)]
    found = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>").select("a", "b", C.sketch_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    for x in found:
        k = min(len(x.a), len(x.b))
        least = sorted({*x.a, *x.b})[:k]
        assert x.s == (sum(h in x.a and h in x.b for h in least) / k if k else 0.0)
