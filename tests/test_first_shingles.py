"""Near duplicates by first shingles, against all pairs."""

import random
from itertools import combinations

from florilege.operators import conflicts as C


def test_similar_sets_share_a_first_shingle(spark, monkeypatch):
    monkeypatch.setattr(C, "BUCKETS", 16)  # most shingles share a bucket
    r = random.Random(11)
    base = [[r.getrandbits(63) - (1 << 62) for _ in range(60)] for _ in range(4)]
    rows = []
    for i in range(80):
        own = set(r.choice(base)) - set(r.sample(base[i % 4], r.randint(0, 14)))
        rows.append((i, sorted(own | set(r.sample(range(1000), r.randint(0, 5))))))
    sets = spark.createDataFrame(rows, "k int, hs array<bigint>")
    first = {x.k: set(x.first) for x in sets.select("k", C._first_shingles(sets, 0.8).alias("first")).collect()}
    near = [(a, b) for (a, x), (b, y) in combinations(rows, 2) if len({*x} & {*y}) > 0.8 * len({*x} | {*y})]
    assert len(near) > 50 and all(first[a] & first[b] for a, b in near)
    assert all(len(first[k]) <= len(hs) * 0.2 + 1 for k, hs in rows)


def test_pairs_are_those_of_all_pairs(spark):
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    common = [r.choice(vocabulary) for _ in range(30)]  # a passage of every document
    kinds = [[r.choice(vocabulary) for _ in range(200)] for _ in range(6)]
    texts = {}
    for i in range(60):
        words = list(kinds[i % 6])
        for _ in range(r.randint(0, 9)):
            words[r.randrange(200)] = r.choice(vocabulary)
        texts[f"d{i:02}"] = " ".join(common + words)
    texts = {p: t for p, t in texts.items() if p == min(q for q in texts if texts[q] == t)}  # equal ones count once
    sets = {p: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for p, t in texts.items() for w in [t.split()]}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(sorted(sets), 2)}
    found = C.near_duplicates(spark.createDataFrame(list(texts.items()), "path string, body string"))
    assert {(x.a, x.b): round(x.jaccard, 9) for x in found.collect()} == {k: round(j, 9) for k, j in want.items() if j > 0.8}
