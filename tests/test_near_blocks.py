"""Near duplicates compared by blocks: all pairs are found, and sets do not move once for each pair."""

import random
import subprocess
import sys
from itertools import combinations
from pathlib import Path

import pytest

from florilege.operators import clusters as CL
from florilege.operators import conflicts as C

SCRIPT = """
import random, sys
from pathlib import Path
from pyspark.sql import SparkSession
at = Path(sys.argv[1])
spark = (SparkSession.builder.master("local[2]").config("spark.local.dir", str(at / "local")).config("spark.checkpoint.dir", str(at / "shared"))
    .config("spark.driver.host", "127.0.0.1").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate())
from florilege.operators.conflicts import near_duplicates
r = random.Random(5)
text = [f"w{r.randrange(5000)}" for _ in range(4000)]
docs = []
for i in range(100):
    words = list(text)
    for j in r.sample(range(4000), 20):
        words[j] = f"x{i}"
    docs.append((f"d{i:03}", " ".join(words)))
assert near_duplicates(spark.createDataFrame(docs, "path string, body string")).count() == 100 * 99 // 2
moved = sum(f.stat().st_size for f in (at / "local").rglob("shuffle_*"))
assert moved < 40e6, moved  # 100 sets are 3 MB, one of each pair's 158
"""


@pytest.mark.parametrize("block", [1, 700, 1 << 18])
def test_pairs_of_many_blocks_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    r = random.Random(block)
    texts = {}
    for kind in range(5):
        base = [f"w{r.randrange(300)}" for _ in range(60 << kind)]  # 60 to 960 words
        for i in range(9):
            words = list(base)
            for _ in range(r.randint(0, len(base) // 30)):
                words[r.randrange(len(words))] = f"w{r.randrange(300)}"
            texts[f"{kind}{i}"] = " ".join(words[: len(words) - r.randint(0, len(base) // 8)])
    texts |= {"one": "same " * 50, "two": "same " * 60, "short": "w1 w2"}  # a set of one shingle each, and none
    sets = {p: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for p, t in texts.items() if len(w := t.split()) >= 40}
    first = [p for p in sets if p == min(q for q in texts if texts[q] == texts[p])]
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(sorted(first), 2)}
    want = {k: round(j, 9) for k, j in want.items() if j > 0.8}
    found = C.near_duplicates(spark.createDataFrame(list(texts.items()), "path string, body string")).collect()
    assert len(want) > 20 and ("one", "two") in want
    assert len(found) == len(want) and {(x.a, x.b): round(x.jaccard, 9) for x in found} == want


def test_no_pairs(spark):
    docs = spark.createDataFrame([("a", "one two " * 30), ("b", "three four " * 30)], "path string, body string")
    assert C.near_duplicates(docs).collect() == [] and C.near_duplicates(docs.limit(0)).collect() == []


def test_sets_move_once_for_blocks_of_pairs(tmp_path):
    root = Path(__file__).resolve().parents[1]
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], cwd=root, capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-2000:]


def test_links_are_found_once(spark):
    found = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            found.add(len(batch))
            yield batch

    links = spark.range(100).selectExpr("id AS a", "id + 100 AS b").mapInPandas(count, "a long, b long")
    assert {(r.node, r.root) for r in CL.components(links).collect()} == {(x, x % 100) for x in range(200)}
    assert found.value == 100


def test_small_sets_do_not_fill_a_block_without_end(spark):
    pairs = spark.range(1, 3000).selectExpr("0L AS a", "id AS b", "40 AS na", "40 AS nb")
    sizes = [r["count"] for r in C._blocks(pairs).groupBy("block").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) <= C.MOST_SETS
