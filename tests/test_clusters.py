"""Classes and clusters of documents, the tiers of a handoff, and the guard of init."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from florilege import commands as CMD
from florilege.operators import clusters as CL
from florilege.operators import ranking as R
from florilege.operators import reports as RP


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


def test_components_of_chains_stars_and_random_links(spark):
    r = random.Random(4)
    links = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("s", f"s{i}") for i in range(40)] + [(f"r{r.randrange(80)}", f"r{r.randrange(80)}") for _ in range(50)] + [("loop", "loop")]
    root = {x: x for pair in links for x in pair if x != "loop"}
    for _ in root:
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    alone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert rows(CL.components(spark.createDataFrame(links, "a string, b string"))) == sorted((x, y) for x, y in root.items() if x not in alone)
    assert CL.components(spark.createDataFrame([], "a string, b string")).collect() == []


def test_a_cluster_of_copies_is_one_row_each(spark):
    """2,000 equal documents and two near ones: a row a member, no pairs."""
    text = " ".join(f"word{i}" for i in range(200))
    docs = [(f"d{i:04}.md", text) for i in range(2000)] + [("a.md", text + " more"), ("z.md", text + " end"), ("other.md", "nothing like it " * 20)]
    found = CL.near_duplicate_members(spark.createDataFrame(docs, "path string, body string"))
    assert rows(found) == sorted([(p, "a.md", "d0000.md") for p, t in docs if t == text] + [("a.md", "a.md", "a.md"), ("z.md", "a.md", "z.md")])


def test_classes_keep_a_count_and_a_few_members(spark):
    made = [("x", f"p{i:05}") for i in range(3000)] + [("x", None), ("y", "b"), ("y", "a"), ("one", "c")]
    df = spark.createDataFrame(made, "id string, path string")
    got = {r.id: (r.documents, r.paths) for r in CL.classes(df.where("path is not null"), "id", sample=3).collect()}
    assert got == {"x": (3000, ["p00000", "p00001", "p00002"]), "y": (2, ["a", "b"])}
    plan = CL.classes(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # the least paths are chosen in each partition first


def test_relevant_documents_are_chosen_among_those_not_named(spark):
    """The best answers cover changed files already: the five places go to the next ones; the note names neither itself nor anything twice."""
    reports = spark.createDataFrame([(f"d{i:02}", 50 + i, i in (3, 4)) for i in range(14)] + [("note", 90, True)], "path string, score int, pin boolean")
    covers = spark.createDataFrame([("d00", ["x", "y"]), ("d01", ["x"]), ("note", ["x"])], "path string, files array<string>")
    scored = spark.createDataFrame([(f"d{i:02}", 1.0 - i / 20 if i < 12 else 0.0) for i in range(14)] + [("note", 2.0)], "path string, relevance double")
    got = [(r.place, r.path, r.tier) for r in RP.handoff_tiers(covers, reports, scored, "note").orderBy("place").collect()]
    assert got == [(1, "d00", 0), (2, "d01", 0), (3, "d04", 1), (4, "d03", 1), (5, "d08", 2), (6, "d07", 2), (7, "d06", 2), (8, "d05", 2), (9, "d02", 2)]
    assert [r.tier for r in RP.handoff_tiers(covers, reports, None, "note").collect()].count(2) == 0


def test_init_refuses_a_wide_root_unless_forced(spark, tmp_path, monkeypatch):
    docs = spark.range(401).select(F.concat(F.lit("d"), "id").alias("path"))
    corpus = SimpleNamespace(root=str(tmp_path), docs=docs, is_repo=True)
    monkeypatch.setattr(CMD, "propose", lambda c: docs.limit(0))
    with pytest.raises(PermissionError):
        CMD.init(corpus, write=True)
    assert CMD.init(corpus) == [] and not list(tmp_path.iterdir())
    assert CMD.init(corpus, write=True, force=True) == [] and list(tmp_path.iterdir())
    monkeypatch.setattr(CMD.CF, "is_home", lambda root: True)
    corpus.docs = docs.limit(1)
    with pytest.raises(PermissionError):
        CMD.init(corpus, write=True)


def test_a_row_that_no_cut_fits_says_so(spark):
    made = [("a", "omitted", "fresh", 0.5, 900, 500), ("b", "omitted", "fresh", 0.5, 900, 100), ("c", "omitted", "fresh", 0.5, 900, 0), ("d", "cut", "fresh", 0.5, 900, 500)]
    df = spark.createDataFrame(made, "path string, place string, freshness string, rank double, cost int, left int")
    why = {r.path: r.why for r in df.withColumn("why", R.left_out(df, 8000)).collect()}
    assert why == {"a": "could not be cut to fit the 500 of 8000 tokens that were left", "b": "needs about 900 tokens, 100 of 8000 tokens were left", "c": "the budget was used up (8000 tokens); rank 0.500", "d": None}
