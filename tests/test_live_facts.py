"""Facts of documents that still hold: found where texts lie."""

from florilege.operators import clusters as CL
from florilege.operators import conflicts as C


def test_texts_are_not_moved_to_drop_replaced_documents(spark, data):
    rows = [("a.md", "a", [], "PORT=1\n"), ("same.md", "b", [], "PORT=2\n"), ("same.md", "c", ["b"], "PORT=3\n"), ("none.md", None, [], "PORT=4\n"), ("old/d.md", "d", ["a"], "PORT=5\n"), ("e.md", "e", [], "PORT=6\n")]
    docs = spark.createDataFrame(rows, "path string, id string, supersedes array<string>, body string")
    found = {r.key: (list(r["values"]), r.paths) for r in C.contradictions(docs).collect()}
    assert found == {"env:PORT": (["3", "4", "6"], ["e.md", "none.md", "same.md"])}  # one that is historical replaces still
    assert sorted((r.value, r.path) for r in CL.value_members(docs).collect()) == [("3", "same.md"), ("4", "none.md"), ("6", "e.md")]
    texts = spark.read.parquet(f"{data}/documents.parquet").selectExpr("concat('docs/', doc_id) AS path", "cast(doc_id AS string) AS id", "array(cast(doc_id + 1 AS string)) AS supersedes", "text AS body")
    plan = C.contradictions(texts)._jdf.queryExecution().executedPlan().toString()
    at = [line.index("Generate posexplode(split") for line in plan.splitlines() if "Generate posexplode(split" in line]
    deeper = [line for line in plan.split("Generate posexplode(split", 1)[1].splitlines()[1:] if "Exchange" in line and line.index("Exchange") > at[0]]
    assert not deeper, deeper  # nothing is shuffled below the splitting of texts
