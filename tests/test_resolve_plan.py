"""Mentions are resolved without sending files to all machines."""

from florilege.operators import inference as I


def test_no_files_are_broadcast(spark):
    docs = spark.createDataFrame([("d.md", "see `a/b.ts` and `x/c.js`"), ("e.md", "`c.ts`, `b.ts`")], "path string, body string")
    files = spark.createDataFrame([("src/a/b.ts",), ("x/c.ts",), ("y/c.ts",)], "path string")
    found = I.resolve(I.mentions(docs), files)
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
    assert {(r.path, r.mention, r.file) for r in found.collect()} == {("d.md", "a/b.ts", "src/a/b.ts"), ("d.md", "x/c.js", "x/c.ts"), ("e.md", "b.ts", "src/a/b.ts")}
