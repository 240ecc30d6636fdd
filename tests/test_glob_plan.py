"""Globs meet paths without either being sent to all machines."""

from florilege.operators import globjoin as GJ


def test_no_globs_or_paths_are_broadcast(spark):
    globs = spark.createDataFrame([("d", "a/b.ts"), ("d", "**/c.ts"), ("e", "gone/**"), ("e", "*.md"), ("f", "a/**")], "path string, glob string")
    files = spark.createDataFrame([("a/b.ts",), ("x/c.ts",)], "path string")
    found = GJ.missing(globs, files)
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
    assert {(r.path, r.glob) for r in found.collect()} == {("e", "gone/**"), ("e", "*.md")}
