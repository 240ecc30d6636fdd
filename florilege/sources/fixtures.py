"""A corpus with history, read out of the star-schema tables: orders as commits, parts as source files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NOW = "2001-12-31 00:00:00"

#: Portable SQL; each view may use the ones before it.
VIEWS = {
    "f_files": """
SELECT p_partkey AS k, lower(p_type) AS typ,
       'src/' || lower(p_type) || '/' || replace(lower(p_brand), '#', '') || '/' || CAST(p_partkey AS STRING) || '.ts' AS path FROM part""",
    "f_docs": """
SELECT doc_id, 'docs/' || source || '/' || CAST(doc_id AS STRING) || '.md' AS path,
       CASE WHEN doc_id % 40 = 1 THEN 'doc-' || CAST(doc_id - 1 AS STRING) ELSE 'doc-' || CAST(doc_id AS STRING) END AS id,
       CASE doc_id % 8 WHEN 0 THEN 'guide' WHEN 1 THEN 'decision' WHEN 2 THEN 'runbook' WHEN 3 THEN 'reference'
            WHEN 4 THEN 'handoff' WHEN 5 THEN 'index' WHEN 6 THEN 'spec' ELSE NULL END AS kind,
       doc_id % 97 = 0 AS pin,
       CASE WHEN doc_id % 13 = 0 THEN TIMESTAMP '2001-06-01 00:00:00' END AS expires,
       CASE WHEN doc_id % 11 = 0 THEN 365 END AS ttl_days,
       CASE WHEN doc_id % 17 = 0 THEN 'doc-' || CAST(doc_id + 1 AS STRING) END AS supersedes,
       doc_id % 5 AS cls, doc_id % (SELECT count(*) FROM part) AS k, text AS body FROM documents""",
    "f_commits": """
SELECT CAST(o_orderkey AS STRING) AS sha, o_orderdate AS author_ts, o_orderdate AS commit_ts,
       o_orderpriority AS subject, 'cust-' || CAST(o_custkey AS STRING) AS author FROM orders""",
    "f_commit_files": """
SELECT DISTINCT CAST(l.l_orderkey AS STRING) AS sha, f.path AS path FROM lineitem l JOIN f_files f ON f.k = l.l_partkey
UNION ALL
SELECT CAST(o.o_orderkey AS STRING) AS sha, d.path AS path FROM orders o JOIN f_docs d ON d.doc_id = o.o_custkey""",
    "f_doc_globs": """
SELECT d.doc_id, 1 AS ord, f.path AS glob, '^' || replace(f.path, '.', '[.]') || '$' AS rx FROM f_docs d JOIN f_files f ON f.k = d.k WHERE d.cls IN (0, 2)
UNION ALL
SELECT doc_id, 1, 'src/**/' || CAST(k AS STRING) || '.ts', '^src/([^/]+/)*' || CAST(k AS STRING) || '[.]ts$' FROM f_docs WHERE cls = 1
UNION ALL
SELECT doc_id, 2, 'lib/gone/**', '^lib/gone(/.*)?$' FROM f_docs WHERE cls = 2
UNION ALL
SELECT doc_id, 1, 'workers/q' || CAST(doc_id AS STRING) || '/**', '^workers/q' || CAST(doc_id AS STRING) || '(/.*)?$' FROM f_docs WHERE cls = 4""",
    "f_old_files": "SELECT k, typ, 'old/' || typ || '/' || CAST(k AS STRING) || '.ts' AS old_path FROM f_files",
    "f_renames": """
SELECT old_path, CASE WHEN typ = 'small' AND k % 2 = 0 THEN 'moved/a/' WHEN typ = 'small' THEN 'moved/b/' ELSE 'moved/' || typ || '/' END
       || CAST(k AS STRING) || '.ts' AS new_path, 60 + k % 40 AS similarity
FROM f_old_files WHERE (typ = 'economy' AND k % 3 = 1) OR (typ <> 'economy' AND k % 3 <> 0)""",
    "f_md": """
SELECT d.doc_id, d.path,
  CASE WHEN d.doc_id % 4 = 3 THEN '' ELSE
    '---' || chr(10) || 'spec: 1' || chr(10) || 'id: ' || d.id || chr(10) || COALESCE('kind: ' || d.kind || chr(10), '')
    || CASE WHEN d.doc_id % 6 = 0 THEN 'expires: 2001-02-30' || chr(10) ELSE '' END
    || CASE WHEN d.doc_id % 9 = 0 THEN 'describe: [src/**]' || chr(10) ELSE '' END
    || 'tags: [' || split_part(d.path, '/', 2) || ', ' || d.id || ']' || chr(10) || '---' || chr(10) END
  || '# Doc ' || CAST(d.doc_id AS STRING) || chr(10) || chr(10) || '## Setup' || chr(10)
  || 'PORT=' || CASE WHEN d.doc_id % 7 = 0 THEN '<your-port>' ELSE CAST(8000 + d.doc_id % 3 AS STRING) END || chr(10)
  || 'Open http://localhost:' || CAST(3000 + d.doc_id % 4 AS STRING)
  || CASE WHEN d.doc_id % 10 = 0 THEN ' and localhost:5432' ELSE '' END || chr(10)
  || '```sh' || chr(10) || '# not a heading' || chr(10) || 'npm run dev' || chr(10) || '```' || chr(10)
  || 'See `' || CASE d.doc_id % 3 WHEN 0 THEN f.path WHEN 1 THEN CAST(d.k AS STRING) || '.ts' ELSE './' || replace(f.path, '.ts', '.js') END || '`.'
  || chr(10) || chr(10) || d.body AS raw
FROM f_docs d JOIN f_files f ON f.k = d.k""",
}


def _needed(names: list[str]) -> list[str]:
    """The views that `names` rest on, in order."""
    wanted = set(names)
    for name in reversed(VIEWS):
        if name in wanted:
            wanted |= {v for v in VIEWS if re.search(rf"\b{v}\b", VIEWS[name])}
    return [v for v in VIEWS if v in wanted]


def with_views(*names: str) -> str:
    """A WITH list of views, for an engine that knows the base tables."""
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in _needed(list(names)))


class Fixtures:
    """Views over the tables of one folder.

    They are joined by sorting: a table of a few compressed columns looks small enough to be sent to all, but the
    paths made of it are many times as large.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir, self.made = spark, sf_dir, {}
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self.made[name]

    def view(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self._view(name).hint("merge")
        return self.made[name]

    def _view(self, name: str) -> DataFrame:
        sql = VIEWS[name]
        bases = {t: self.table(t) for t in ("part", "documents", "orders", "lineitem") if re.search(rf"\b(FROM|JOIN) {t}\b", sql)}
        bases |= {v: self.view(v) for v in VIEWS if re.search(rf"\b(FROM|JOIN) {v}\b", sql)}
        for t in bases:
            sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
        out = self.spark.sql(sql, **bases)
        times = [c for c, kind in out.dtypes if kind == "timestamp_ntz"]
        return out.withColumns({c: out[c].cast("timestamp") for c in times}) if times else out

    def __getattr__(self, name: str) -> DataFrame:
        if f"f_{name}" in VIEWS:
            return self.view(f"f_{name}")
        raise AttributeError(name)
