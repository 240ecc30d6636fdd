"""DuckDB SQL for the queries of this subpackage that SQL can express."""

OP4 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""

OP6 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
"""

# crc32 by bits; trees by recursion over levels; a leaf's proof and its fold by one more recursion
OP11 = """
WITH RECURSIVE e AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, text,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    xor(4294967295, list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)), lambda crc, b:
      list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))) AS crc
  FROM documents),
l AS (
  SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed FROM e),
n0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM l),
nodes AS (
  SELECT tree, 0 AS level, idx, n AS width, leaf AS hash FROM n0
  UNION ALL
  SELECT tree, level + 1, idx // 8, (width + 7) // 8, sha256(string_agg(hash, '' ORDER BY idx)) FROM nodes WHERE width > 1 GROUP BY tree, level, idx // 8, width),
sub AS (SELECT tree, level AS depth, hash AS subroot FROM nodes WHERE width = 1),
crown AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY tree) - 1 AS idx, (SELECT count(*) FROM sub) AS width, subroot AS hash FROM sub
  UNION ALL
  SELECT level + 1, idx // 8, (width + 7) // 8, sha256(string_agg(hash, '' ORDER BY idx)) FROM crown WHERE width > 1 GROUP BY level, idx // 8, width),
-- one forest: a crown's level lies above its language's tree
runs AS (
  SELECT tree, level, idx // 8 AS run, list(hash ORDER BY idx) AS hashes FROM nodes WHERE width > 1 GROUP BY ALL
  UNION ALL
  SELECT NULL, level, idx // 8, list(hash ORDER BY idx) FROM crown WHERE width > 1 GROUP BY ALL),
place AS (SELECT tree, depth, subroot, row_number() OVER (ORDER BY tree) - 1 AS at FROM sub),
fold AS (
  SELECT n0.doc_id, n0.tree, n0.idx AS leaf_idx, 0 AS level, n0.idx, coalesce(changed, leaf) AS got, '' AS proof FROM n0
  UNION ALL
  SELECT f.doc_id, f.tree, f.leaf_idx, f.level + 1, f.idx // 8 + CASE WHEN f.level + 1 = p.depth THEN p.at ELSE 0 END,
    sha256(array_to_string(r.hashes[1:f.idx % 8], '') || f.got || array_to_string(r.hashes[f.idx % 8 + 2:], '')),
    f.proof || array_to_string(r.hashes[1:f.idx % 8], '') || array_to_string(r.hashes[f.idx % 8 + 2:], '')
  FROM fold f JOIN place p ON p.tree = f.tree
  JOIN runs r ON r.tree IS NOT DISTINCT FROM (CASE WHEN f.level < p.depth THEN f.tree END)
    AND r.level = (CASE WHEN f.level < p.depth THEN f.level ELSE f.level - p.depth END) AND r.run = f.idx // 8),
done AS (SELECT tree, leaf_idx, arg_max(got, level) AS folded, arg_max(proof, level) AS proof FROM fold GROUP BY tree, leaf_idx)
SELECT n0.doc_id, n0.leaf, p.subroot, c.hash AS root, sha256(d.proof) AS proof_sha256, d.folded AS folded_root, d.folded = c.hash AS verified
FROM n0 JOIN place p ON p.tree = n0.tree JOIN done d ON d.tree = n0.tree AND d.leaf_idx = n0.idx, (SELECT hash FROM crown WHERE width = 1) c
"""

OP12 = r"""
WITH parts AS (SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, u, l), p) AS terms FROM documents, parts),
s AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(terms)) AS BIGINT) AS total FROM d WHERE len(terms) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, u, l), p)) AS term FROM benchmark, parts),
t AS (SELECT r, doc_id, len(terms) AS length, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, terms, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s GROUP BY term, n),
x AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * length * n) // total)))) AS BIGINT) AS score
      FROM q JOIN t USING (term) JOIN w USING (term), s GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT * FROM k WHERE rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_topk_search": OP4, "op6_exact_dedup": OP6, "op11_merkle_manifest": OP11, "op12_lexical_search": OP12}
