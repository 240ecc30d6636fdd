"""DuckDB twins of the registered queries, written apart from the operators."""

from __future__ import annotations

import re

from florilege.functions.text import STOPWORDS
from florilege.plans.queries import BUDGET, TASK
from florilege.sources.fixtures import NOW, with_views

CLOCK = f"TIMESTAMP '{NOW}'"

#: hits: every described file; own and code: newest commits; r: the verdict with its evidence.
REPORTS = f"""
g AS (SELECT dg.doc_id, d.path, dg.ord, dg.glob, dg.rx FROM f_doc_globs dg JOIN f_docs d USING (doc_id)),
dg AS (SELECT DISTINCT glob, rx FROM g),
lit AS (SELECT dg.glob, f.path AS file FROM dg JOIN f_files f ON f.path = dg.glob),
mag AS (SELECT dg.glob, f.path AS file FROM dg JOIN f_files f ON split_part(f.path, '/', 4) = regexp_extract(dg.glob, '[^/]*$') AND regexp_matches(f.path, dg.rx) WHERE dg.glob LIKE '%*%'),
hit AS (SELECT * FROM lit UNION SELECT * FROM mag),
res AS (SELECT DISTINCT g.path, h.file FROM g JOIN hit h USING (glob)),
claims AS (SELECT path, list(glob ORDER BY ord) AS describes, coalesce(list(glob ORDER BY ord) FILTER (WHERE glob NOT IN (SELECT glob FROM hit)), []) AS missing FROM g GROUP BY path),
own AS (SELECT path, max(struct_pack(ts := c.author_ts, sha := c.sha, subject := c.subject)) AS own FROM f_commit_files cf JOIN f_commits c USING (sha) WHERE path IN (SELECT path FROM f_docs) GROUP BY path),
hist AS (SELECT res.path, res.file, c.* FROM res JOIN f_commit_files cf ON cf.path = res.file JOIN f_commits c ON c.sha = cf.sha),
code AS (SELECT path, max(struct_pack(ts := author_ts, sha := sha, subject := subject)) AS code FROM hist GROUP BY path),
later AS (SELECT h.path, h.sha, h.file FROM hist h JOIN own o ON o.path = h.path WHERE h.commit_ts >= o.own.ts + INTERVAL 1 SECOND),
since AS (SELECT path, CAST(count(DISTINCT sha) AS INTEGER) AS n, list_sort(list(DISTINCT file)) AS files FROM later GROUP BY path),
matched AS (SELECT path, CAST(count(DISTINCT file) AS INTEGER) AS n FROM res GROUP BY path),
sup AS (SELECT supersedes AS id, list_sort(list(path)) AS superseded_by FROM f_docs WHERE supersedes IS NOT NULL GROUP BY supersedes),
e AS (SELECT d.*, coalesce(cl.describes, []) AS describes, coalesce(cl.missing, []) AS missing, coalesce(m.n, 0) AS matched, o.own, c.code, s.superseded_by,
      CASE WHEN o.own IS NULL THEN 0 ELSE greatest(0, CAST(floor((epoch_ms({CLOCK}) - epoch_ms(o.own.ts)) / 86400000.0) AS INTEGER)) END AS age,
      CASE WHEN m.n > 0 AND o.own IS NOT NULL AND c.code IS NOT NULL THEN CAST(floor((epoch_ms(c.code.ts) - epoch_ms(o.own.ts)) / 86400000.0) AS INTEGER) ELSE 0 END AS drift_days,
      CASE WHEN m.n > 0 AND c.code.ts > o.own.ts THEN coalesce(si.n, 0) ELSE 0 END AS commits_since,
      CASE WHEN m.n > 0 AND c.code.ts > o.own.ts THEN coalesce(list_slice(si.files, 1, 20), []) ELSE [] END AS changed
      FROM f_docs d LEFT JOIN claims cl ON cl.path = d.path LEFT JOIN matched m ON m.path = d.path LEFT JOIN own o ON o.path = d.path LEFT JOIN code c ON c.path = d.path
      LEFT JOIN since si ON si.path = d.path LEFT JOIN sup s ON s.id = d.id),
v AS (SELECT *, CASE WHEN drift_days >= 45 OR commits_since >= 10 THEN 3 WHEN drift_days >= 14 OR commits_since >= 5 THEN 2 ELSE 0 END AS rung,
      100.0 * pow(0.5, greatest(0, drift_days) / 45.0 + commits_since / 10.0) AS raw FROM e),
w AS (SELECT *, len(describes) > 0 AND matched > 0 AND own IS NOT NULL AS measured, len(describes) > 0 AND matched = 0 AS orphan, expires IS NOT NULL AND expires <= {CLOCK} AS dated,
      ttl_days > 0 AND own IS NOT NULL AND age > ttl_days AS overdue, superseded_by IS NOT NULL AS replaced FROM v),
z AS (SELECT *, NOT measured AND NOT orphan AS unver FROM w),
r AS (SELECT *, ['fresh', 'unverified', 'drifting', 'stale', 'expired', 'orphaned', 'superseded'][1 + CASE WHEN replaced THEN 6 WHEN orphan THEN 5 WHEN dated OR coalesce(overdue, FALSE) THEN 4 WHEN measured AND rung = 3 THEN 3 WHEN measured AND rung = 2 THEN 2 WHEN unver THEN 1 ELSE 0 END] AS freshness,
      CAST(floor(0.5 + least(100.0, CASE WHEN replaced THEN 10 * pow(0.5, age / 90.0) ELSE 100 END, CASE WHEN orphan THEN 3 + 17 * pow(0.5, age / 90.0) ELSE 100 END,
      CASE WHEN dated THEN 5 + 25 * pow(0.5, floor((epoch_ms({CLOCK}) - epoch_ms(expires)) / 86400000.0) / 30.0) ELSE 100 END, CASE WHEN overdue THEN 5 + 25 * pow(0.5, (age - ttl_days) / 30.0) ELSE 100 END,
      CASE WHEN unver THEN 50 ELSE 100 END,
      CASE WHEN measured THEN (CASE rung WHEN 3 THEN least(55.0, greatest(10.0, raw)) WHEN 2 THEN least(85.0, greatest(40.0, raw)) ELSE least(100.0, greatest(70.0, raw)) END) * (1 - 0.5 * len(missing) / len(describes)) ELSE 100 END)) AS INTEGER) AS score FROM z)"""


def _reports(select: str, *ctes: str, views: tuple[str, ...] = ()) -> str:
    return ",\n".join([with_views("f_docs", "f_files", "f_commits", "f_commit_files", "f_doc_globs", *views) + "," + REPORTS, *ctes]) + "\n" + select


def _over(view: str, select: str, *ctes: str) -> str:
    return ",\n".join([with_views(*view.split()), *ctes]) + "\n" + select


WORD, CJK = "A-Za-z0-9À-ɏ", "぀-ヿ㐀-䶿一-鿿豈-﫿가-힯"


def _sum(column: str, pattern: str, size: int) -> str:
    return f"coalesce(list_sum(list_transform(regexp_extract_all({column}, '{pattern}'), lambda x: CAST(ceil(len(x) / {size}.0) AS INTEGER))), 0)"


def _tokens(c: str, size: int = 6) -> str:
    """Ten times the tokens of a text, its line ends left out."""
    return f"(10 * ({_sum(c, f'[{WORD}]+', size)} + {_sum(c, f'[^{WORD}{CJK} \\t\\n\\r]+', 2)}) + 12 * (len({c}) - len(regexp_replace({c}, '[{CJK}]', '', 'g'))))"


def _estimate(c: str) -> str:
    return f"CASE WHEN trim({c}, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 0 ELSE greatest(1, CAST(floor(({_tokens(c)} + 5 * (len({c}) - len(replace({c}, chr(10), ''))) + 5) / 10) AS INTEGER)) END"


def _stem(w: str) -> str:
    """Four steps, each over the one before."""
    one = (
        f"list_transform({w}, lambda w: CASE WHEN len(w) <= 3 THEN w WHEN w LIKE '%ies' AND len(w) > 4 THEN left(w, len(w) - 3) || 'y' WHEN w LIKE '%sses' THEN left(w, len(w) - 2) "
        "WHEN regexp_matches(w, '(ches|shes|xes|zes|ses)$') AND len(w) > 4 THEN left(w, len(w) - 2) WHEN w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is)$') THEN left(w, len(w) - 1) ELSE w END)"
    )
    two = f"list_transform({one}, lambda w: CASE WHEN w LIKE '%ing' AND len(w) > 5 THEN left(w, len(w) - 3) WHEN w LIKE '%ed' AND len(w) > 4 THEN left(w, len(w) - 2) ELSE w END)"
    three = f"list_transform({two}, lambda w: CASE WHEN w LIKE '%e' AND len(w) > 3 THEN left(w, len(w) - 1) ELSE w END)"
    return f"list_transform({three}, lambda w: CASE WHEN len(w) > 3 AND right(w, 1) = substr(w, len(w) - 1, 1) AND right(w, 1) NOT IN ('a', 'e', 'i', 'o', 'u') THEN left(w, len(w) - 1) ELSE w END)"


def _raw_tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda w: len(w) >= 2)"


def _terms(task: str) -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(STOPWORDS))
    return _stem(f"list_filter({_raw_tokens(f"'{task}'")}, lambda w: w NOT IN ({stop}))")


TOKENS = f"tk AS (SELECT path, id, {_stem(_raw_tokens('body'))} AS body, {_stem(_raw_tokens('id'))} AS idt, {_stem(_raw_tokens("regexp_replace(path, '[.]mdx?$', '')"))} AS patht FROM f_docs)"
RELEVANCE = f"""{TOKENS},
qt AS (SELECT DISTINCT term FROM (SELECT unnest({_terms(TASK)}) AS term) WHERE len(term) >= 2),
ql AS (SELECT list_filter({_terms(TASK)}, lambda w: len(w) >= 2) AS l0),
qd AS (SELECT list_transform(list_filter(list_zip(l0, range(len(l0))), lambda p: list_position(l0, p[1]) = p[2] + 1), lambda p: p[1]) AS l FROM ql),
qb AS (SELECT unnest(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) AS pair FROM qd),
ct AS (SELECT path, term, 1.0 * len(list_filter(body, lambda w: w = term)) AS b, len(body) AS n, 1.0 * len(list_filter(idt, lambda w: w = term)) AS i, 1.0 * len(list_filter(patht, lambda w: w = term)) AS p FROM tk, qt),
ts AS (SELECT path, sum(1 - exp(-(b * 2.2 / (b + 1.2 * (0.5 + 0.5 * n / 400.0)) + 3 * i * 2.2 / (i + 1.2) + 1.2 * p * 2.2 / (p + 1.2)) / 2.5)) / count(*) AS s FROM ct GROUP BY path),
bp AS (SELECT path, list_transform(range(1, len(body)), lambda i: body[i] || ' ' || body[i + 1]) AS ps FROM tk),
bh AS (SELECT path, count(*) FILTER (WHERE list_contains(ps, pair)) * 1.0 / count(*) AS h FROM bp, qb GROUP BY path),
rel AS (SELECT tk.path, least(1.0, greatest(0.0, floor(CASE WHEN len(tk.id) >= 3 AND contains(lower('{TASK}'), lower(tk.id)) THEN greatest(0.9, s + (1 - s) * 0.3 * h) ELSE s + (1 - s) * 0.3 * h END * 10000 + 0.5) / 10000)) AS relevance
        FROM tk JOIN ts USING (path) JOIN bh USING (path))"""
RANK = """(relevance * CASE kind WHEN 'decision' THEN 1.15 WHEN 'runbook' THEN 1.15 WHEN 'spec' THEN 1.1 WHEN 'handoff' THEN 1.05 WHEN 'reference' THEN 1.0 WHEN 'guide' THEN 0.95 WHEN 'index' THEN 0.8 ELSE 0.9 END
 * CASE freshness WHEN 'fresh' THEN 1.0 WHEN 'unverified' THEN 0.75 WHEN 'drifting' THEN 0.6 WHEN 'stale' THEN 0.25 WHEN 'expired' THEN 0.15 WHEN 'orphaned' THEN 0.1 ELSE 0.05 END * (0.6 + 0.4 * score / 100.0))"""
PACK = f"""{RELEVANCE},
pk AS (SELECT r.path, r.freshness, r.score, r.pin, rel.relevance, CAST({RANK} AS DOUBLE) AS rank, {_estimate('r.body')} AS cost,
       NOT pin AND freshness IN ('stale', 'expired', 'orphaned', 'superseded') AS excluded FROM r JOIN rel USING (path) WHERE pin OR relevance >= 0.05),
ps AS (SELECT *, sum(cost) OVER (ORDER BY pin DESC, rank DESC, score DESC, path ROWS UNBOUNDED PRECEDING) AS total FROM pk WHERE NOT excluded)"""

MD = """md AS (SELECT doc_id, path, raw, doc_id % 4 <> 3 AS has_fm, CASE WHEN doc_id % 4 <> 3 THEN substr(raw, strpos(raw, chr(10) || '---' || chr(10)) + 5) ELSE raw END AS body,
       CASE WHEN doc_id % 4 <> 3 THEN substr(raw, 5, strpos(raw, chr(10) || '---' || chr(10)) - 4) ELSE '' END AS block FROM f_md)"""
LINES = MD + """,
li AS (SELECT path, doc_id, unnest(string_split(body, chr(10))) AS t, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS line FROM md)"""
# Fixed values, as in the operators.
ENV_RX = r"""^[\s>$#*+-]*`{0,3}\s*(?:export\s+|set\s+|ENV\s+)?([A-Z][A-Z0-9_]{2,40})\s*=\s*("[^"]*"|''[^'']*''|[^\s`#]+)\s*`{0,3}\s*$"""
CMD_RX = r"(?i)\b(npm|pnpm|yarn|bun)\s+(?:(run)\s+)?([a-z][a-z0-9:_-]{1,30})\b"
FACTS = LINES + f""",
fe AS (SELECT path, 'env:' || regexp_extract(t, '{ENV_RX}', 1) AS key, regexp_extract(t, '{ENV_RX}', 2) AS value, line, 0 AS seq FROM li WHERE regexp_matches(t, '{ENV_RX}') AND NOT regexp_matches(regexp_extract(t, '{ENV_RX}', 2), '^[<$]')),
fp AS (SELECT path, 'net:localhost-port' AS key, unnest(regexp_extract_all(t, '\\blocalhost:(\\d{{2,5}})\\b', 1)) AS value, line, unnest(range(len(regexp_extract_all(t, '\\blocalhost:(\\d{{2,5}})\\b', 1)))) AS seq FROM li),
fs AS (SELECT path, 'script:' || lower(regexp_extract(t, '{CMD_RX}', 3)) AS key, lower(regexp_extract(t, '{CMD_RX}', 1)) AS value, line, 0 AS seq FROM li WHERE regexp_matches(t, '{CMD_RX}') AND regexp_extract(t, '{CMD_RX}', 2) <> ''),
fa AS (SELECT * FROM fe UNION ALL SELECT * FROM fp UNION ALL SELECT * FROM fs),
asr AS (SELECT path, key, min(value) AS value, min(line) AS line FROM fa GROUP BY path, key HAVING count(DISTINCT value) = 1)"""
SHINGLES = r"""wd AS (SELECT path, body, list_filter(regexp_split_to_array(regexp_replace(lower(body), '```[\s\S]*?```', ' ', 'g'), '[^a-z0-9]+'), lambda w: w <> '') AS ws,
  sha256(trim(regexp_replace(body, '\s+', ' ', 'g'))) AS h FROM f_docs),
rp AS (SELECT min(path) AS path FROM wd GROUP BY h),
sh AS (SELECT DISTINCT path, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) AS s FROM wd SEMI JOIN rp USING (path) WHERE len(ws) >= 40),
sn AS (SELECT path, count(*) AS n FROM sh GROUP BY path),
sp AS (SELECT x.path AS a, y.path AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.path < y.path GROUP BY 1, 2),
nd AS (SELECT a, b, c * 1.0 / (x.n + y.n - c) AS j FROM sp JOIN sn x ON x.path = a JOIN sn y ON y.path = b WHERE c * 1.0 / (x.n + y.n - c) > 0.8)"""
IDS = "di AS (SELECT trim(id) AS id, list_sort(list(path)) AS paths FROM f_docs WHERE trim(id) <> '' GROUP BY trim(id) HAVING count(*) > 1)"
SAME = r"sd AS (SELECT sha256(trim(regexp_replace(body, '\s+', ' ', 'g'))) AS content_hash, list_sort(list(path)) AS paths FROM f_docs GROUP BY 1 HAVING count(*) > 1)"
SOURCE = """sx AS (SELECT suffix, min(path) AS path, CAST(count(*) AS INTEGER) AS n FROM (SELECT path, unnest(list_transform(range(2, len(string_split(path, '/')) + 1), lambda i: array_to_string(string_split(path, '/')[i:], '/'))) AS suffix FROM f_files) GROUP BY suffix)"""
MENTION = """mn AS (SELECT DISTINCT path, mention FROM (SELECT path, unnest(list_concat(
  list_transform(regexp_extract_all(raw, '(?:^|[\\s`''"(\\[<])(?:(?:\\.{0,2}/)?[\\w@.\\-]+(?:/[\\w@.\\-]+)+\\.[A-Za-z]{1,6})'), lambda m: ltrim(m, ' `''"([<' || chr(10))),
  regexp_extract_all(raw, '`([\\w.\\-]+\\.[A-Za-z]{1,6})`', 1))) AS mention FROM f_md))"""
LINKS = """bf AS (SELECT 'old/' || typ || '/**' AS glob, old_path, count(*) OVER (PARTITION BY typ) AS files FROM f_old_files),
lk AS (SELECT glob, bf.old_path, new_path, similarity, files FROM bf LEFT JOIN f_renames r ON r.old_path = bf.old_path),
hm AS (SELECT glob, left(new_path, len(new_path) - len(regexp_extract(old_path, '[^/]*$'))) AS home, count(*) AS moved, min(similarity) AS lowest, min(files) AS files FROM lk WHERE new_path IS NOT NULL GROUP BY 1, 2),
vt AS (SELECT *, rank() OVER (PARTITION BY glob ORDER BY moved DESC) AS place, count(*) OVER (PARTITION BY glob, moved) > 1 AS tied FROM hm)"""

MOVES = """rl AS (SELECT b.glob, CAST(b.files AS INTEGER) AS file_count, CAST(b.linked AS INTEGER) AS linked_count, CAST(coalesce(v.moved, 0) AS INTEGER) AS moved_count, v.home || '**' AS suggested,
            CAST(coalesce((SELECT count(*) FROM f_renames x WHERE starts_with(x.new_path, v.home)) - v.moved, 0) AS INTEGER) AS extra_matches, CAST(coalesce(v.lowest, b.lowest) AS INTEGER) AS lowest_similarity
            FROM (SELECT glob, min(files) AS files, count(new_path) AS linked, min(similarity) AS lowest FROM lk GROUP BY glob) b LEFT JOIN (SELECT * FROM vt WHERE place = 1 AND NOT tied AND 2 * moved > files) v ON v.glob = b.glob)"""
COVER = (
    "ch AS (SELECT DISTINCT cf.path FROM f_commit_files cf JOIN f_files f ON f.path = cf.path WHERE cf.sha IN (SELECT sha FROM f_commits WHERE author_ts IS NOT NULL ORDER BY author_ts DESC, sha DESC LIMIT 10))",
    "cov AS (SELECT g.path, list_sort(list(DISTINCT ch.path)) AS files FROM g JOIN ch ON ch.path = g.glob OR (contains(g.glob, '*') AND starts_with(g.glob, 'src/') AND starts_with(ch.path, 'src/') AND ends_with(ch.path, regexp_extract(g.glob, '[^/]*$'))) GROUP BY g.path)",
)
KNOWN = "k AS (SELECT unnest(['fresh', 'unverified', 'drifting', 'stale', 'expired', 'orphaned', 'superseded']) AS freshness, CAST(unnest(range(7)) AS INTEGER) AS severity)"
COUNTS = "c AS (SELECT count(*) AS n, count(*) FILTER (WHERE len(describes) = 0) AS u, count(*) FILTER (WHERE freshness NOT IN ('fresh', 'unverified')) AS b FROM r)"
EVIDENCE = """CASE WHEN len(describes) = 0 THEN 'no evidence: it describes nothing' ELSE array_to_string(list_filter([CASE WHEN own IS NULL THEN 'never committed' ELSE 'written ' || left(own.sha, 7) || ' on ' || strftime(own.ts, '%Y-%m-%d') END,
  CASE WHEN code IS NULL THEN 'code without history' ELSE 'code moved ' || left(code.sha, 7) || ' on ' || strftime(code.ts, '%Y-%m-%d') END, 'drift ' || drift_days || 'd, ' || commits_since || CASE WHEN commits_since = 1 THEN ' commit' ELSE ' commits' END,
  matched || CASE WHEN matched = 1 THEN ' file' ELSE ' files' END, CASE WHEN len(missing) > 0 THEN 'nothing at ' || array_to_string(missing, ', ') END], lambda x: x IS NOT NULL), '; ') END"""
HASHES = r"""fw AS (SELECT path, list_filter(regexp_split_to_array(regexp_replace(lower(body), '```[\s\S]*?```', ' ', 'g'), '[^a-z0-9]+'), lambda w: w <> '') AS ws FROM f_docs),
fs AS (SELECT DISTINCT path, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) AS s FROM fw WHERE len(ws) >= 40),
fh AS (SELECT path, list_reduce(list_transform(string_split(s, ''), lambda c: CAST(ord(c) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296, CAST(2166136261 AS BIGINT)) AS h FROM fs),
fv AS (SELECT fw.path, ws, x.hs FROM fw LEFT JOIN (SELECT path, list(DISTINCT h) AS hs FROM fh GROUP BY path) x ON x.path = fw.path)"""


SHIPS = "SELECT l_orderkey, l_linenumber, l_partkey, date_diff('day', o_orderdate, l_shipdate) AS days, CAST(l_quantity AS INTEGER) AS commits FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
CODE = "'```sh' || chr(10) || '# not a heading' || chr(10) || 'npm run dev' || chr(10) || '```'"


def _mixed(c: str) -> str:
    """The estimate of a text in which CODE stands once at most; a line end beside it belongs to no part."""
    ends = f"len({c}) - len(replace({c}, chr(10), '')) - CASE WHEN NOT contains({c}, {CODE}) THEN 0 ELSE CAST(NOT starts_with({c}, {CODE}) AS INTEGER) + CAST(NOT ends_with({c}, {CODE}) AS INTEGER) END"
    prose, code = f"replace({c}, {CODE}, chr(10))", f"CASE WHEN contains({c}, {CODE}) THEN {_tokens(CODE, 4)} ELSE 0 END"
    return f"CASE WHEN regexp_matches({c}, '^\\s*$') THEN 0 ELSE greatest(1, CAST(floor(({_tokens(prose)} + {code} + 5 * ({ends}) + 5) / 10) AS INTEGER)) END"


def _cuts(source: str) -> tuple[str, ...]:
    """ct(k, text, tokens) of source(k, body, budget): every target's cut, the first that fits taken.

    Blocks and sentences are rows with running sums of their costs; a null text is one that no target fits.
    """
    running = "sum(cost) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS total"
    return (
        f"cs AS (SELECT k, body, budget, {_mixed('body')} AS whole FROM ({source}))",
        # a line's place: blank lines, headings and the fixed code part blocks
        rf"cp AS (SELECT *, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(replace(body, {CODE}, chr(10) || chr(10) || chr(1) || chr(10) || chr(10)), '(^|\n)(#{{1,6}}\s)', '\1' || chr(10) || '\2', 'g'), '\s+$', ''), '\n\s*\n'), lambda b: replace(regexp_replace(b, '^\s+|\s+$', '', 'g'), chr(1), {CODE})), lambda b: b <> '') AS parts FROM cs)",
        "cb AS (SELECT k, i, part, " + _mixed("part") + " AS cost FROM (SELECT k, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM cp))",
        f"cr AS (SELECT *, {running} FROM cb)",
        "cf AS (SELECT k, i, part, " + _estimate("part") + r" AS cost FROM (SELECT k, unnest(ss) AS part, unnest(range(len(ss))) AS i FROM (SELECT k, string_split(regexp_replace(parts[1], '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM cp)))",
        f"cq AS (SELECT *, {running} FROM cf)",
        "ta AS (SELECT k, 0 AS n, CAST(budget AS BIGINT) AS target FROM cs WHERE budget > 0 UNION ALL SELECT k, n + 1, target * 9 // 10 FROM ta WHERE n < 8 AND target * 9 // 10 >= 1)",
        """tc AS (SELECT ta.k, n, target, CASE WHEN whole <= target THEN body ELSE coalesce((SELECT string_agg(part, chr(10) || chr(10) ORDER BY i) FROM cr WHERE cr.k = ta.k AND total <= target),
            (SELECT string_agg(part, ' ' ORDER BY i) FROM cq WHERE cq.k = ta.k AND total <= target), left(body, greatest(1, CAST(floor(target * (len(body) / CAST(greatest(1, whole) AS DOUBLE))) AS INTEGER)))) END AS raw FROM ta JOIN cp ON cp.k = ta.k)""",
        r"td AS (SELECT k, n, CASE WHEN raw = (SELECT body FROM cs WHERE cs.k = tc.k) THEN raw ELSE regexp_replace(raw, '\s+$', '') END AS text FROM tc)",
        "te AS (SELECT k, n, text, " + _mixed("text") + " AS tokens FROM td)",
        "ct AS (SELECT cs.k, x.text, x.tokens FROM cs LEFT JOIN (SELECT k, arg_min(text, n) AS text, CAST(arg_min(tokens, n) AS INTEGER) AS tokens FROM te WHERE tokens <= (SELECT budget FROM cs WHERE cs.k = te.k) GROUP BY k) x ON x.k = cs.k)",
    )


def oracle_sql() -> dict[str, str]:
    out = {
        "truncate_blocks": _over("f_docs", "SELECT k AS doc_id, text, tokens FROM ct", *_cuts("SELECT doc_id AS k, body, len(body) % 160 + 1 AS budget FROM f_docs")).replace("WITH ", "WITH RECURSIVE ", 1),
        "truncate_markdown": _over("f_md", "SELECT k AS doc_id, sha256(text) AS text_sha, tokens FROM ct", *_cuts("SELECT doc_id AS k, replace(raw, '. ', '.' || chr(10) || chr(10)) AS body, len(raw) // 12 + doc_id % 40 AS budget FROM f_md")).replace("WITH ", "WITH RECURSIVE ", 1),
        "pack_cut": _reports("SELECT path, 'entry' AS place, CAST(cost AS BIGINT) AS tokens, sha256(body) AS content_sha FROM kt WHERE total <= " + str(BUDGET) + " UNION ALL SELECT k, 'cut', CAST(tokens AS BIGINT), sha256(text) FROM ct WHERE text IS NOT NULL",
            f"k AS (SELECT path, pin, score, body, CAST({RANK.replace('relevance', '0.5')} AS DOUBLE) AS rank, {_estimate('body')} AS cost FROM r WHERE kind IN ('decision', 'runbook'))",
            "kt AS (SELECT *, sum(cost) OVER (ORDER BY pin DESC, rank DESC, score DESC, path ROWS UNBOUNDED PRECEDING) AS total FROM k)",
            *_cuts(f"SELECT path AS k, body, CAST({BUDGET} - total + cost AS BIGINT) AS budget FROM kt WHERE total > {BUDGET} AND {BUDGET} - total + cost >= 400")).replace("WITH ", "WITH RECURSIVE ", 1),
        "scan_docs": _over("f_md", r"SELECT m.path, has_fm, CASE WHEN has_fm THEN d.id END AS id, CASE WHEN has_fm THEN d.kind END AS kind, 'Doc ' || m.doc_id AS title, CAST(len(list_filter(regexp_split_to_array(m.body, '\s+'), lambda w: w <> '')) AS INTEGER) AS word_count, CASE WHEN has_fm THEN split_part(m.path, '/', 2) || ',' || d.id ELSE '' END AS tags FROM md m JOIN f_docs d ON d.doc_id = m.doc_id", MD),
        "glob_filter": _over("f_files", "SELECT path FROM f_files WHERE regexp_matches(path, '^src/(small|economy)/([^/]+/)*[^/]*[05][.]ts$')"),
        "glob_resolve": _reports("SELECT g.path, g.glob, h.file FROM g JOIN hit h USING (glob)"),
        "missing_globs": _reports("SELECT path, glob FROM g WHERE glob NOT IN (SELECT glob FROM hit)"),
        "path_normalize": _over("f_files", "SELECT './' || replace(path, '/', '//') || '/' AS raw, path FROM f_files"),
        "doc_last_commit": _reports("SELECT path, CAST(epoch(own.ts) AS BIGINT) AS ts, own.sha AS sha FROM own"),
        "code_last_commit": _reports("SELECT path, CAST(epoch(code.ts) AS BIGINT) AS ts, code.sha AS sha FROM code"),
        "commits_since": _reports("SELECT path, n AS commits_since, array_to_string(list_slice(files, 1, 20), ',') AS changed FROM since"),
        "superseded": _reports("SELECT id, array_to_string(superseded_by, ',') AS superseded_by FROM sup"),
        "drift_score": "SELECT l_orderkey, l_linenumber, l_partkey, round(100.0 * pow(0.5, greatest(0, days) / 45.0 + commits / 10.0), 6) AS drift_score FROM (" + SHIPS + ")",
        "freshness_ladder": "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN days >= 45 OR commits // 4 >= 10 THEN 'stale' WHEN days >= 14 OR commits // 4 >= 5 THEN 'drifting' ELSE 'fresh' END AS verdict FROM (" + SHIPS + ")",
        "expired_docs": _reports("SELECT path, dated AS by_date, coalesce(ttl_days > 0 AND age > ttl_days, FALSE) AS by_ttl FROM r WHERE dated OR coalesce(ttl_days > 0 AND age > ttl_days, FALSE)"),
        "freshness_verdict": _reports("SELECT doc_id, path, freshness, score, drift_days, commits_since, matched, CAST(len(missing) AS INTEGER) AS missing FROM r"),
        "verdict_counts": _reports("SELECT k.freshness, k.severity, CAST(count(r.path) AS INTEGER) AS docs FROM k LEFT JOIN r ON r.freshness = k.freshness GROUP BY 1, 2", "k AS (SELECT unnest(['fresh', 'unverified', 'drifting', 'stale', 'expired', 'orphaned', 'superseded']) AS freshness, CAST(unnest(range(7)) AS INTEGER) AS severity)"),
        "check_gate": _reports("SELECT path, freshness, score FROM r WHERE freshness IN ('stale', 'expired', 'orphaned')"),
        "min_freshness": _reports("SELECT path, freshness FROM r WHERE freshness IN ('fresh', 'unverified', 'drifting')"),
        "fix_hints": _reports("""SELECT path, CASE freshness WHEN 'unverified' THEN 'name the source globs that ' || path || ' explains under `describes`'
            WHEN 'orphaned' THEN '`describes` matches nothing (' || array_to_string(missing, ', ') || '): point it at the moved code or delete the doc' WHEN 'expired' THEN 'read it again, then move the date or drop the time to live'
            WHEN 'superseded' THEN 'delete it or point to ' || array_to_string(superseded_by, ', ')
            WHEN 'stale' THEN CASE WHEN commits_since > 0 THEN 'review against the ' || commits_since || CASE WHEN commits_since = 1 THEN ' commit' ELSE ' commits' END || ' since' ELSE 'review and commit the doc again' END
            WHEN 'drifting' THEN CASE WHEN len(changed) > 0 THEN 'skim ' || array_to_string(changed[1:3], ', ') ELSE 'a quick read will likely clear it' END ELSE 'nothing to do' END AS hint FROM r"""),
        "reason_strings": _reports("""SELECT path, CASE freshness WHEN 'superseded' THEN 'superseded: replaced by ' || array_to_string(superseded_by, ', ')
            WHEN 'orphaned' THEN 'orphaned: ' || array_to_string(describes, ', ') || CASE WHEN len(describes) = 1 THEN ' matches' ELSE ' match' END || ' no tracked file' WHEN 'expired' THEN 'expired: past its date or time to live'
            WHEN 'unverified' THEN CASE WHEN len(describes) = 0 THEN 'unverified: describes nothing that could be checked' ELSE 'unverified: ' || matched || CASE WHEN matched = 1 THEN ' file' ELSE ' files' END || ' but no history of its own' END
            WHEN 'fresh' THEN 'fresh: within thresholds for ' || matched || CASE WHEN matched = 1 THEN ' file' ELSE ' files' END || ' of ' || array_to_string(describes, ', ')
            ELSE freshness || ': ' || CASE WHEN commits_since <= 0 AND drift_days <= 0 THEN 'code moved after the doc' ELSE array_to_string(list_filter([
              CASE WHEN commits_since > 0 THEN commits_since || CASE WHEN commits_since = 1 THEN ' commit' ELSE ' commits' END || ' touched ' || array_to_string(describes, ', ') || ' since (latest: ' || left(code.sha, 7) || ' ''' || code.subject || ''', ' || ago(code_age) || ')' END,
              CASE WHEN drift_days > 0 THEN 'code is ' || drift_days || CASE WHEN drift_days = 1 THEN ' day' ELSE ' days' END || ' ahead (doc: ' || left(own.sha, 7) || ' ''' || own.subject || ''', ' || ago(age) || ')' END], lambda x: x IS NOT NULL), '; ') END END AS reason FROM ra""".replace("ago(code_age)", "CASE WHEN code_age <= 0 THEN 'today' WHEN code_age = 1 THEN '1 day ago' ELSE code_age || ' days ago' END").replace("ago(age)", "CASE WHEN age <= 0 THEN 'today' WHEN age = 1 THEN '1 day ago' ELSE age || ' days ago' END"), f"ra AS (SELECT *, CAST(floor((epoch_ms({CLOCK}) - epoch_ms(code.ts)) / 86400000.0) AS INTEGER) AS code_age FROM r)"),
        "doctor_counts": _reports("SELECT CAST(count(*) AS INTEGER) AS docs, CAST(count(*) FILTER (WHERE len(describes) > 0) AS INTEGER) AS with_claims, CAST(count(*) FILTER (WHERE len(describes) = 0) AS INTEGER) AS unprovable, CAST(count(*) FILTER (WHERE freshness NOT IN ('fresh', 'unverified')) AS INTEGER) AS not_fresh, CAST(round(100.0 * count(*) FILTER (WHERE len(describes) = 0) / count(*)) AS INTEGER) AS unprovable_pct FROM r"),
        "doctor_findings": _reports("""SELECT * FROM (SELECT CASE WHEN u > n / 2.0 THEN 'major' ELSE 'minor' END AS severity, u || ' of ' || n || ' docs (' || CAST(round(100.0 * u / n) AS INTEGER) || '%) describe nothing' AS title FROM c
            UNION ALL SELECT 'major', (SELECT count(*) FROM di) || ' duplicate ids' UNION ALL SELECT 'major', (SELECT count(*) FROM di) + (SELECT count(*) FROM sd) + (SELECT count(*) FROM nd) || ' conflicts between docs'
            UNION ALL SELECT CASE WHEN b > n / 3.0 THEN 'major' ELSE 'minor' END, b || ' docs are not fresh' FROM c) WHERE NOT starts_with(title, '0 ')""", IDS, SAME, SHINGLES, COUNTS),
        "handoff_cover": _reports("SELECT path, array_to_string(files, ',') AS files FROM cov", *COVER),
        "token_estimate": _over("f_docs", f"SELECT doc_id, {_estimate('body')} AS tokens FROM f_docs"),
        "token_estimate_markdown": _over("f_md", f"""SELECT doc_id, CAST(floor(({_tokens("a")} + {_tokens("c", 4)} + {_tokens("b")} + 5 * (len(raw) - len(replace(raw, chr(10), '')) - 2) + 5) / 10) AS INTEGER) AS tokens FROM s""",
            "s AS (SELECT doc_id, raw, left(raw, strpos(raw, '```sh') - 1) AS a, '```sh' || chr(10) || '# not a heading' || chr(10) || 'npm run dev' || chr(10) || '```' AS c, substr(raw, strpos(raw, 'npm run dev') + 15) AS b FROM f_md)"),
        "word_count": _over("f_docs", r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(body, '\s+'), lambda w: w <> '')) AS INTEGER) AS words FROM f_docs"),
        "content_hash": _over("f_docs", r"SELECT doc_id, sha256(trim(regexp_replace(body, '\s+', ' ', 'g'))) AS content_hash FROM f_docs"),
        "headings": "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' ELSE CASE WHEN p_size % 2 = 1 THEN '' ELSE '1:' || p_name || '|' END || '2:' || p_type || '|3:' || p_name || ' ' || p_size END AS headings FROM part",
        "doc_titles": "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'Brand ' || split_part(p_brand, '#', 2) || ' ' || p_partkey WHEN p_size % 2 = 1 THEN p_type ELSE p_name END AS title FROM part",
        "demoted_headings": _over("f_md", r"SELECT doc_id, sha256(regexp_replace(raw, '(^|\n)(# Doc |## Setup)', '\1##\2', 'g')) AS text_sha FROM f_md"),
        "tokenize": _over("f_docs", "SELECT doc_id, sha256(array_to_string(body, ' ')) AS tokens_sha, CAST(len(body) AS INTEGER) AS n FROM tk JOIN f_docs USING (path)".replace("body", "tk.body"), TOKENS),
        "stem_tokens": _over("f_docs", f"SELECT w AS word, array_to_string({_stem("[w || 's', w || 'ies', w || 'ing', w || 'sses', w || 'nned', w]")}, ' ') AS stems FROM (SELECT DISTINCT unnest({_raw_tokens('body')}) AS w FROM f_docs)"),
        "term_freq": _over("f_docs", "SELECT path, field, term, CAST(count(*) AS INTEGER) AS tf, min(n) AS field_len FROM (SELECT path, 'body' AS field, unnest(body) AS term, CAST(len(body) AS INTEGER) AS n FROM tk UNION ALL SELECT path, 'id', unnest(idt), CAST(len(idt) AS INTEGER) FROM tk UNION ALL SELECT path, 'path', unnest(patht), CAST(len(patht) AS INTEGER) FROM tk) GROUP BY path, field, term", TOKENS),
        "bm25_saturation": "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN tf <= 0 THEN 0.0 ELSE tf * 2.2 / (tf + 1.2) END, 6) AS plain, round(CASE WHEN tf <= 0 THEN 0.0 ELSE tf * 2.2 / (tf + 1.2 * (0.5 + 0.5 * n / 400.0)) END, 6) AS by_length FROM (SELECT *, l_quantity - 1 AS tf, l_extendedprice / 64 AS n FROM lineitem)",
        "relevance": _over("f_docs", "SELECT path, relevance FROM rel", RELEVANCE),
        "search_topk": _reports("SELECT r.path, relevance, score FROM r JOIN rel USING (path) WHERE relevance > 0 ORDER BY relevance DESC, score DESC, r.path LIMIT 20", RELEVANCE),
        "snippet": _over("f_docs", r"""SELECT doc_id, CASE WHEN s > 0 THEN '…' ELSE '' END || trim(regexp_replace(substr(body, s + 1, least(len(body), s + 220) - s), '\s+', ' ', 'g'), ' ') || CASE WHEN least(len(body), s + 220) < len(body) THEN '…' ELSE '' END AS snippet
            FROM (SELECT *, coalesce(greatest(0, p - 74), 0) AS s FROM (SELECT *, least(nullif(strpos(lower(body), 'reing'), 0), nullif(strpos(lower(body), 'thand'), 0)) AS p FROM f_docs))"""),
        "pack_rank": _reports(f"SELECT r.path, round(CAST({RANK} AS DOUBLE), 6) AS rank FROM r JOIN rel USING (path)", RELEVANCE),
        "pack_budget": _reports("SELECT path, CAST(total AS BIGINT) AS total, cost FROM ps", PACK),
        "pack_entries": _reports(f"SELECT path, freshness, relevance, cost FROM ps WHERE total <= {BUDGET}", PACK),
        "pack_omitted": _reports(f"SELECT path, CAST(greatest(0, {BUDGET} - total + cost) AS BIGINT) AS \"left\" FROM ps WHERE total > {BUDGET}", PACK),
        "pack_excluded": _reports("SELECT path, freshness FROM pk WHERE excluded", PACK),
        "pack_by_kind": _reports(f"""SELECT path, CASE WHEN total <= {BUDGET} THEN 'entry' WHEN {BUDGET} - total + cost >= 400 THEN 'cut' ELSE 'omitted' END AS place FROM (SELECT path, cost, sum(cost) OVER (ORDER BY pin DESC, rank DESC, score DESC, path ROWS UNBOUNDED PRECEDING) AS total FROM k)""", f"k AS (SELECT path, pin, score, CAST({RANK.replace('relevance', '0.5')} AS DOUBLE) AS rank, {_estimate('body')} AS cost FROM r WHERE kind IN ('decision', 'runbook'))"),
        "duplicate_ids": _over("f_docs", "SELECT id, array_to_string(paths, ',') AS paths FROM di", IDS),
        "exact_duplicates": _over("f_docs", "SELECT content_hash, array_to_string(paths, ',') AS paths FROM sd", SAME),
        "near_duplicates": _over("f_docs", "SELECT a, b, round(CAST(j AS DOUBLE), 6) AS jaccard FROM nd", SHINGLES),
        "duplicate_id_classes": _over("f_docs", "SELECT trim(id) AS id, count(*) AS documents, array_to_string(list_sort(list(path))[1:5], ',') AS paths FROM f_docs WHERE trim(id) <> '' GROUP BY 1 HAVING count(*) > 1"),
        "exact_duplicate_classes": _over("f_docs", "SELECT content_hash, CAST(len(paths) AS BIGINT) AS documents, array_to_string(paths[1:5], ',') AS paths FROM sd", SAME),
        "contradiction_classes": _over("f_md", """SELECT key, CASE WHEN key = 'env:PORT' OR key LIKE 'script:%' THEN 'high' WHEN key LIKE 'net:%' THEN 'low' ELSE 'medium' END AS severity, value, count(*) AS documents, array_to_string(list_sort(list(path))[1:5], ',') AS paths
            FROM (SELECT *, min(value) OVER (PARTITION BY key) <> max(value) OVER (PARTITION BY key) AS several FROM asr WHERE path NOT IN (SELECT path FROM f_docs WHERE id IN (SELECT supersedes FROM f_docs))) WHERE several GROUP BY key, value""", FACTS),
        "near_duplicate_members": _over("f_docs", """SELECT path, coalesce(root, body) AS cluster, body FROM (SELECT path, min(path) OVER (PARTITION BY h) AS body, count(*) OVER (PARTITION BY h) AS copies FROM (SELECT path, regexp_replace(trim(regexp_replace(body, '\\s+', ' ', 'g')), ' +', ' ', 'g') AS h FROM f_docs))
            LEFT JOIN (SELECT node, min(to_) AS root FROM reach GROUP BY node) ON node = body WHERE copies > 1 OR root IS NOT NULL""", SHINGLES,
            "reach AS (SELECT a AS node, a AS to_ FROM nd UNION SELECT b, b FROM nd UNION SELECT r.node, CASE WHEN n.a = r.to_ THEN n.b ELSE n.a END FROM reach r JOIN nd n ON n.a = r.to_ OR n.b = r.to_)").replace("WITH ", "WITH RECURSIVE ", 1),
        "trees_as_of": _over("f_commit_files f_commits", """SELECT rev, path FROM (SELECT rev, path, arg_max(t, {'ts': c.commit_ts, 'sha': c.sha}) AS last FROM ct c JOIN yw w ON c.commit_ts < m.ts OR (c.commit_ts = m.ts AND c.sha < m.sha) GROUP BY rev, path) WHERE last <> 'D'""",
            "ct AS (SELECT f.path, c.sha, c.commit_ts, CASE WHEN c.subject = '5-LOW' THEN 'D' ELSE 'M' END AS t FROM f_commit_files f JOIN f_commits c ON c.sha = f.sha), yw AS (SELECT CAST(year(commit_ts) AS VARCHAR) AS rev, max({'ts': commit_ts, 'sha': sha}) AS m FROM f_commits GROUP BY 1)"),
        "facts_env": _over("f_md", "SELECT path, key, value, line FROM fe", FACTS),
        "facts_ports": _over("f_md", "SELECT path, key, value, line, CAST(seq AS INTEGER) AS seq FROM fp", FACTS),
        "facts_scripts": _over("f_md", "SELECT path, key, value, line FROM fs", FACTS),
        "fact_placeholders": _over("f_docs", r"""SELECT doc_id, count(*) FILTER (WHERE v = '' OR regexp_matches(v, '^[<{$]') OR contains(v, '...') OR contains(v, '…') OR regexp_matches(v, '^\*+$')
            OR regexp_matches(v, '(?i)^(your|my|some|example|sample|changeme|change_me|xxx|todo|tbd|placeholder|redacted|dummy|foo|bar)')) AS placeholders, count(*) AS words
            FROM (SELECT doc_id, regexp_replace(regexp_replace(w, '^["''`]|["''`]$', '', 'g'), '^\s+|\s+$', '', 'g') AS v FROM (SELECT doc_id, unnest(string_split(body, ' ')) AS w FROM f_docs)) GROUP BY doc_id"""),
        "asserted_facts": _over("f_md", "SELECT path, key, value, line FROM asr", FACTS),
        "contradictions": _over("f_md", "SELECT key, CASE WHEN key = 'env:PORT' OR key LIKE 'script:%' THEN 'high' WHEN key LIKE 'net:%' THEN 'low' ELSE 'medium' END AS severity, CASE WHEN key LIKE 'env:%' THEN 'environment variable' WHEN key LIKE 'net:%' THEN 'local port' ELSE 'run command' END AS label, array_to_string(list_sort(list(DISTINCT value)), '|') AS \"values\", CAST(count(DISTINCT path) AS INTEGER) AS docs FROM asr WHERE path NOT IN (SELECT path FROM f_docs WHERE id IN (SELECT supersedes FROM f_docs)) GROUP BY key HAVING count(DISTINCT value) > 1", FACTS),
        "conflicts_all": _over("f_docs", """SELECT 'duplicate-id' AS kind, 'high' AS severity, array_to_string(paths, ',') AS docs, id AS detail FROM di UNION ALL SELECT 'duplicate', 'high', array_to_string(paths, ','), 'identical' FROM sd
            UNION ALL SELECT 'duplicate', CASE WHEN j > 0.9 THEN 'high' ELSE 'medium' END, a || ',' || b, CAST(floor(j * 100 + 0.5) AS INTEGER) || '%' FROM nd""", IDS, SAME, SHINGLES),
        "facts_versions": """WITH l AS (SELECT CAST(p_partkey AS VARCHAR) AS path, CAST(p_size AS VARCHAR) AS v, p_size FROM part)
            SELECT path, 'version:node' AS key, v AS value, 1 AS line FROM l WHERE p_size BETWEEN 4 AND 40 UNION ALL SELECT path, 'version:python', v2, 2 FROM (SELECT path, '3.' || v AS v2 FROM l)""",
        "facts_urls": """WITH l AS (SELECT CAST(page_id AS VARCHAR) AS path, lower(regexp_extract(url, '^https?://[^/?#]+')) AS value FROM pages)
            SELECT path, 'url:api' AS key, value, 1 AS line FROM l UNION ALL SELECT path, 'url:base', value, 2 FROM l""",
        "loose_globs": _over("f_files", "SELECT DISTINCT g.glob, f.path FROM g JOIN f_files f ON regexp_matches(f.path, g.rx)",
            "p AS (SELECT split_part(path, '/', 2) AS t, right(split_part(path, '/', 3), 2) AS b FROM f_files)",
            """g AS (SELECT DISTINCT '**/' || left(t, 3) || '*/**' AS glob, '^(.*/)?' || left(t, 3) || '[^/]*(/.*)?$' AS rx FROM p UNION SELECT '**/*' || b || '/*', '^(.*/)?[^/]*' || b || '/[^/]*$' FROM p
            UNION SELECT '*/{' || t || ',x?y}/*', '^[^/]*/(' || t || '|x[^/]y)/[^/]*$' FROM p UNION SELECT '*/*/*', '^[^/]*/[^/]*/[^/]*$')"""),
        "infer_ids": """WITH d AS (SELECT coalesce(source, 'none') AS s, coalesce(lang, 'xx') AS l, 'd' || doc_id // 10000 AS k, concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'xx'), 'd' || doc_id // 10000, printf('%04d-note.md', doc_id % 10000)) AS path FROM documents),
            a AS (SELECT *, row_number() OVER (ORDER BY path) AS r0 FROM d),
            b AS (SELECT *, CASE WHEN r0 > 1 THEN row_number() OVER (PARTITION BY r0 = 1, k ORDER BY path) END AS r1 FROM a),
            c AS (SELECT *, CASE WHEN r1 > 1 THEN row_number() OVER (PARTITION BY coalesce(r1, 1) = 1, k, l ORDER BY path) END AS r2 FROM b),
            e AS (SELECT *, CASE WHEN r2 > 1 THEN row_number() OVER (PARTITION BY coalesce(r2, 1) = 1, k, l, s ORDER BY path) END AS r3 FROM c)
            SELECT path, CASE WHEN r0 = 1 THEN 'note' WHEN r1 = 1 THEN k || '-note' WHEN r2 = 1 THEN l || '-' || k || '-note'
            ELSE s || '-' || l || '-' || k || '-note' || CASE r3 WHEN 1 THEN '' WHEN 2 THEN '-2' ELSE '-' || (r3 + 2) END END AS id FROM e""",
        "url_origin": "SELECT page_id, lower(regexp_extract(url, '^https?://[^/?#]+')) AS origin FROM pages",
        "frontmatter_split": _over("f_md", "SELECT doc_id, has_fm, sha256(block) AS block_sha, sha256(body) AS body_sha FROM md", MD),
        "frontmatter_written": _over("f_docs", r"""SELECT doc_id, '---' || chr(10) || 'spec: 1' || chr(10) || 'id: ' || id || chr(10) || coalesce('kind: ' || kind || chr(10), '')
            || CASE WHEN len('describes: [' || array_to_string(g, ', ') || ']') <= 78 THEN 'describes: [' || array_to_string(g, ', ') || ']' ELSE 'describes:' || chr(10) || '  - ' || array_to_string(g, chr(10) || '  - ') END || chr(10)
            || 'owner: ' || CASE WHEN o = '' OR regexp_matches(o, '^[-?:,\[\]{}#&*!|>''"%@`]') OR regexp_matches(o, ':\s|\s#|:$') OR regexp_matches(o, '^-?[0-9]+([.][0-9]+)?$') THEN chr(39) || replace(o, chr(39), chr(39) || chr(39)) || chr(39) ELSE o END || chr(10)
            || coalesce('ttlDays: ' || ttl_days || chr(10), '') || 'supersedes: [' || coalesce(supersedes, '') || ']' || chr(10) || 'pin: ' || pin || chr(10) || '---' || chr(10) || chr(10) || 'Text.' || chr(10) AS raw FROM fo""",
            r"""fo AS (SELECT *, CASE WHEN len(body) % 3 = 0 THEN id || ': it''s ' ELSE '' END || array_to_string(regexp_split_to_array(regexp_replace(body, '^\s+|\s+$', '', 'g'), '\s+')[1:4], ' ') AS o, [path, 'src/**', 'workers/q' || doc_id || '/**', regexp_replace(path, '[.]md$', '/a-rather-long-name.ts')][1:len(body) % 4 + 1] AS g FROM f_docs)"""),
        "frontmatter_fields": _over("f_md", "SELECT m.doc_id, CASE WHEN has_fm THEN d.id END AS id, CASE WHEN has_fm THEN d.kind END AS kind, CASE WHEN has_fm THEN '[\"' || split_part(m.path, '/', 2) || '\", \"' || d.id || '\"]' END AS tags, CASE WHEN has_fm AND m.doc_id % 6 = 0 THEN '2001-02-30' END AS expires FROM md m JOIN f_docs d ON d.doc_id = m.doc_id".replace("f_docs d ON", "f_docs d ON"), MD),
        "frontmatter_errors": _over("f_md", "SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'expires: ''2001-02-30'' is not a date YYYY-MM-DD' ELSE '' END AS errors, CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS warnings FROM md WHERE has_fm", MD),
        "iso_date_valid": _over("f_docs", "SELECT doc_id, day, coalesce(try_cast(day AS DATE) IS NOT NULL, FALSE) AS valid FROM (SELECT doc_id, format('20{:02d}-{:02d}-{:02d}', doc_id % 30, doc_id % 14, doc_id % 33) AS day FROM f_docs)"),
        "order_dates_valid": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%d-%m') AS day, day(o_orderdate) <= 12 AS valid FROM orders",
        "slugify": "SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-')) AS slug_sha, regexp_matches(source, '^[a-z0-9][a-z0-9-]*$') AS is_slug, trim(regexp_replace(lower(lang || ' ' || source), '[^a-z0-9]+', '-', 'g'), '-') AS file_slug FROM documents",
        "human_tokens": "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a < 1000 THEN CAST(a AS BIGINT)::VARCHAR WHEN a < 100000 THEN regexp_replace(printf('%.1f', floor(a / 100 + 0.5) / 10), '[.]0$', '') || 'k' ELSE CAST(floor(a / 1000 + 0.5) AS BIGINT) || 'k' END AS small, CASE WHEN b < 1000 THEN CAST(b AS BIGINT)::VARCHAR WHEN b < 100000 THEN regexp_replace(printf('%.1f', floor(b / 100 + 0.5) / 10), '[.]0$', '') || 'k' ELSE CAST(floor(b / 1000 + 0.5) AS BIGINT) || 'k' END AS large FROM (SELECT *, floor(l_extendedprice * l_discount) AS a, floor(l_extendedprice * l_quantity) AS b FROM lineitem)",
        "field_near_miss": """WITH k AS (SELECT unnest(['spec', 'id', 'kind', 'describes', 'verify', 'owner', 'expires', 'ttlDays', 'supersedes', 'tags', 'pin']) AS f, unnest(range(11)) AS i),
            w AS (SELECT DISTINCT f || ['', 's', 'xx'][doc_id % 3 + 1] AS word FROM documents JOIN k ON i = doc_id % 11),
            n AS (SELECT word, f, i FROM w JOIN k ON levenshtein(lower(f), lower(word)) <= 1 WHERE word NOT IN (SELECT f FROM k)) SELECT word, (SELECT arg_min(f, i) FROM n WHERE n.word = w.word) AS near FROM w""",
        "suggest": """WITH o AS (SELECT unnest(['check', 'map', 'pack', 'init', 'handoff', 'doctor']) AS o, unnest(range(6)) AS i),
            w AS (SELECT DISTINCT ['chek', 'mpa', 'pakc', 'initt', 'handof', 'zzzzzzzz', 'doctr'][doc_id % 7 + 1] AS word FROM documents),
            s AS (SELECT word, arg_min(o, levenshtein(word, o) * 100 + i) AS o, min(levenshtein(word, o)) AS d FROM w, o GROUP BY word) SELECT word, CASE WHEN d <= greatest(2, len(word) // 2) THEN o END AS suggestion FROM s""",
        "source_index": _over("f_files", "SELECT * FROM sx", SOURCE),
        "mentions": _over("f_md", "SELECT path, mention FROM mn", MENTION),
        "mention_resolve": _over("f_md", """SELECT path, mention, file FROM (SELECT mn.path, mention, coalesce((SELECT f.path FROM f_files f WHERE f.path = m), (SELECT f.path FROM f_files f WHERE f.path = ts), (SELECT x.path FROM sx x WHERE x.suffix = m AND n = 1), (SELECT x.path FROM sx x WHERE x.suffix = ts AND n = 1)) AS file
            FROM (SELECT *, regexp_replace(mention, '^[.]/', '') AS m, regexp_replace(regexp_replace(mention, '^[.]/', ''), '[.]js$', '.ts') AS ts FROM mn) mn) WHERE file IS NOT NULL""", MENTION, SOURCE),
        "infer_kind": _over("f_md", "SELECT doc_id, ['guide', 'decision', 'handoff', 'runbook', 'spec', 'reference', 'decision'][doc_id % 7 + 1] AS kind FROM f_md"),
        "infer_describes": _over("f_docs f_files f_commit_files", """SELECT path, array_to_string(list_slice(flatten(list(gl ORDER BY n DESC, first)), 1, 6), ',') AS globs, CAST(sum(n) AS INTEGER) AS evidence FROM
            (SELECT path, dir, count(*) AS n, min(file) AS first, CASE WHEN count(*) >= 3 THEN [dir || '/**'] ELSE list_sort(list(file)) END AS gl FROM
            (SELECT DISTINCT o.path, f.path AS file, regexp_replace(f.path, '/[^/]*$', '') AS dir FROM f_commit_files o JOIN f_docs d ON d.path = o.path JOIN f_commit_files c ON c.sha = o.sha JOIN f_files f ON f.path = c.path) GROUP BY 1, 2) GROUP BY path"""),
        "relocation_vote": _over("f_renames", "SELECT glob, home, CAST(moved AS INTEGER) AS moved, CAST(lowest AS INTEGER) AS lowest, CAST(files AS INTEGER) AS files, tied FROM vt", LINKS),
        "relocations": _over("f_renames", "SELECT * FROM rl", LINKS, MOVES),
        "relocation_reason": _over("f_renames", """SELECT glob, '`' || glob || '` matches nothing now but once matched ' || files(file_count) || ' (the move is not committed yet).' ||
            CASE WHEN suggested IS NULL THEN CASE WHEN linked_count = 0 THEN ' None of them is linked to a file of today; they were deleted, or rewritten beyond recognition.'
              ELSE ' Only ' || linked_count || ' of them ' || CASE WHEN linked_count = 1 THEN 'is' ELSE 'are' END || ' linked to files of today, too few to name a new home.' END || ' No new pattern is suggested.'
            ELSE ' ' || moved_count || ' of ' || files(file_count) || ' now ' || CASE WHEN moved_count = 1 THEN 'stands' ELSE 'stand' END || ' at `' || suggested || '`' || CASE WHEN lowest_similarity IS NULL THEN '' ELSE ' (least alike: ' || lowest_similarity || '%)' END || '.'
              || CASE WHEN file_count > moved_count THEN ' ' || files((file_count - moved_count)) || ' could not be linked.' ELSE '' END || CASE WHEN extra_matches > 0 THEN ' The new pattern also matches ' || files(extra_matches) || ' that did not move there.' ELSE '' END END AS reason FROM rl""", LINKS, MOVES),
        "moved_hints": _over("f_docs f_files f_renames", """SELECT d.path, CASE WHEN rl.suggested IS NOT NULL THEN 'the code moved: change `describes` from `' || rl.glob || '` to `' || rl.suggested || '` and read the doc against it'
            ELSE '`describes` matches nothing (old/' || f.typ || '/**): point it at the moved code or delete the doc' END AS hint FROM f_docs d JOIN f_files f ON f.k = d.k LEFT JOIN rl ON rl.glob = 'old/' || f.typ || '/**'""", LINKS, MOVES),
        "doctor_populations": _reports("""SELECT CAST(count(*) AS INTEGER) AS docs, CAST(count(*) FILTER (WHERE r.doc_id % 4 <> 3) AS INTEGER) AS with_frontmatter, CAST(count(*) FILTER (WHERE len(describes) > 0) AS INTEGER) AS with_describes, 0 AS with_verify,
            CAST(count(*) FILTER (WHERE freshness NOT IN ('fresh', 'unverified')) AS INTEGER) AS not_fresh, CAST(count(*) FILTER (WHERE rl.suggested IS NOT NULL) AS INTEGER) AS relocated FROM r JOIN f_files f ON f.k = r.k LEFT JOIN rl ON rl.glob = 'old/' || f.typ || '/**'""", LINKS, MOVES, views=("f_renames",)),
        "doctor_report": _reports("""SELECT CAST(row_number() OVER (ORDER BY o, i) AS INTEGER) AS place, severity, title, fix FROM (
            SELECT CASE WHEN u > n / 2.0 THEN 1 ELSE 2 END AS o, 4 AS i, CASE WHEN u > n / 2.0 THEN 'major' ELSE 'minor' END AS severity, u || ' of ' || n || ' docs (' || CAST(round(100.0 * u / n) AS INTEGER) || '%) describe nothing' AS title, 'give them `describes`, or run init' AS fix FROM c WHERE u > 0
            UNION ALL SELECT 1, 6, 'major', (SELECT count(*) FROM di) || ' duplicate ids: ' || (SELECT string_agg(id, ', ' ORDER BY id) FROM (SELECT id FROM di ORDER BY id LIMIT 5)), 'rename all but one of each' WHERE (SELECT count(*) FROM di) > 0
            UNION ALL SELECT 1, 7, 'major', (SELECT count(*) FROM sd) || ' conflicts between docs', 'merge them, or let one supersede the other' WHERE (SELECT count(*) FROM sd) > 0
            UNION ALL SELECT CASE WHEN b > n / 3.0 THEN 1 ELSE 2 END, 8, CASE WHEN b > n / 3.0 THEN 'major' ELSE 'minor' END, b || ' docs are not fresh', 'run check for the next step of each' FROM c WHERE b > 0
            UNION ALL SELECT 2, 11, 'minor', 'no configuration file; defaults are used', 'run init with --yes for one' UNION ALL SELECT 2, 12, 'minor', 'no doc names a command that verifies it', 'add `verify` to the docs that matter most')""", IDS, SAME, COUNTS),
        "unverified_without_history": _reports("SELECT d.path, 'unverified' AS freshness, 50 AS score, CAST(coalesce(len(c.describes), 0) AS INTEGER) AS claims FROM f_docs d LEFT JOIN claims c ON c.path = d.path"),
        "folder_claims": _over("f_files", "SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS glob, regexp_replace(path, '/[^/]*$', '') AS path FROM f_files"),
        "folder_history": _over("f_files f_commits f_commit_files", "SELECT folder, max(struct_pack(ts := c.author_ts, sha := c.sha, subject := c.subject)).sha AS sha FROM (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM f_files) f JOIN f_commit_files cf ON starts_with(cf.path, folder || '/') JOIN f_commits c ON c.sha = cf.sha GROUP BY folder"),
        "counts_map": _reports("SELECT string_agg(freshness || '=' || n, ',' ORDER BY severity) AS counts FROM (SELECT k.freshness, k.severity, count(r.path) AS n FROM k LEFT JOIN r ON r.freshness = k.freshness GROUP BY 1, 2)", KNOWN),
        "verify_gate": _reports("SELECT path, freshness FROM r WHERE freshness IN ('stale', 'expired', 'orphaned') OR len(body) % 10 = 0"),
        "withheld_by_trust": _reports("SELECT path, freshness FROM (SELECT r.path, freshness FROM r JOIN rel USING (path) WHERE relevance > 0 ORDER BY relevance DESC, score DESC, r.path LIMIT 50) WHERE freshness NOT IN ('fresh', 'unverified', 'drifting') ORDER BY path LIMIT 20", RELEVANCE),
        "map_entries": _reports("SELECT coalesce(kind, 'unclassified') AS key, CAST(row_number() OVER (PARTITION BY coalesce(kind, 'unclassified') ORDER BY k.severity DESC, tokens DESC, path) AS INTEGER) AS place, path, tokens FROM (SELECT *, " + _estimate("body") + " AS tokens FROM r) t JOIN k ON k.freshness = t.freshness", KNOWN),
        "map_heat": _reports("""SELECT key, repeat('X', share(6)) || repeat('O', share(5)) || repeat('E', share(4)) || repeat('S', share(3)) || repeat('D', share(2)) || repeat('U', share(1)) || repeat('F', share(0)) AS strip,
            repeat('#', least(20, CAST(floor(n0 * 20.0 / n + 0.5) AS INTEGER))) || repeat('.', 20 - least(20, CAST(floor(n0 * 20.0 / n + 0.5) AS INTEGER))) AS fresh FROM h""", KNOWN, "h AS (SELECT regexp_replace(path, '/[^/]*$', '') AS key, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE severity = {i}) AS n{i}" for i in range(7)) + " FROM r JOIN k USING (freshness) GROUP BY 1)"),
        "freshness_table": _reports(f"SELECT path, freshness, score, CASE WHEN place <= 10 AND freshness NOT IN ('fresh', 'unverified') THEN evidence END AS evidence FROM (SELECT r.*, {EVIDENCE} AS evidence, row_number() OVER (ORDER BY k.severity DESC, score, path) AS place FROM r JOIN k USING (freshness))", KNOWN),
        "evidence_lines": _reports(f"SELECT path, {EVIDENCE} AS evidence FROM r"),
        "report_lookup": _reports("SELECT path, freshness, score FROM r WHERE path = (SELECT max(path) FROM f_docs)"),
        "tool_glob": _over("f_files", "SELECT path FROM f_files WHERE regexp_matches(path, '^src/s[^/]*l/(.*/)?[^/]*5[.]ts$')"),
        "tool_glob_folder": _over("f_files", "SELECT path FROM f_files WHERE path = 'src/small' OR starts_with(path, 'src/small/')"),
        "handoff_tiers": _reports("""SELECT CAST(row_number() OVER (ORDER BY tier, files DESC, score DESC, path) AS INTEGER) AS place, path, CAST(tier AS INTEGER) AS tier, CAST(files AS INTEGER) AS files FROM
            (SELECT * FROM named UNION ALL (SELECT r.path, 2, 0, r.score FROM r JOIN rel USING (path) WHERE relevance > 0 AND r.path <> 'docs/src1/80.md' AND r.path NOT IN (SELECT path FROM named) ORDER BY relevance DESC, r.score DESC, r.path LIMIT 5))""", *COVER, RELEVANCE,
            """named AS (SELECT path, CASE WHEN path IN (SELECT path FROM cov) THEN 0 ELSE 1 END AS tier, coalesce((SELECT max(len(files)) FROM cov WHERE cov.path = r.path), 0) AS files, score FROM r WHERE path <> 'docs/src1/80.md' AND (path IN (SELECT path FROM cov) OR path IN (SELECT path FROM f_docs WHERE pin)))"""),
        "handoff_age": _over("f_docs f_commits", f"SELECT path, age AS age_days, ttl AS ttl_days, coalesce(age > ttl, FALSE) AS expired FROM (SELECT d.path, CAST(floor((epoch_ms({CLOCK}) - epoch_ms(c.author_ts)) / 86400000.0) AS INTEGER) AS age, coalesce(ttl_days, 7) AS ttl FROM f_docs d JOIN f_commits c ON c.sha = CAST(d.doc_id AS VARCHAR) WHERE kind = 'handoff')"),
        "status_words": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'modified' WHEN 'O' THEN 'added' WHEN 'P' THEN 'renamed' ELSE o_orderstatus END || '/' || left(o_orderpriority, 1) || '/untracked' AS words FROM orders",
        "note_bullets": _over("f_docs", r"""SELECT doc_id, CAST(len(b) AS INTEGER) AS n, sha256(array_to_string(b, '|')) AS bullets_sha FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(body, '([.?!])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), '\n|\x01'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS b FROM f_docs)"""),
        "date_order": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderpriority < '1996-01-01' THEN -1 WHEN o_orderpriority > '1996-01-01' THEN 1 ELSE 0 END WHEN CAST(o_orderdate AS DATE) < DATE '1996-01-01' THEN -1 WHEN CAST(o_orderdate AS DATE) > DATE '1996-01-01' THEN 1 ELSE 0 END AS sign FROM orders",
        "display_width": _over("f_docs", f"SELECT doc_id, CAST(len(x) + len(x) - len(regexp_replace(x, '[{CJK}]', '', 'g')) AS INTEGER) AS width, CAST(5 + len(path) AS INTEGER) AS coloured FROM (SELECT doc_id, path, regexp_replace(body, '[\\x00-\\x1f\\x7f-\\x{{9f}}]', '', 'g') AS x FROM f_docs)"),
        "display_cut": _over("f_docs", """SELECT doc_id, CASE WHEN len(w) <= 30 THEN w ELSE left(w, 29) || '…' END AS cut, '…/' || list_filter(list_transform(range(1, 10), lambda i: array_to_string(list_slice(string_split('a/long/way/down/' || path, '/'), i, 9), '/')), lambda t: len(t) <= 22)[1] AS path, rpad(kind, 12, ' ') AS padded
            FROM (SELECT *, concat_ws(' ', path, id, kind) AS w FROM f_docs)"""),
        "display_wrap": _over("f_docs", "SELECT doc_id, CAST(ceil(len(path) / 8.0) AS INTEGER) AS pieces, CASE WHEN len(concat_ws(' ', id, kind, path)) <= 30 THEN concat_ws(' ', id, kind, path) ELSE concat_ws(' ', id, kind) || '|' || path END AS lines FROM f_docs"),
        "pack_left_out": _reports(f"""SELECT path, CASE WHEN excluded THEN 'excluded as ' || freshness || '; ask for stale documents to include it' WHEN {BUDGET} - total + cost <= 0 THEN 'the budget was used up ({BUDGET} tokens); rank ' || printf('%.3f', rank)
            ELSE 'needs about ' || cost || ' tokens, ' || CAST({BUDGET} - total + cost AS BIGINT) || ' of {BUDGET} tokens were left' END AS why FROM (SELECT path, freshness, excluded, rank, cost, total FROM ps UNION ALL SELECT path, freshness, excluded, rank, cost, 0 FROM pk WHERE excluded) WHERE excluded OR (total > {BUDGET} AND {BUDGET} - total + cost < 400)""", PACK),
        "fnv1a_shingles": _over("f_docs", "SELECT doc_id, CASE WHEN len(ws) >= 40 THEN sha256(array_to_string(list_sort(hs), ',')) END AS hashes_sha, CASE WHEN len(ws) >= 40 THEN CAST(len(hs) AS INTEGER) END AS n FROM f_docs d JOIN fv USING (path)", HASHES),
        "minhash_sketch": _over("f_docs", "SELECT doc_id, CASE WHEN len(ws) >= 40 THEN array_to_string(list_sort(hs)[1:64], ',') END AS sketch FROM f_docs d JOIN fv USING (path)", HASHES),
        "sketch_similarity": _over("f_docs", """SELECT doc_id, round(len(list_filter(u, lambda h: list_contains(a, h) AND list_contains(b, h))) * 1.0 / k, 6) AS similarity FROM (SELECT doc_id, a, b, k, list_sort(list_distinct(list_concat(a, b)))[1:k] AS u
            FROM (SELECT x.doc_id, x.s AS a, y.s AS b, least(len(x.s), len(y.s)) AS k FROM sk x JOIN sk y ON y.doc_id = x.doc_id + 1))""", HASHES, "sk AS (SELECT doc_id, list_sort(hs)[1:64] AS s FROM f_docs JOIN fv USING (path) WHERE len(ws) >= 40)"),
    }
    for key, by in (("kind", "coalesce(kind, 'unclassified')"), ("freshness", "freshness"), ("dir", "regexp_replace(path, '/[^/]*$', '')")):
        out[f"map_by_{key}"] = _reports(f"SELECT {by} AS key, CAST(count(*) AS INTEGER) AS docs, CAST(sum({_estimate('body')}) AS BIGINT) AS tokens FROM r GROUP BY 1")
    out["conflicts_ordered"] = out["conflicts_all"].replace("SELECT 'duplicate-id' AS kind", "SELECT CAST(row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, CASE kind WHEN 'duplicate-id' THEN 0 ELSE 2 END, docs, detail) AS INTEGER) AS place, kind, severity, docs FROM (SELECT 'duplicate-id' AS kind") + ")"
    for i in range(7):
        out["map_heat"] = out["map_heat"].replace(f"share({i})", f"CASE WHEN n <= 24 THEN n{i} WHEN n{i} = 0 THEN 0 ELSE greatest(1, CAST(floor(n{i} * 24.0 / n + 0.5) AS BIGINT)) END")
    out["relocation_reason"] = re.sub(r"files\((\w+|\([^()]*\))\)", r"\1 || CASE WHEN \1 = 1 THEN ' file' ELSE ' files' END", out["relocation_reason"])
    # glob is a keyword there
    return {k: re.sub(r"(?<![\w\"'/])glob(?![\w(\"])", '"glob"', sql) for k, sql in out.items()}
