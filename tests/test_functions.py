"""Globs, tokens, front matter and other functions on small truths."""

import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from florilege.functions import frontmatter as FM
from florilege.functions import globs as G
from florilege.functions import text as T
from florilege.operators import conflicts as C
from florilege.operators import globjoin as GJ
from florilege.sources import config as CF

GLOBS = [
    ("src/**/*.ts", "src/a.ts", True), ("src/**/*.ts", "src/a/b/c.ts", True), ("src/**/*.ts", "lib/a.ts", False), ("*.md", "x.md", True), ("*.md", "docs/x.md", False),
    ("**/*.md", "x.md", True), ("**/*.md", "docs/x.md", True), ("src/**", "src", True), ("src/**", "src/a/b", True), ("src/**", "srcs/a", False), ("src/", "src/a/b", True),
    ("**/node_modules/**", "a/node_modules/b", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("a[!b]c", "adc", True), ("a[!b]c", "abc", False), ("a[^/]c", "a/c", False),
    ("a[b", "a[b", True), ("a{b,c}{d,e}", "ace", True), ("{src/a,b}/x.ts", "b/x.ts", True), ("{a}", "{a}", True), ("{a", "{a", True), ("a.b", "axb", False), ("./src//x", "src/x", True),
    ("/src/x", "src/x", True), ("[z-a]", "z", False), ("a**b", "aXb", True), ("a**b", "a/b", False), ("", "x", False), ("**", "any/thing", True), ("a[&&b]", "a&", True), ("x\\y", "x/y", True), ("a+b", "a+b", True),
]


@pytest.mark.parametrize("glob,path,want", GLOBS)
def test_glob(glob, path, want):
    assert G.matches(glob, path) == want


def test_globs_mean_the_same_to_spark(spark):
    df = spark.createDataFrame([(G.to_regex(g), G.normalize_path(p), w) for g, p, w in GLOBS if g], "rx string, p string, want boolean")
    assert df.where(F.regexp_like("p", F.col("rx")) != F.col("want")).count() == 0


def test_other_dialects_and_keys():
    import re

    match = lambda rx, p: bool(re.search(rx.replace("\\z", "\\Z"), p))
    assert match(G.tool_regex("src/auth"), "src/auth/x.ts") and not match(G.tool_regex("src/auth"), "src/authx")
    assert match(G.tool_regex("**/*.ts"), "a.ts") and match(G.tool_regex("**/*.ts"), "b/a.ts") and not match(G.tool_regex("*.ts"), "b/a.ts")
    assert match(G.handoff_regex("src/**"), "src/x/y") and match(G.handoff_regex("src/**/a.ts"), "src/xa.ts")
    assert G.join_key("src/**/17.ts") == ("name", "17.ts") and G.join_key("lib/gone/**") == ("folder", "lib/gone") and G.join_key("a//b.ts") == ("path", "a/b.ts") and G.join_key("**/*.ts")[0] == "none"
    assert G.split_fixed("src/auth/**") == ("src/auth/", "**", False) and G.split_fixed("src/a.ts") == ("src/a.ts", "", True)
    assert len(G.expand("{" + ",".join("ab") + "}" * 1 + "{c,d}")) == 4 and G.expand("{a,b}{c,d}{e,f}{g,h}{i,j}{k,l}{m,n}") == ["{a,b}{c,d}{e,f}{g,h}{i,j}{k,l}{m,n}"]


def one(spark, expr, **cols):
    row = {k: v for k, v in cols.items()}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in row.items())).select(expr).first()[0]


def test_token_estimate_equals_the_plain_fold(spark):
    r = random.Random(1)
    bits = ["word", "longerwordhere", "=>", "::", "日本", "é", "\n", "\n\n", "```py\n", "```\n", "~~~\n", "    x = 1\n", "\tgo", " ", "# Head\n", "a_b", "12345678"]
    texts = ["", " \n", "a", "```\nopen"] + ["".join(r.choice(bits) for _ in range(r.randint(1, 40))) for _ in range(150)]
    got = [x.t for x in spark.createDataFrame(list(enumerate(texts)), "i int, x string").orderBy("i").select(T.token_estimate(F.col("x")).alias("t")).collect()]
    want = [FM.estimate(t) for t in texts]
    wrong = [(t, g, w) for t, g, w in zip(texts, got, want, strict=True) if g != w]
    assert not wrong, wrong[:3]


def test_stems(spark):
    words = {"caching": "cach", "cache": "cach", "running": "run", "run": "run", "policies": "policy", "classes": "clas", "boxes": "box", "cases": "cas", "status": "status", "bus": "bus", "based": "bas", "is": "is", "ties": "tie"}
    got = spark.createDataFrame([(k,) for k in words], "w string").select("w", T.stem(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in got} == words


def test_headings_and_titles(spark):
    body = "intro\n```sh\n# no\n```\n## Set up ##\n# Main title\ntext\n#nospace\n~~~\n# no\n~~~\n### Deep"
    found = one(spark, F.to_json(T.headings(F.col("b"))), b=body)
    assert found == '[{"level":2,"text":"Set up"},{"level":1,"text":"Main title"},{"level":3,"text":"Deep"}]'
    assert one(spark, T.doc_title(F.lit("d/api-reference.md"), T.headings(F.col("b"))), b=body) == "Main title"
    assert one(spark, T.filename_title(F.col("p")), p="docs/api-reference_v2.md") == "Api Reference V2" and one(spark, T.filename_title(F.col("p")), p="README.md") == "README"


def test_small_formats(spark):
    for n, want in ((999, "999"), (1000, "1k"), (1550, "1.6k"), (99_999, "100k"), (250_400, "250k")):
        assert one(spark, T.human_tokens(F.col("n")), n=n) == want
    assert one(spark, T.join_sample(F.split("s", ",")), s="a,b,c,d,e") == "a, b, c (+2 more)"
    assert one(spark, T.ago(F.col("n")), n=1) == "1 day ago" and one(spark, T.ago(F.col("n")), n=-3) == "today"
    assert one(spark, T.iso_date(F.col("d")), d="2024-02-29") and not one(spark, T.iso_date(F.col("d")), d="2026-02-30")
    assert one(spark, T.fnv1a(F.col("t")), t="foobar") == 0xBF9CF968
    assert one(spark, T.quote_line(F.col("t"), 5), t="a  b\tcdefg") == "a b ..."


def test_front_matter_cases(spark):
    raws = ["---\nid: a\n---\nbody", "﻿---\r\nid: a\r\n...\r\n\r\nbody\r\n", "---\nid: a\nno end", "plain", "", "---\n---\nx", "----\nid: a\n---\n"]
    df = FM.split(spark.createDataFrame(list(enumerate(raws)), "i int, raw string"))
    got = [(r.has_fm, r.body) for r in df.orderBy("i").collect()]
    assert got == [(True, "body"), (True, "body\n"), (False, raws[2]), (False, "plain"), (False, ""), (True, "x"), (False, raws[6])]
    text = "a: 1\nb: [x, 'y, z', {k: v}]\nc:\n  - one\n  - \"t\\n\"\nd: 2026-01-01 # note\ne: ~\nf:\n  g: true\n  h: no\n# c\nbad line\n i: stray\nj: -2.5"
    assert FM.parse(text) == {"a": 1, "b": ["x", "y, z", {"k": "v"}], "c": ["one", "t\n"], "d": "2026-01-01", "e": None, "f": {"g": True, "h": "no"}, "j": -2.5}


def test_validation():
    errors, warnings, value = FM.validate({"spec": 1, "id": "Not A Slug", "kind": "novel", "describes": "src/**", "expires": "2026-02-30", "ttlDays": 0, "pin": "yes", "tag": ["x"], "tags": ["a", " "]})
    assert {e.split(":")[0] for e in errors} == {"id", "kind", "expires", "ttlDays", "pin"}
    assert value == {"spec": 1, "describes": ["src/**"], "tags": ["a"]} and any("did you mean tags" in w for w in warnings)
    assert FM.validate({"id": "ok"}) == ([], [], {"id": "ok"}) and FM.validate({"spec": 1})[0] == ["id: missing"]


scalars = st.one_of(st.booleans(), st.none(), st.integers(-(10**6), 10**6), st.text(st.characters(blacklist_categories=("Cs", "Cc"), blacklist_characters="  \x85\xa0　"), max_size=20))


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.from_regex(r"[a-z][a-z0-9_]{0,8}", fullmatch=True), st.one_of(scalars, st.lists(scalars, min_size=1, max_size=4)), max_size=5))
def test_what_is_written_reads_back(data):
    out = FM.write(data, "body")
    block = out[4 : out.index("\n---\n\n") + 1] if data else ""
    assert FM.parse(block) == data


def test_front_matter_written_by_rows_reads_back(spark):
    data = [{"id": "a", "tags": ["x: y", "it's", "- z", "true", "12"], "owner": "# no comment"}, {"id": "b", "describes": [f"src/folder-{i}/**" for i in range(9)], "pin": True}, {}]
    df = spark.createDataFrame([(json.dumps(d), "Body.\n") for d in data] + [(None, "x"), ("{}", None)], "data string, body string")
    found = [r.raw for r in df.select(FM.written(F.col("data"), F.col("body")).alias("raw")).collect()]
    assert found == [FM.write(d, "Body.\n") for d in data] + [None, None]
    for raw, d in zip(found[:2], data, strict=False):
        assert FM.parse(raw[4 : raw.index("\n---\n\n") + 1]) == d and raw.endswith("\n---\n\nBody.\n")


def test_facts(spark):
    body = "PORT=8080\nexport API_URL=\"https://Api.example.com/v1\"\n`DEBUG=true`\nset FOO = whatever you like\nKEY=<your-key>\nnpm run dev and yarn test and npm install x\nlocalhost:3000 or 127.0.0.1:5432\nNode 18 is used\nnode >= 20\npython 3.11\nbase url: https://x.org/a?b\nPORT=8080"
    df = spark.createDataFrame([("a.md", body)], "path string, body string")
    got = {(r.key, r.value, r.line) for r in C.facts(df).collect()}
    assert got == {
        ("env:PORT", "8080", 1), ("env:API_URL", "https://api.example.com", 2), ("url:api", "https://api.example.com", 2), ("env:DEBUG", "true", 3), ("script:dev", "npm", 6), ("script:test", "yarn", 6), ("net:localhost-port", "3000", 7),
        ("net:localhost-port", "5432", 7), ("version:node", "18", 8), ("version:python", "3.11", 10), ("url:base", "https://x.org", 11), ("env:PORT", "8080", 12),
    }
    assert {r.key for r in C.asserted(C.facts(df)).collect()} == {k for k, *_ in got} - {"net:localhost-port"}


def test_conflicts_abstain(spark):
    rows = [
        ("a.md", "a", [], "PORT=1\n"), ("b.md", "b", [], "PORT=2\n"), ("old/c.md", "c", [], "PORT=3\n"), ("d.md", "d", [], "PORT=4\n"), ("e.md", "e", ["d"], "PORT=1\nPORT=5\n"), ("f.md", " a ", [], "x"),
    ]
    df = spark.createDataFrame(rows, "path string, id string, supersedes array<string>, body string")
    assert [(r.key, r.values, r.paths) for r in C.contradictions(df).select("key", F.col("values"), "paths").toDF("key", "values", "paths").collect()] == [("env:PORT", ["1", "2"], ["a.md", "b.md"])]
    assert [(r.id, r.paths) for r in C.duplicate_ids(df).collect()] == [("a", ["a.md", "f.md"])]


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(8)
    base = [f"w{r.randrange(400)}" for _ in range(120)]
    docs = []
    for i in range(25):
        w = list(base) if i % 2 else [f"v{r.randrange(900)}" for _ in range(90)]
        for _ in range(r.randrange(0, 8)):
            w[r.randrange(len(w))] = f"x{r.randrange(9)}"
        docs.append((f"d{i:02}.md", " ".join(w)))
    sh = {p: {" ".join(b.split()[i : i + 5]) for i in range(len(b.split()) - 4)} for p, b in docs}
    want = {(a, b): len(sh[a] & sh[b]) / len(sh[a] | sh[b]) for a in sh for b in sh if a < b and len(sh[a] & sh[b]) / len(sh[a] | sh[b]) > 0.8}
    got = {(x.a, x.b): x.jaccard for x in C.near_duplicates(spark.createDataFrame(docs, "path string, body string")).collect()}
    same = {b: min(p for p, t in docs if t == dict(docs)[b]) for b in sh}
    want = {k: v for k, v in want.items() if all(same[x] == x for x in k)}
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_config(tmp_path):
    c = CF.merged({"include": ["d/**"], "exclude": ["x/**"], "staleDriftDays": 10, "warnDriftDays": 30, "failOn": ["stale", "nope"], "staleCommitCount": -1, "zzz": 1})
    assert c.include == ("d/**",) and c.exclude[-1] == "x/**" and len(c.exclude) > 10 and c.warn_drift_days == 10 and c.fail_on == ("stale",) and c.stale_commit_count == 10 and len(c.warnings) == 4
    assert CF.merged({"failOn": []}).fail_on == ()
    (tmp_path / ".git").mkdir()
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / CF.FILES[0]).write_text("{ broken")
    assert CF.repo_root(str(tmp_path / "a/b")) == str(tmp_path) and CF.load(str(tmp_path)).warnings
    assert CF.safe_path(str(tmp_path), "a/b").endswith("a/b")
    with pytest.raises(ValueError):
        CF.safe_path(str(tmp_path), "../x")


def test_keyed_glob_join_equals_every_pair(spark):
    from florilege.operators import globjoin

    r = random.Random(5)
    parts = ["src", "a", "*", "**", "a.ts", "*.ts", "*.[tj]s", "[.]ts", "*.{ts,js}", "?.d.ts", "x*.", ".ts", "[!.]*.ts", "{a,src}", "*[.ts", "*[a.ts]", "b]", "."]
    names = ["src", "a", "b", "a.ts", "b.ts", "x.d.ts", ".ts", "a.js", "x.", "q[.ts", "b]", "ts", "é.ts"]
    globs = sorted({"/".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(250)})
    paths = sorted({G.normalize_path("/".join(r.choice(names) for _ in range(r.randint(1, 3)))) for _ in range(120)})
    found = globjoin.match(spark.createDataFrame([(g,) for g in globs], "glob string"), spark.createDataFrame([(p,) for p in paths], "path string"))
    got = {(x.glob, x.path) for x in found.collect()}
    assert got == {(g, p) for g in globs for p in paths if G.matches(g, p)}


def test_loose_globs_equal_every_pair(spark):
    rng = random.Random(11)
    names = ["a", "ab", "abc", "xay", "[x]", "x-y.ts", "b.md", "世界", "a*b", "x?"]
    paths = sorted({"/".join(rng.choices(names, k=rng.randrange(1, 5))) for _ in range(300)} | {"", "/a", "a//b"})
    parts = ["**", "*", "?", "*a*", "x*y", "[ab]*", "[!a]?*", "[x", "{a,b}*", "*{b,**/c}", "ab*", "*y*", "世*", "*.{ts,md}", "a**b", "{,a}*"]
    globs = sorted({"/".join(["**", *rng.choices(parts, k=rng.randrange(1, 4))]) for _ in range(250)} | {"**", "*", "**/*", "*/*", "./*a", "*a/", "**/x?y**/**", "*//a*"})
    rows = spark.createDataFrame([(g, G.to_regex(g), k) for g in globs for k in G.gram_keys(g)], "glob string, rx string, grams array<string>")
    found = GJ.by_grams(rows, spark.createDataFrame([(p,) for p in paths], "path string"))
    got = {(r.glob, r.path) for r in found.collect()}
    want = {(g, p) for g in globs for p in paths if re.search(G.to_regex(g).replace("\\z", "\\Z"), p, re.S)}
    assert got == want and len(want) > 1000


def test_many_globs_with_letters(spark):
    globs = spark.createDataFrame([(f"**/x{i}*y/**",) for i in range(50)], "glob string")
    paths = spark.range(2000).selectExpr("concat('p/x', id % 70, 'q', id, 'y/z') as path")
    found = GJ.match(globs, paths)
    assert found.count() == sum(1 for i in range(2000) for g in range(50) if f"x{i % 70}q{i}y".startswith(f"x{g}"))
    assert all(len(k[0]) > 0 for k in (G.gram_keys(f"**/x{i}*y/**") for i in range(50)))


def test_runs_hold_all_words_and_pairs_of_some_stems(spark):
    rng = random.Random(3)
    ends = ["", "s", "es", "ies", "sses", "ing", "ed", "e", "tt", "nned", "sing", "eed", "us", "is", "ss", "ches", "xes", "zes", "ses", "y", "yy", "99"]
    terms = ["ab", "sy", "st", "tay", "bas", "a9", "ss", "ts"]
    words = [(rng.choice(terms) if rng.random() < 0.6 else "".join(rng.choices("abst9", k=rng.randrange(0, 4)))) + rng.choice([*ends, "", "", "s"]) for _ in range(4000)]
    texts = [rng.choice([" ", "-", "\n", " a ", ". É x_"]).join(words[i : i + 8]) for i in range(0, 4000, 8)] + ["", None, " a b ", "A", "ab b ab", "abs-ab"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    runs = T.runs_about(F.col("t"), terms)
    rows = df.select(T.tokenize(F.col("t")).alias("all"), runs.alias("runs"), F.flatten(F.transform(runs, T.pairs)).alias("pairs"), T.token_count(F.col("t")).alias("n")).collect()
    some = 0
    for r in rows:
        assert r.n == len(r.all)
        assert [w for run in r.runs for w in run if w in terms] == [w for w in r.all if w in terms]
        want = {f"{a} {b}" for a, b in zip(r.all, r.all[1:]) if a in terms and b in terms}
        assert {p for p in r.pairs if set(p.split()) <= set(terms)} == want
        some += len(want)
    assert some > 20
