"""The registered queries over the fixture corpus, one for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.dims import FRONT_FIELDS, Config
from florilege.functions import cutting as CUT
from florilege.functions import display as D
from florilege.functions import frontmatter as FM
from florilege.functions import text as T
from florilege.operators import clusters as CL
from florilege.operators import conflicts as C
from florilege.operators import freshness as FR
from florilege.operators import globjoin as GJ
from florilege.operators import inference as I
from florilege.operators import ranking as R
from florilege.operators import relocation as RL
from florilege.operators import reports as RP
from florilege.sources import files as FS
from florilege.sources.fixtures import NOW, Fixtures
from florilege.sources.tables import stored

TASK = "the content of those and erand with reanthe thing for doc-80"
PLAIN_TASK = "tion reing thand onhe"
BUDGET = 8000
now = lambda: F.lit(NOW).cast("timestamp")


def _joined(c: str):
    return F.array_join(c, ",")


def _docs(fx: Fixtures) -> DataFrame:
    d = fx.docs
    return d.withColumn("supersedes", F.when(F.col("supersedes").isNotNull(), F.array("supersedes")).otherwise(F.array().cast("array<string>")))


def _globs(fx: Fixtures) -> DataFrame:
    return fx.doc_globs.join(fx.docs.select("doc_id", "path"), "doc_id").select("path", "ord", "glob")


def _assessed(fx: Fixtures, docs: DataFrame) -> DataFrame:
    return FR.assess(docs, _globs(fx), fx.files, fx.commits, fx.commit_files, now())


def _reports(fx: Fixtures) -> DataFrame:
    return _assessed(fx, _docs(fx))


def _scored(fx: Fixtures) -> DataFrame:
    """Documents with their relevance to the task in place of their texts, which are read once, where they lie."""
    return stored(R.relevance(_docs(fx), TASK).drop("body"))


def _md(fx: Fixtures) -> DataFrame:
    """Markdown documents with body, id, kind and headings."""
    md = FM.split(fx.md.select("doc_id", "path", "raw"))
    return md.withColumn("headings", T.headings(F.col("body")))


def scan_docs(fx):
    return FS.describe(fx.md.select("path", "raw")).select("path", "has_fm", "id", "kind", "title", "word_count", _joined("tags").alias("tags"))


def glob_filter(fx):
    return fx.files.where(F.col("path").rlike(GJ.G.to_regex("src/{small,economy}/**/*[05].ts"))).select("path")


def glob_resolve(fx):
    return GJ.resolve(_globs(fx), fx.files).select("path", "glob", "file")


def missing_globs(fx):
    return GJ.missing(_globs(fx), fx.files).select("path", "glob")


def loose_globs(fx):
    """Globs without a fixed name, folder or ending, made of the files' own types and brands."""
    typ, brand = F.split_part("path", F.lit("/"), F.lit(2)), F.split_part("path", F.lit("/"), F.lit(3))
    some = F.array(F.concat(F.lit("**/"), F.left(typ, F.lit(3)), F.lit("*/**")), F.concat(F.lit("**/*"), F.right(brand, F.lit(2)), F.lit("/*")), F.concat(F.lit("*/{"), typ, F.lit(",x?y}/*")), F.lit("*/*/*"))
    return GJ.match(fx.files.select(F.explode(some).alias("glob")).distinct(), fx.files)


def path_normalize(fx):
    raw = F.concat(F.lit("./"), F.regexp_replace("path", "/", "//"), F.lit("/"))
    return fx.files.select(raw.alias("raw"), GJ.G.normalized(raw).alias("path"))


def doc_last_commit(fx):
    own = FR.doc_last_commit(_docs(fx), fx.commits, fx.commit_files)
    return own.select("path", F.unix_seconds("commit.ts").alias("ts"), F.col("commit.sha").alias("sha"))


def code_last_commit(fx):
    code = FR.code_last_commit(GJ.resolve(_globs(fx), fx.files), fx.commits, fx.commit_files)
    return code.select("path", F.unix_seconds("commit.ts").alias("ts"), F.col("commit.sha").alias("sha"))


def commits_since(fx):
    own = FR.doc_last_commit(_docs(fx), fx.commits, fx.commit_files)
    since = FR.commits_since(GJ.resolve(_globs(fx), fx.files), own, fx.commits, fx.commit_files)
    return since.select("path", "commits_since", F.array_join(F.slice("changed", 1, 20), ",").alias("changed"))


def superseded(fx):
    return FR.superseded(_docs(fx)).select("id", _joined("superseded_by").alias("superseded_by"))


def _ships(fx):
    """Lines with the days from order to shipping, and a quantity, as if they were a document's drift and commits."""
    both = fx.table("lineitem").join(fx.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select("l_orderkey", "l_linenumber", "l_partkey", F.datediff("l_shipdate", "o_orderdate").alias("days"), F.col("l_quantity").cast("int").alias("commits"))


def drift_score(fx):
    return _ships(fx).select("l_orderkey", "l_linenumber", "l_partkey", F.round(FR.drift_score(F.col("days"), F.col("commits"), Config()), 6).alias("drift_score"))


def freshness_ladder(fx):
    return _ships(fx).select("l_orderkey", "l_linenumber", "l_partkey", FR.ladder(F.col("days"), F.floor(F.col("commits") / 4), Config()).alias("verdict"))


def expired_docs(fx):
    d = _docs(fx)
    return FR.expired(d, FR.doc_last_commit(d, fx.commits, fx.commit_files), now())


def freshness_verdict(fx):
    return _reports(fx).select("doc_id", "path", "freshness", "score", "drift_days", "commits_since", "matched", F.size("missing").alias("missing"))


def verdict_counts(fx):
    return RP.verdict_counts(_reports(fx))


def check_gate(fx):
    return RP.gate(_reports(fx)).select("path", "freshness", "score")


def min_freshness(fx):
    return RP.worst_acceptable(_reports(fx), "drifting").select("path", "freshness")


def fix_hints(fx):
    r = _reports(fx)
    return r.select("path", FR.fix_hint(r).alias("hint"))


def reason_strings(fx):
    r = _reports(fx)
    return r.select("path", FR.reason(r, now(), Config()).alias("reason"))


def map_by_kind(fx):
    return RP.map_by(_reports(fx), "kind")


def map_by_freshness(fx):
    return RP.map_by(_reports(fx), "freshness")


def map_by_dir(fx):
    return RP.map_by(_reports(fx), "dir")


def doctor_counts(fx):
    return RP.doctor_counts(_reports(fx))


def doctor_findings(fx):
    d = _docs(fx)
    return RP.findings(RP.doctor_counts(_reports(fx)), C.duplicate_ids(d), C.all_conflicts(d))


def _changed(fx):
    """Files of the ten newest commits, as if not yet committed."""
    newest = fx.commits.where("author_ts is not null").orderBy(F.desc("author_ts"), F.desc("sha")).limit(10)
    # ten rows: sent to the lines, so that only these commits' are told apart
    return fx.commit_files.join(F.broadcast(newest.select("sha")), "sha", "left_semi").join(fx.files.select("path"), "path", "left_semi").select("path").distinct()


def handoff_cover(fx):
    changed = _changed(fx)
    return RP.covered(_globs(fx), changed).select("path", _joined("files").alias("files"))


def token_estimate(fx):
    return fx.docs.select("doc_id", T.token_estimate(F.col("body")).alias("tokens"))


def token_estimate_markdown(fx):
    return fx.md.select("doc_id", T.token_estimate(F.col("raw")).alias("tokens"))


def word_count(fx):
    return fx.docs.select("doc_id", T.word_count(F.col("body")).alias("words"))


def content_hash(fx):
    return fx.docs.select("doc_id", T.content_hash(F.col("body")).alias("content_hash"))


def _described_parts(fx):
    """Parts as documents: some with a title, some with a lower heading first, some with none; code holds what is no heading."""
    size = F.col("p_size")
    rest = F.concat(F.lit("## "), "p_type", F.lit(" ##\n~~~\n# "), "p_brand", F.lit("\n~~~\n### "), "p_name", F.lit(" "), size.cast("string"))
    body = F.when(size % 5 == 0, F.col("p_name")).when(size % 2 == 1, rest).otherwise(F.concat(F.lit("# "), "p_name", F.lit("\n\n"), rest))
    path = F.concat(F.lit("docs/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")), F.lit("-"), F.col("p_partkey").cast("string"), F.lit(".md"))
    return fx.table("part").select("p_partkey", path.alias("path"), T.headings(body).alias("headings"))


def headings(fx):
    return _described_parts(fx).select("p_partkey", F.array_join(F.transform("headings", lambda h: F.concat(h["level"].cast("string"), F.lit(":"), h["text"])), "|").alias("headings"))


def doc_titles(fx):
    return _described_parts(fx).select("p_partkey", T.doc_title(F.col("path"), F.col("headings")).alias("title"))


def demoted_headings(fx):
    return fx.md.select("doc_id", F.sha2(FM.demote_headings(F.col("raw"), F.lit(2)), 256).alias("text_sha"))


def tokenize(fx):
    return fx.docs.select("doc_id", F.sha2(F.array_join(T.tokenize(F.col("body")), " "), 256).alias("tokens_sha"), F.size(T.tokenize(F.col("body"))).alias("n"))


def stem_tokens(fx):
    words = fx.docs.select(F.explode(T.raw_tokens(F.col("body"))).alias("w")).distinct()
    made = words.select("w", F.array(F.concat("w", F.lit("s")), F.concat("w", F.lit("ies")), F.concat("w", F.lit("ing")), F.concat("w", F.lit("sses")), F.concat("w", F.lit("nned")), "w").alias("ws"))
    return made.select(F.col("w").alias("word"), F.array_join(T.stems(F.col("ws")), " ").alias("stems"))


def term_freq(fx):
    return R.term_frequency(fx.docs.select("path", "id", "body")).select("path", "field", "term", "tf", "field_len")


def bm25_saturation(fx):
    tf, n = F.col("l_quantity") - 1, F.col("l_extendedprice") / 64
    return fx.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(R.saturation(tf), 6).alias("plain"), F.round(R.saturation(tf, n), 6).alias("by_length"))


def relevance(fx):
    return R.relevance(_docs(fx).select("path", "id", "body"), TASK).select("path", "relevance")


def search_topk(fx):
    return R.best(_assessed(fx, _scored(fx)), 20).select("path", "relevance", "score")


def snippet(fx):
    return fx.docs.select("doc_id", T.snippet(F.col("body"), "reing thand").alias("snippet"))


def pack_rank(fx):
    r = R.relevance(_reports(fx), TASK)
    return r.select("path", F.round(R.rank(F.col("relevance")), 6).alias("rank"))


def _packed(fx):
    return R.pack_plan(_reports(fx), TASK, BUDGET)


def pack_budget(fx):
    return _packed(fx).where("place <> 'excluded'").select("path", F.col("total").cast("long").alias("total"), "cost")


def pack_entries(fx):
    return _packed(fx).where("place = 'entry'").select("path", "freshness", "relevance", "cost")


def pack_omitted(fx):
    return _packed(fx).where("place in ('omitted', 'cut')").select("path", F.col("left").cast("long").alias("left"))


def pack_excluded(fx):
    return _packed(fx).where("place = 'excluded'").select("path", "freshness")


def pack_by_kind(fx):
    return R.pack_plan(_reports(fx), "", BUDGET, include_stale=True, kinds=["decision", "runbook"]).select("path", "place")


def pack_cut(fx):
    """The rows of a pack of two kinds that are in it, the last one cut to the room left."""
    p = R.pack(_reports(fx), "", BUDGET, include_stale=True, kinds=["decision", "runbook"])
    return R.cut_to_fit(p).where("content is not null").select("path", "place", F.col("tokens").cast("long").alias("tokens"), F.sha2("content", 256).alias("content_sha"))


def truncate_blocks(fx):
    """Bodies in their sentences: mostly cut at a sentence, or by characters."""
    fit = CUT.fitted(F.col("body"), F.length("body") % 160 + 1)
    return fx.docs.select("doc_id", fit.alias("fit")).select("doc_id", "fit.text", "fit.tokens")


def truncate_markdown(fx):
    """Documents with front matter, headings and code, a paragraph a sentence, cut to a part of their length."""
    raw = F.regexp_replace("raw", "[.] ", ".\n\n")
    fit = fx.md.select("doc_id", CUT.fitted(raw, F.floor(F.length("raw") / 12).cast("int") + F.col("doc_id").cast("int") % 40).alias("fit"))
    return fit.select("doc_id", F.sha2("fit.text", 256).alias("text_sha"), "fit.tokens")


def duplicate_ids(fx):
    return C.duplicate_ids(_docs(fx)).select("id", _joined("paths").alias("paths"))


def exact_duplicates(fx):
    return C.exact_duplicates(_docs(fx)).select("content_hash", _joined("paths").alias("paths"))


def fnv1a_shingles(fx):
    h = F.col("h")
    return fx.docs.select("doc_id", T.fnv1a_shingles(F.col("body")).alias("h")).select("doc_id", F.sha2(F.array_join(h, ","), 256).alias("hashes_sha"), F.when(h.isNotNull(), F.size(h)).alias("n"))


def minhash_sketch(fx):
    return fx.docs.select("doc_id", _joined(C.minhash_sketch(F.col("body"))).alias("sketch"))


def near_duplicates(fx):
    return C.near_duplicates(_docs(fx)).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def duplicate_id_classes(fx):
    return CL.classes(CL.duplicate_id_members(_docs(fx)), "id").select("id", "documents", _joined("paths").alias("paths"))


def exact_duplicate_classes(fx):
    return CL.classes(CL.exact_members(_docs(fx)), "content_hash").select("content_hash", "documents", _joined("paths").alias("paths"))


def contradiction_classes(fx):
    docs = _docs(fx).drop("body").join(_md(fx).select("path", "body"), "path")
    return CL.contradiction_classes(docs).select("key", "severity", "value", "documents", _joined("paths").alias("paths"))


def near_duplicate_members(fx):
    return CL.near_duplicate_members(_docs(fx))


def trees_as_of(fx):
    """Files as they were before the last commit of each year; commits of the lowest priority delete what they touch."""
    last = fx.commits.groupBy(F.year("commit_ts").cast("string").alias("rev")).agg(F.max(F.struct("commit_ts", "sha")).alias("m")).select("rev", "m.commit_ts", "m.sha")
    kinds = fx.commits.select("sha", F.when(F.col("subject") == "5-LOW", "D").otherwise("M").alias("change_type"))
    return RL.trees_as_of(fx.commit_files.join(kinds, "sha"), fx.commits, last)


def facts_env(fx):
    return C.facts(_md(fx)).where("key like 'env:%'").select("path", "key", "value", "line")


def facts_ports(fx):
    return C.facts(_md(fx)).where("key like 'net:%'").select("path", "key", "value", "line", "seq")


def facts_scripts(fx):
    return C.facts(_md(fx)).where("key like 'script:%'").select("path", "key", "value", "line")


def facts_versions(fx):
    size = F.col("p_size").cast("string")
    lines = F.array(F.concat(F.lit("Needs Node.js v"), size, F.lit(".1")), F.concat(F.lit("and python 3."), size), F.concat(F.lit("node >= "), size))
    parts = fx.table("part").select(F.col("p_partkey").cast("string").alias("path"), F.array_join(lines, "\n").alias("body"))
    return C.facts(parts).where("key like 'version:%'").select("path", "key", "value", "line")


def facts_urls(fx):
    lines = F.array(F.concat(F.lit("api url: `"), "url", F.lit("`")), F.concat(F.lit("Base URL = "), "url"), F.concat(F.lit("see "), "url"))
    pages = fx.table("pages").select(F.col("page_id").cast("string").alias("path"), F.array_join(lines, "\n").alias("body"))
    return C.facts(pages).where("key like 'url:%'").select("path", "key", "value", "line")


def fact_placeholders(fx):
    words = fx.docs.select("doc_id", F.explode(F.split("body", " ")).alias("word"))
    return words.groupBy("doc_id").agg(F.count_if(C.is_placeholder(F.col("word"))).alias("placeholders"), F.count(F.lit(1)).alias("words"))


def asserted_facts(fx):
    return C.asserted(C.facts(_md(fx))).select("path", "key", "value", "line")


def contradictions(fx):
    md = _md(fx).join(_docs(fx).select("doc_id", "id", "supersedes"), "doc_id")
    return C.contradictions(md).select("key", "severity", "label", F.array_join("values", "|").alias("values"), F.size("paths").alias("docs"))


def conflicts_all(fx):
    return C.all_conflicts(_docs(fx)).select("kind", "severity", _joined("docs").alias("docs"), "detail")


def conflicts_ordered(fx):
    return C.placed(C.all_conflicts(_docs(fx))).select("place", "kind", "severity", _joined("docs").alias("docs"))


def url_origin(fx):
    return fx.table("pages").select("page_id", C.origin(F.col("url")).alias("origin"))


def frontmatter_split(fx):
    return FM.split(fx.md.select("doc_id", "raw")).select("doc_id", "has_fm", F.sha2("block", 256).alias("block_sha"), F.sha2("body", 256).alias("body_sha"))


def frontmatter_fields(fx):
    f = FM.fields(FM.split(fx.md.select("doc_id", "raw")))
    return f.select("doc_id", F.col("fields")["id"].alias("id"), F.col("fields")["kind"].alias("kind"), F.col("fields")["tags"].alias("tags"), F.col("fields")["expires"].alias("expires"))


def frontmatter_errors(fx):
    f = FM.fields(FM.split(fx.md.select("doc_id", "raw")))
    return f.where("has_fm").select("doc_id", F.array_join("errors", "|").alias("errors"), F.size("warnings").alias("warnings"))


def frontmatter_written(fx):
    """Front matter made of a document's fields, its first words as owner, which a third of all have to quote."""
    words = F.array_join(F.slice(F.split(T.trimmed(F.col("body")), r"\s+"), 1, 4), " ")
    owner = F.when(F.length("body") % 3 == 0, F.concat("id", F.lit(": it's "), words)).otherwise(words)
    globs = F.array(F.col("path"), F.lit("src/**"), F.concat(F.lit("workers/q"), F.col("doc_id").cast("string"), F.lit("/**")), F.regexp_replace("path", "[.]md$", "/a-rather-long-name.ts"))
    some = F.slice(globs, F.lit(1), F.length("body") % 4 + 1)
    data = F.struct(F.lit(1).alias("spec"), "id", "kind", some.alias("describes"), owner.alias("owner"), F.col("ttl_days").alias("ttlDays"), F.array_compact(F.array("supersedes")).alias("supersedes"), "pin")
    return fx.docs.select("doc_id", FM.written(F.to_json(data), F.lit("Text.\n")).alias("raw"))


def field_near_miss(fx):
    words = fx.docs.select(F.concat(F.element_at(F.array(*map(F.lit, FRONT_FIELDS)), (F.col("doc_id") % 11 + 1).cast("int")), F.element_at(F.array(F.lit(""), F.lit("s"), F.lit("xx")), (F.col("doc_id") % 3 + 1).cast("int"))).alias("word")).distinct()
    return words.select("word", FM.near_field(F.col("word")).alias("near"))


def iso_date_valid(fx):
    day = F.format_string("20%02d-%02d-%02d", F.col("doc_id") % 30, F.col("doc_id") % 14, F.col("doc_id") % 33)
    return fx.docs.select("doc_id", day.alias("day"), F.coalesce(T.iso_date(day), F.lit(False)).alias("valid"))


def order_dates_valid(fx):
    """Order dates with month and day changed over, of which those after the twelfth do not exist."""
    day = F.date_format("o_orderdate", "yyyy-dd-MM")
    return fx.table("orders").select("o_orderkey", day.alias("day"), F.coalesce(T.iso_date(day), F.lit(False)).alias("valid"))


def slugify(fx):
    name = F.concat(F.lpad((F.col("doc_id") % 1000).cast("string"), 4, "0"), F.lit("-"), F.col("lang"), F.lit(" "), F.col("source"), F.lit(".md"))
    return fx.table("documents").select("doc_id", F.sha2(T.slugify(F.col("text")), 256).alias("slug_sha"), T.is_slug(F.col("source")).alias("is_slug"), T.file_slug(name).alias("file_slug"))


def suggest(fx):
    words = fx.docs.select(F.concat(F.element_at(F.array(*map(F.lit, ("chek", "mpa", "pakc", "initt", "handof", "zzzzzzzz", "doctr"))), (F.col("doc_id") % 7 + 1).cast("int"))).alias("word")).distinct()
    return words.select("word", FM.suggest(F.col("word"), ("check", "map", "pack", "init", "handoff", "doctor")).alias("suggestion"))


def human_tokens(fx):
    small, large = F.floor(F.col("l_extendedprice") * F.col("l_discount")), F.floor(F.col("l_extendedprice") * F.col("l_quantity"))
    return fx.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.human_tokens(small).alias("small"), T.human_tokens(large).alias("large"))


def source_index(fx):
    return I.source_index(fx.files).select("suffix", "path", "n")


def mentions(fx):
    return I.mentions(fx.md.withColumnRenamed("raw", "body")).select("path", "mention")


def mention_resolve(fx):
    return I.resolve(I.mentions(fx.md.withColumnRenamed("raw", "body")), fx.files).select("path", "mention", "file")


def infer_kind(fx):
    path = F.concat(F.element_at(F.array(*map(F.lit, ("docs/", "docs/adr/", "x/handoff-", "ops/playbook/", "a/rfcs/", "a/api/", "0012-"))), (F.col("doc_id") % 7 + 1).cast("int")), F.col("doc_id").cast("string"), F.lit(".md"))
    return _md(fx).select("doc_id", I.kind(path, F.col("body"), F.col("headings")).alias("kind"))


def infer_describes(fx):
    # the files of the commits that a document's own customer made, as if it had cited them
    own = fx.commit_files.join(fx.docs.select("path"), "path", "left_semi").select("sha", "path")
    touched = fx.commit_files.join(fx.files.select("path"), "path", "left_semi").select("sha", F.col("path").alias("file"))
    cited = own.join(touched, "sha").select("path", "file")
    return I.describes(cited).select("path", F.array_join("globs", ",").alias("globs"), F.size("evidence").alias("evidence"))


def infer_ids(fx):
    """Ids for notes of one name in folders by source and language, of which some numbers are taken."""
    k = F.floor(F.col("doc_id") / 10_000).cast("string")
    docs = fx.table("documents").select(F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("xx")), F.concat(F.lit("d"), k), F.format_string("%04d-note.md", F.col("doc_id") % 10_000)).alias("path"))
    last = F.element_at(I.wanted_ids(F.col("path")), -1)
    taken = docs.select(F.explode(F.array(F.concat(last, F.lit("-3")), F.concat(last, F.lit("-4")))).alias("id"))
    return I.infer_ids(docs, taken)


def _dead(fx):
    return fx.old_files.select(F.concat(F.lit("old/"), "typ", F.lit("/**")).alias("glob")).distinct()


def _relocation(fx):
    new = fx.renames.select(F.col("new_path").alias("path"))
    return _dead(fx), fx.old_files.select(F.col("old_path").alias("path")), fx.renames, new


def relocation_vote(fx):
    return RL.votes(RL.links(*_relocation(fx))).select("glob", "home", "moved", "lowest", "files", "tied")


def relocations(fx):
    return RL.relocations(*_relocation(fx))


def relocation_reason(fx):
    moves = RL.relocations(*_relocation(fx))
    return moves.select("glob", FR.relocation_reason(moves).alias("reason"))


def _movers(fx):
    """Reports of documents that all claim the old folder of their file's type."""
    typ = fx.files.select("k", F.array(F.concat(F.lit("old/"), "typ", F.lit("/**"))).alias("missing"))
    return _reports(fx).drop("missing").join(typ, "k")


def moved_hints(fx):
    r = FR.with_moves(_movers(fx).withColumn("freshness", F.lit("orphaned")), RL.relocations(*_relocation(fx)))
    return r.select("path", FR.fix_hint(r).alias("hint"))


def doctor_populations(fx):
    has = _md(fx).select("doc_id", "has_fm")
    return RP.populations(_movers(fx).join(has, "doc_id"), RL.relocations(*_relocation(fx)))


def doctor_report(fx):
    d = _docs(fx)
    return RP.doctor_report(RP.populations(_reports(fx)), C.duplicate_ids(d), C.exact_duplicates(d), configured=False)


def unverified_without_history(fx):
    return FR.without_history(_docs(fx), _globs(fx)).select("path", "freshness", "score", F.size("describes").alias("claims"))


def folder_claims(fx):
    folder = F.regexp_replace("path", "/[^/]*$", "")
    globs = fx.files.select(folder.alias("glob")).union(fx.files.select(F.concat(F.lit("gone/"), F.col("typ")))).distinct()
    return GJ.folder_claims(globs, fx.files, GJ.match(globs, fx.files))


def folder_history(fx):
    folders = fx.files.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct()
    inside = GJ.below(folders, fx.commit_files)
    return FR.newest(inside.join(fx.commit_files, "path").join(fx.commits, "sha"), "folder").select("folder", "commit.sha")


def counts_map(fx):
    return RP.counts_map(_reports(fx)).select(F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


def verify_gate(fx):
    ran = fx.docs.select("path", (F.length("body") % 10 != 0).alias("passed"))
    return RP.failing(_reports(fx), ran).select("path", "freshness")


def withheld_by_trust(fx):
    return RP.below_trust(R.best(_assessed(fx, _scored(fx)), 50), "drifting").select("path", "freshness")


def map_entries(fx):
    return RP.map_entries(_reports(fx), "kind").select("key", "place", "path", "tokens")


def map_heat(fx):
    return RP.heat(_reports(fx), "dir")


def freshness_table(fx):
    return FR.evidence_table(_reports(fx))


def evidence_lines(fx):
    r = _reports(fx)
    return r.select("path", FR.evidence_line(r).alias("evidence"))


def report_lookup(fx):
    # one path: the newest document's
    last = fx.docs.agg(F.max("path").alias("path"))
    return _reports(fx).join(F.broadcast(last), "path", "left_semi").select("path", "freshness", "score")


def tool_glob(fx):
    return RP.tool_select(fx.files, "src/s*l/**/*5.ts").select("path")


def tool_glob_folder(fx):
    return RP.tool_select(fx.files, "./src/small").select("path")


def handoff_tiers(fx):
    docs = _scored(fx)
    return RP.handoff_tiers(RP.covered(_globs(fx), _changed(fx)), _assessed(fx, docs), docs, "docs/src1/80.md").select("place", "path", "tier", F.size("files").alias("files"))


def handoff_age(fx):
    notes = fx.docs.where("kind = 'handoff'").join(fx.commits, fx.docs.doc_id.cast("string") == fx.commits.sha).select("path", F.col("author_ts").alias("written"), "ttl_days")
    return RP.handoff_age(notes, now())


def status_words(fx):
    return fx.table("orders").select("o_orderkey", RP.status_words(F.concat(F.translate("o_orderstatus", "FOP", "MAR"), F.left("o_orderpriority", F.lit(1)), F.lit("?"))).alias("words"))


def note_bullets(fx):
    return fx.docs.select("doc_id", F.size(RP.bullets(F.col("body"))).alias("n"), F.sha2(F.array_join(RP.bullets(F.col("body")), "|"), 256).alias("bullets_sha"))


def date_order(fx):
    o = fx.table("orders")
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    odd = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(text)
    return o.select("o_orderkey", RP.earlier(odd, F.lit("1996-01-01")).alias("sign"))


def display_width(fx):
    return fx.docs.select("doc_id", D.width(F.col("body")).alias("width"), D.width(F.concat(F.lit("\u001b[31m世界\u001b[0m "), "path")).alias("coloured"))


def display_cut(fx):
    return fx.docs.select("doc_id", D.truncate(F.concat_ws(" ", "path", "id", "kind"), 30).alias("cut"), D.truncate_path(F.concat(F.lit("a/long/way/down/"), F.col("path")), 24).alias("path"), D.pad(F.col("kind"), 12).alias("padded"))


def display_wrap(fx):
    return fx.docs.select("doc_id", F.size(D.wrap(F.col("path"), 8)).alias("pieces"), F.array_join(D.wrap(F.concat_ws(" ", "id", "kind", "path"), 30), "|").alias("lines"))


def pack_left_out(fx):
    p = _packed(fx).where("place in ('omitted', 'excluded')")
    return p.select("path", R.left_out(p, BUDGET).alias("why"))


def sketch_similarity(fx):
    # each document's sketch against that of its neighbour by number; written, as both sides of the join would make it again
    sk = stored(fx.docs.select("doc_id", C.minhash_sketch(F.col("body")).alias("sketch"))).where("sketch is not null")
    two = sk.select((F.col("doc_id") - 1).alias("doc_id"), F.col("sketch").alias("other"))
    return sk.join(two, "doc_id").select("doc_id", F.round(C.sketch_similarity(F.col("sketch"), F.col("other")), 6).alias("similarity"))


NOT_QUERIES = {"now"}


def all_queries():
    """name -> f(spark, sf_dir)."""
    import inspect

    def make(f):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Fixtures(spark, sf_dir))

        return query

    own = [(k, f) for k, f in globals().items() if inspect.isfunction(f) and f.__module__ == __name__ and k[0] != "_" and k not in NOT_QUERIES | {"all_queries"}]
    return {k: make(f) for k, f in own}
