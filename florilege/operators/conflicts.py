"""Documents against each other: equal ids, equal and near-equal bodies, and facts that disagree."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.functions import text as T
from florilege.operators.ranking import running_total
from florilege.sources.tables import bit_table, may_hold, stored

THRESHOLD = 0.8
# Which paths are history, and what the lines of a document assert.
HISTORICAL = r"(?i)(^|/)(archive|archived|legacy|old|deprecated|history)(/|$)|changelog"
ENV = r"^[\s>$#*+-]*`{0,3}\s*(?:export\s+|set\s+|ENV\s+)?([A-Z][A-Z0-9_]{2,40})\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s`#]+)\s*`{0,3}\s*\z"
COMMAND = r"(?i)\b(npm|pnpm|yarn|bun)\s+(?:(run)\s+)?([a-z][a-z0-9:_-]{1,30})\b"
PORT = r"\b(?:localhost|127\.0\.0\.1|0\.0\.0\.0):(\d{2,5})\b"
RANGE = r"(?i)(>=|<=|>|<|\^|~|\+|or\s+(later|newer|above)|and\s+(up|above))"
NODE = r"(?i)\bnode(?:\.js)?\s*(?:v|version\s+)?\s*([0-9]{1,2})(?:\.[0-9x]+)*"
PYTHON = r"(?i)\bpython\s*(?:v|version\s+)?\s*(3\.[0-9]{1,2})"
URL = r"(?i)\b(base\s*url|api\s*url|service\s*url|BASE_URL|API_URL)\b\s*[:=]?\s*[`\"']?(https?://[^\s`\"'<>)]+)"
BARE = ("start", "test", "dev", "build", "lint")
PLACEHOLDER = r"(?i)^(your|my|some|example|sample|changeme|change_me|xxx|todo|tbd|placeholder|redacted|dummy|foo|bar)"


def duplicate_ids(docs: DataFrame) -> DataFrame:
    """(id, paths) of trimmed ids that several documents share."""
    ids = docs.withColumn("id", F.trim("id")).where("id <> ''")
    return ids.groupBy("id").agg(F.array_sort(F.collect_list("path")).alias("paths")).where(F.size("paths") > 1)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(content_hash, paths) of bodies that are equal up to white space."""
    hashed = docs.select("path", T.content_hash(F.col("body")).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.array_sort(F.collect_list("path")).alias("paths")).where(F.size("paths") > 1)


def representatives(docs: DataFrame) -> DataFrame:
    """One document, of the least path, for each distinct body."""
    first = docs.groupBy(T.content_hash(F.col("body")).alias("h")).agg(F.min("path").alias("path"))
    return docs.select("path", "body").join(first, "path", "left_semi")


def shingle_sets(docs: DataFrame, size: int = 5) -> DataFrame:
    """(path, hs, n): the distinct hashes of each document's shingles; none for documents below LEAST_WORDS words.

    A row a shingle lets generated code hash them, which array functions do not; docs that lie by path are not moved.
    """
    words = docs.select("path", T.shingle_words(F.col("body")).alias("words"))
    places = F.when(F.size("words") >= T.LEAST_WORDS, F.sequence(F.lit(0), F.size("words") - size))
    run = [F.get(F.col("words"), F.col("at") + i) for i in range(size)]
    hashed = words.select("path", "words", F.explode(places).alias("at")).select("path", F.xxhash64(*run).alias("h"))
    return hashed.groupBy("path").agg(F.collect_set("h").alias("hs")).withColumn("n", F.size("hs"))


BUCKETS = 1 << 18  # of shingles, by which their frequency is counted; changes only the plan
BLOCK = 1 << 18  # shingles of a block of sets, about; changes only the plan
MOST_SETS = 512  # in a block, so that a pair of blocks has as many pairs squared at most; changes only the plan


def _first_shingles(sets: DataFrame, threshold: float, more: float = 0) -> Column:
    """Of each set's `hs`, as many as a set so similar must share one of: those of the emptiest buckets, then the least.

    With that part `more` of the set besides, it must share one and that part of the smaller set. A number for each
    bucket goes to the tasks, whatever the number of documents.
    """
    bucket = F.col("h").bitwiseAND(F.lit(BUCKETS - 1).cast("long"))
    filled = np.zeros(BUCKETS, np.int64)
    for r in sets.select(F.explode("hs").alias("h")).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        filled[r.bucket] = r.n
    held = sets.sparkSession.sparkContext.broadcast(filled)

    def first(hs: pd.Series) -> pd.Series:
        def of(h):
            most = len(h) - math.ceil(len(h) * threshold) + 1 + math.floor(more * len(h))
            return h[np.lexsort((h, held.value[h & (BUCKETS - 1)]))[:most]]

        return hs.map(of)

    return F.pandas_udf(first, "array<bigint>")("hs")


def _candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, na, nb): pairs of sets(k, n, hs) that may overlap by more than threshold, a < b, and their sizes.

    Sets that share `need` of their first shingles; a shingle at places pa and pb of the two orders is one of the first
    `need` that are shared only where need - 1 of them may lie before it and all others behind it.
    """
    more = threshold / 32  # longer texts share a few rare shingles by chance
    prefix = sets.select("k", "n", F.posexplode(_first_shingles(sets, threshold, more)).alias("p", "h"))
    left, right = prefix.toDF("a", "na", "pa", "h").hint("merge"), prefix.toDF("b", "nb", "pb", "h")
    need = F.floor(F.lit(more) * F.least("na", "nb")) + 1
    least = F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - 1e-6  # shingles that similar sets share
    met = left.join(right, "h").where((F.col("a") < F.col("b")) & (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1 + need >= least))
    return met.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= need).drop("shared")


def _blocks(pairs: DataFrame) -> DataFrame:
    """(k, block) of all sets in pairs(a, b, na, nb): runs of about BLOCK shingles and MOST_SETS sets at most, those that pair with the same one side by side."""
    either = pairs.select(F.col("a").alias("k"), F.col("na").alias("n"), "a").union(pairs.select("b", "nb", "a"))
    named = stored(either.groupBy("k").agg(F.min("a").alias("least"), F.first("n").alias("n")))
    weight = F.greatest(F.col("n"), F.lit(math.ceil(BLOCK / MOST_SETS)))
    return running_total(named, [F.col("least"), F.col("k")], weight, "upto").select("k", F.floor((F.col("upto") - 1) / BLOCK).alias("block"))


def _overlaps(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """(pa, pb, na, nb, shared) of pairs(a, b) whose sets(k, path, hs) are all there."""
    hs = sets["hs"].combine_chunks()
    ends = np.cumsum(pc.list_value_length(hs).to_numpy())
    values, ids = np.unique(hs.flatten().to_numpy(), return_inverse=True)
    members = np.split(ids, ends[:-1])
    order = np.argsort(ks := sets["k"].to_numpy())
    a, b = (order[np.searchsorted(ks, pairs[x].to_numpy(), sorter=order)] for x in "ab")
    shared, inside, last = np.zeros(len(a), np.int32), np.zeros(len(values), bool), None
    for i in np.argsort(a, kind="stable"):
        if a[i] != last:
            inside[:] = False
            inside[members[last := a[i]]] = True
        shared[i] = np.count_nonzero(inside[members[b[i]]])
    sizes = np.diff(ends, prepend=0).astype(np.int32)
    return pa.table({"pa": sets["path"].take(a), "pb": sets["path"].take(b), "na": sizes[a], "nb": sizes[b], "shared": shared})


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, jaccard) of representatives whose shingle sets overlap by more than threshold.

    Exact, by prefix filtering: in any one order of all shingles, two sets that similar share one of
    their first n - ceil(t n) + 1, and one more for each that is added to these, so only these are joined.
    The order is by how full a shingle's bucket is, so that frequent ones come last; as it is
    known where a set lies, its other shingles are not moved to be counted. Whole sets move only
    for pairs that are left, once for each pair of blocks of sets, however many pairs these hold.
    """
    # making shingles takes far longer than moving the texts, so all tasks share them
    sets = stored(shingle_sets(representatives(docs).repartition("path")).withColumn("k", F.monotonically_increasing_id()))
    pairs = stored(_candidates(sets, threshold))
    blocks = stored(_blocks(pairs))
    block = lambda x: blocks.toDF(x, f"block_{x}").hint("merge")
    together = [F.least("block_a", "block_b").alias("low"), F.greatest("block_a", "block_b").alias("high")]
    placed = stored(pairs.join(block("a"), "a").join(block("b"), "b").select(*together, "a", "b"))
    wanted = placed.select(F.col("low").alias("one"), F.col("high").alias("other"), F.explode(F.array("a", "b")).alias("k")).distinct()
    moved = sets.where(may_hold(bit_table(blocks.select("k")), "k")).select("k", "path", "hs").hint("merge").join(wanted, "k")
    both = placed.groupBy("low", "high").cogroup(moved.groupBy("one", "other"))
    found = both.applyInArrow(_overlaps, "pa string, pb string, na int, nb int, shared int")
    found = found.withColumn("jaccard", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).where(F.col("jaccard") > threshold)
    return found.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"), "jaccard")


def minhash_sketch(text: Column, size: int = 64) -> Column:
    """The least `size` FNV-1a values of a text's shingles."""
    return T.fnv1a_shingles(text, least=size)


def sketch_similarity(a: Column, b: Column) -> Column:
    """Jaccard estimate of two sketches: of the least values of their union, as many as the smaller one has, the share that both hold."""
    k = F.least(F.size(a), F.size(b))
    union = F.slice(F.array_sort(F.array_union(a, b)), F.lit(1), F.greatest(k, F.lit(0)))
    both = F.size(F.array_compact(F.array_intersect(F.array_intersect(a, b), union)))
    return F.when(k <= 0, 0.0).otherwise(both / k)


def unquoted(raw: Column) -> Column:
    return T.trimmed(F.regexp_replace(raw, r"^[\"'`]|[\"'`]\z", ""))


def is_placeholder(raw: Column) -> Column:
    v = unquoted(raw)
    return (v == "") | v.rlike(r"^[<{$]") | v.contains("...") | v.contains("…") | v.rlike(r"^\*+\z") | v.rlike(PLACEHOLDER)


def normal_value(raw: Column) -> Column:
    v = unquoted(raw)
    return F.when(v.rlike(r"(?i)^(true|false|null)\z"), F.lower(v)).otherwise(v)


def origin(url: Column) -> Column:
    """Scheme, host and port of a URL in lower case; null for other texts."""
    found = F.regexp_extract(url, r"(?i)^(https?://[^/\s?#]+)", 1)
    return F.when(found != "", F.regexp_replace(F.lower(found), r"\.\z", ""))


def _fact(condition: Column, key: Column, value: Column) -> Column:
    return F.filter(F.array(F.when(condition, F.struct(key.alias("key"), value.alias("value")))), lambda x: x.isNotNull())


def _facts(line: Column) -> Column:
    env_value = normal_value(F.regexp_extract(line, ENV, 2))
    env = _fact(line.rlike(ENV) & ~is_placeholder(F.regexp_extract(line, ENV, 2)), F.concat(F.lit("env:"), F.regexp_extract(line, ENV, 1)), F.coalesce(origin(env_value), env_value))
    commands = F.arrays_zip(*[F.regexp_extract_all(line, F.lit(COMMAND), F.lit(i)).alias(n) for i, n in ((1, "m"), (2, "run"), (3, "s"))])
    script = lambda x: F.lower(x["s"])
    commands = F.filter(commands, lambda x: ~script(x).isin("install", "add", "ci") & ((x["run"] != "") | script(x).isin(*BARE)))
    commands = F.transform(commands, lambda x: F.struct(F.concat(F.lit("script:"), script(x)).alias("key"), F.lower(x["m"]).alias("value")))
    ports = F.transform(F.regexp_extract_all(line, F.lit(PORT), F.lit(1)), lambda p: F.struct(F.lit("net:localhost-port").alias("key"), p.alias("value")))
    exact = ~line.rlike(RANGE)
    major = F.regexp_extract(line, NODE, 1)
    node = _fact(exact & (major != "") & F.try_to_number(F.nullif(major, F.lit("")), F.lit("99")).between(4, 40), F.lit("version:node"), major)
    minor = F.regexp_extract(line, PYTHON, 1)
    python = _fact(exact & (minor != ""), F.lit("version:python"), minor)
    label, target = F.lower(F.regexp_extract(line, URL, 1)), F.regexp_extract(line, URL, 2)
    kind = F.when(label.contains("api"), F.lit("url:api")).when(label.contains("service"), F.lit("url:service")).otherwise(F.lit("url:base"))
    url = _fact((target != "") & ~is_placeholder(target) & origin(target).isNotNull(), kind, origin(target))
    return F.concat(env, commands, ports, node, python, url)


def facts(docs: DataFrame) -> DataFrame:
    """(path, key, value, line, seq, text): what each line asserts; lines count from 1."""
    hint = r"(?i)=|npm|yarn|bun|:\d\d|node|python|https?://"
    lines = docs.select("path", F.posexplode(F.split("body", "\n")).alias("at", "line_text")).where(F.col("line_text").rlike(hint))
    found = lines.select("path", (F.col("at") + 1).alias("line"), "line_text", F.posexplode(_facts(F.col("line_text"))).alias("seq", "f"))
    return found.select("path", "f.key", "f.value", "line", "seq", T.trimmed(F.col("line_text")).alias("text"))


def live_facts(docs: DataFrame) -> DataFrame:
    """The facts of documents(path, id, supersedes array<string>, body) that are not historical and that no other replaces.

    A document's id goes with its facts, so that texts are not moved to be told apart by it.
    """
    old = docs.select(F.explode("supersedes").alias("id")).distinct()
    found = facts(docs.where(~F.col("path").rlike(HISTORICAL)).select(F.struct("path", "id").alias("path"), "body"))
    return found.withColumn("id", F.col("path.id")).withColumn("path", F.col("path.path")).join(old, "id", "left_anti").drop("id")


def asserted(found: DataFrame) -> DataFrame:
    """(path, key, value, line, text): facts of which a document gives one value only, at their first place."""
    first = F.min(F.struct("line", "seq", "text")).alias("first")
    one = found.groupBy("path", "key").agg(F.min("value").alias("value"), F.max("value").alias("other"), first).where("value = other")
    return one.select("path", "key", "value", "first.line", "first.text")


def fact_severity(key: Column) -> Column:
    return F.when(key.startswith("script:") | (key == "env:PORT"), "high").when(key.rlike("^(env|version|url):"), "medium").otherwise("low")


def fact_label(key: Column) -> Column:
    names = {"script": "run command", "env": "environment variable", "version": "toolchain version", "url": "service URL", "net": "local port"}
    out = F.lit("value")
    for k, v in names.items():
        out = F.when(key.startswith(k + ":"), v).otherwise(out)
    return out


def contradictions(docs: DataFrame) -> DataFrame:
    """(key, severity, label, values, paths): facts on which eligible documents disagree.

    docs(path, id, supersedes array<string>, body). Historical documents and those that another
    replaces take no part.
    """
    by_value = asserted(live_facts(docs)).groupBy("key", "value").agg(F.collect_set("path").alias("paths"))
    by_key = by_value.groupBy("key").agg(F.array_sort(F.collect_list("value")).alias("values"), F.array_sort(F.flatten(F.collect_list("paths"))).alias("paths")).where(F.size("values") > 1)
    return by_key.select("key", fact_severity(F.col("key")).alias("severity"), fact_label(F.col("key")).alias("label"), "values", F.array_distinct("paths").alias("paths"))


def all_conflicts(docs: DataFrame) -> DataFrame:
    """(kind, severity, docs, detail) of all conflicts."""
    ids = duplicate_ids(docs).select(F.lit("duplicate-id").alias("kind"), F.lit("high").alias("severity"), F.col("paths").alias("docs"), F.col("id").alias("detail"))
    facts_ = contradictions(docs).select(F.lit("contradiction").alias("kind"), "severity", F.col("paths").alias("docs"), F.concat(F.col("key"), F.lit(": "), F.array_join("values", " vs ")).alias("detail"))
    same = exact_duplicates(docs).select(F.lit("duplicate").alias("kind"), F.lit("high").alias("severity"), F.col("paths").alias("docs"), F.lit("identical").alias("detail"))
    near = near_duplicates(docs).select(
        F.lit("duplicate").alias("kind"), F.when(F.col("jaccard") > 0.9, "high").otherwise("medium").alias("severity"), F.array("a", "b").alias("docs"), F.concat(F.floor(F.col("jaccard") * 100 + 0.5).cast("int").cast("string"), F.lit("%")).alias("detail")
    )
    return ids.unionByName(facts_).unionByName(same).unionByName(near)


def _worst_first() -> list[Column]:
    level = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    kind = F.when(F.col("kind") == "duplicate-id", 0).when(F.col("kind") == "contradiction", 1).otherwise(2)
    return [level, kind, F.array_join("docs", ",")]


def ordered(conflicts: DataFrame) -> DataFrame:
    """Worst first: severity, then kind, then documents."""
    return conflicts.orderBy(*_worst_first())


def placed(conflicts: DataFrame) -> DataFrame:
    """The conflicts with their place in the order of `ordered`, from 1, counted over ranges."""
    return running_total(stored(conflicts), [*_worst_first(), F.col("detail")], F.lit(1), "place").withColumn("place", F.col("place").cast("int"))
