"""Relevance of documents to a task, rank, and filling a token budget with full accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.dims import DEGRADED, FIELD_WEIGHT, KIND_WEIGHT, NO_KIND_WEIGHT, VERDICTS, lookup
from florilege.functions import cutting as CUT
from florilege.functions import text as T
from florilege.sources.tables import stored

FLOOR = 0.05
NEUTRAL = 0.5
K1, B, BODY_TOKENS, SOFT = 1.2, 0.5, 400, 2.5


def saturation(tf: Column, length: Column | None = None) -> Column:
    """BM25 saturation; with a length, normalised by it."""
    norm = K1 if length is None else K1 * (1 - B + B * length / float(BODY_TOKENS))
    return F.when(tf <= 0, 0.0).otherwise(tf * (K1 + 1) / (tf + norm))


def _fields(docs: DataFrame) -> dict[str, Column]:
    """The text of each field; those absent are empty."""
    has = set(docs.columns)
    text = lambda c: F.col(c) if c in has else F.lit("")
    joined = lambda c, by: F.array_join(F.col(c), by) if c in has else F.lit("")
    return {"title": text("title"), "id": text("id"), "headings": joined("headings", " \n "), "tags": joined("tags", " "), "path": F.regexp_replace("path", r"(?i)\.mdx?$", ""), "body": F.col("body")}


def with_tokens(docs: DataFrame) -> DataFrame:
    """Adds one token array a field: t_title, t_id, t_headings, t_tags, t_path, t_body; fields absent are empty."""
    return docs.withColumns({f"t_{k}": T.tokenize(v) for k, v in _fields(docs).items()})


def term_frequency(docs: DataFrame) -> DataFrame:
    """(path, field, term, tf, field_len): postings of every field."""
    tokens = with_tokens(docs)
    fields = F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"t_{k}").alias("terms")) for k in FIELD_WEIGHT])
    rows = tokens.select("path", F.explode(fields).alias("f")).select("path", "f.field", F.size("f.terms").alias("field_len"), F.explode("f.terms").alias("term"))
    return rows.groupBy("path", "field", "term", "field_len").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def relevance(docs: DataFrame, task: str) -> DataFrame:
    """docs with `relevance` in 0..1; the few query terms are one literal array, so rows are scored where they lie."""
    terms = T.query_terms(docs.sparkSession, task)
    if not terms:
        return docs.withColumn("relevance", F.lit(0.0))
    asked = F.lit(terms)
    runs = docs.withColumns({f"r_{k}": T.runs_about(v, terms) for k, v in _fields(docs).items()})
    met = runs.withColumns({f"m_{k}": F.flatten(f"r_{k}") for k in FIELD_WEIGHT} | {"m_length": T.token_count(F.col("body"))})
    count = lambda name, term: F.size(F.filter(f"m_{name}", lambda w: w == term))

    def weighed(name, term):
        length = F.col("m_length") if name == "body" else None
        return F.lit(FIELD_WEIGHT[name]) * T.let(count(name, term), lambda tf: saturation(tf, length))

    def hits(term):
        first, *others = [weighed(name, term) for name in FIELD_WEIGHT]
        return 1 - F.exp(-sum(others, first) / SOFT)

    score = F.aggregate(F.transform(asked, hits), F.lit(0.0), lambda total, h: total + h) / len(terms)
    wanted = sorted({f"{a} {b}" for a, b in zip(terms, terms[1:], strict=False)})
    if wanted:
        seen = F.flatten(F.transform(F.concat(*[F.col(f"r_{f}") for f in ("title", "headings", "tags", "body")]), T.pairs))
        share = F.size(F.array_intersect(F.lit(wanted), seen)) / float(len(wanted))
        score = T.let(score, lambda s: s + (1 - s) * 0.3 * share)
    if "id" in docs.columns:
        named = F.coalesce((F.length("id") >= 3) & (F.instr(F.lit(task.lower()), F.lower("id")) > 0), F.lit(False))
        score = F.greatest(score, F.when(named, F.lit(0.9)).otherwise(F.lit(0.0)))
    scored = met.withColumn("relevance", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.floor(score * 10_000 + 0.5) / 10_000)))
    return scored.drop(*[f"{x}_{k}" for k in FIELD_WEIGHT for x in "rm"], "m_length")


def rank(relevance_: Column) -> Column:
    kind = F.coalesce(lookup(F.col("kind"), KIND_WEIGHT), F.lit(NO_KIND_WEIGHT))
    trust = lookup(F.col("freshness"), {k: v[1] for k, v in VERDICTS.items()})
    # whole numbers first: 0.4 times a score is rounded once more, which parts ranks that are equal
    return relevance_ * kind * trust * (0.6 + F.col("score") * 4 / F.lit(10.0) / 100)


def search(reports: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Most relevant reports first, of those with any relevance."""
    return best(relevance(reports, query), limit)


def best(scored: DataFrame, limit: int = 10) -> DataFrame:
    """`search` among reports that have their relevance; documents may be scored before they are assessed, which then needs no texts."""
    limit = max(1, min(50, round(limit)))
    return scored.where("relevance > 0").orderBy(F.desc("relevance"), F.desc("score"), "path").limit(limit)


def running_total(df: DataFrame, order: list[Column], value: Column, into: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds the running sum of value in a total order, by range partitions and their totals; with keys, one for each of their groups.

    A group may be cut into many ranges, so none has to fit in a task. Without keys, the one window over
    all runs over a row for each partition; with keys, only groups that go on from one partition into the
    next are carried, one a partition at most. Finding the ranges, the totals and the sums each read the
    rows: pass narrow ones that are written. Keys are not null.
    """
    # a number of its own keeps the partitions as they are in both branches
    parts = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, *order).withColumn("_part", F.spark_partition_id())
    inside = F.sum(value).over(Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("_inside", inside)
    ends = parts.groupBy("_part", *keys).agg(F.max("_inside").alias("_sum"))
    before = ends.withColumn("_before", F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_sum")).drop("_sum").where("_before <> 0")
    summed = parts.join(F.broadcast(before), ["_part", *keys], "left").withColumn(into, F.col("_inside") + F.coalesce("_before", F.lit(0)))
    return summed.drop("_part", "_inside", "_before")


def pack_plan(reports: DataFrame, task: str, budget: int = 8000, include_stale: bool = False, kinds: list[str] | None = None) -> DataFrame:
    """(path, kind, pin, freshness, score, relevance, rank, cost, total, left, place) of every candidate.

    Ranks and costs are written once, without texts, before anything is chosen by them: a
    condition on relevance would otherwise be worked out again beneath each join that it passes.
    """
    budget = max(0, int(budget))
    asked = bool(T.query_terms(reports.sparkSession, task))
    rows = reports.where(F.col("kind").isin(*kinds)) if kinds else reports
    rows = relevance(rows, task) if asked else rows.withColumn("relevance", F.lit(NEUTRAL))
    pinned = F.coalesce(F.col("pin"), F.lit(False))
    rows = stored(rows.select("path", "kind", "pin", "freshness", "score", "relevance", T.token_estimate(F.col("body")).alias("cost")))
    rows = rows.where(pinned | (F.col("relevance") >= FLOOR)) if asked else rows
    gate = F.lit(False) if include_stale else ~pinned & F.col("freshness").isin(*DEGRADED)
    rows = rows.withColumns({"rank": rank(F.col("relevance")), "excluded": gate, "pinned": pinned})
    cost = F.when(F.col("excluded"), 0).otherwise(F.col("cost"))
    order = [F.desc("pinned"), F.desc("rank"), F.desc("score"), F.collate("path", "UNICODE").asc(), F.col("path").asc()]
    summed = running_total(rows, order, cost, "total")
    over = F.col("total") > budget
    left = budget - (F.col("total") - F.col("cost"))
    tail = max(120, budget // 20)
    place = (
        F.when(F.col("excluded"), F.lit("excluded"))
        .when(~over, F.lit("entry"))
        .when(left < 0, F.lit("omitted"))
        .when(left >= tail, F.lit("cut"))
        .otherwise(F.lit("omitted"))
    )
    return summed.withColumn("left", F.greatest(left, F.lit(0))).withColumn("place", place).drop("pinned", "excluded")


def pack(reports: DataFrame, task: str, budget: int = 8000, include_stale: bool = False, kinds: list[str] | None = None) -> DataFrame:
    """Every candidate once, with `place` entry, cut, omitted or excluded, its cost and the tokens before it.

    reports(path, body, kind, pin, freshness, score, ...). `cut` marks the one row that may enter
    shortened (see `cut_to_fit`). Rows below the relevance floor are about something else and left out.
    """
    plan = pack_plan(reports, task, budget, include_stale, kinds)
    return reports.join(plan.select("path", "relevance", "rank", "cost", "total", "left", "place"), "path")


def cut_to_fit(packed: DataFrame) -> DataFrame:
    """A pack with `content` and `tokens` of the rows that are in it; the row to be cut is omitted where no cut of it fits."""
    cut = F.col("place") == "cut"
    fit = packed.withColumn("_fit", F.when(cut, CUT.fitted(F.col("body"), F.col("left"))))
    fit = fit.withColumn("place", F.when(cut & F.col("_fit.text").isNull(), "omitted").otherwise(F.col("place")))
    whole = F.col("place") == "entry"
    content = F.when(whole, F.col("body")).when(F.col("place") == "cut", F.col("_fit.text"))
    return fit.withColumns({"content": content, "tokens": F.when(whole, F.col("cost")).when(F.col("place") == "cut", F.col("_fit.tokens"))}).drop("_fit")


def left_out(packed: DataFrame, budget: int) -> Column:
    """Why a row of a pack is not in it; null for those that are."""
    text = lambda c: F.col(c).cast("string")
    room = F.lit(f" of {budget} tokens")
    return (
        F.when(F.col("place") == "excluded", F.concat(F.lit("excluded as "), F.col("freshness"), F.lit("; ask for stale documents to include it")))
        .when((F.col("place") == "omitted") & (F.col("left") <= 0), F.concat(F.lit("the budget was used up"), F.lit(f" ({budget} tokens); rank "), F.format_string("%.3f", "rank")))
        # a row with this much room was to be cut; it is left out only where no cut of it fits
        .when((F.col("place") == "omitted") & (F.col("left") >= max(120, budget // 20)), F.concat(F.lit("could not be cut to fit the "), text("left"), room, F.lit(" that were left")))
        .when(F.col("place") == "omitted", F.concat(F.lit("needs about "), text("cost"), F.lit(" tokens, "), text("left"), room, F.lit(" were left")))
    )
