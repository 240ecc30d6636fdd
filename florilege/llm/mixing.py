"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Sources in code-point order (null last) weigh 5, 2, 1, repeating; together their targets are the
words of the corpus; a target stops at `cap` times its source's size and the excess is reshared by
weight. Each source's document rates minimise the relative entropy to one copy each under its token
constraint: rate = min(cap, exp(lambda * size / mean size)), with lambda from safeguarded Newton steps
on the dual, all of them one expression over a source's histogram of sizes, until the source meets its
constraint (halving from NEWTON_STEPS on; an error if it never does). Rates are rounded to whole
copies by a hash of the row, `cap` at most. What a source's copies then miss or exceed is made up by
one copy more or less of documents: in hash order, as far as an exact prefix sum of their sizes fits
in it; the rest in the same way from one class of sizes after the other (powers of two, the largest
first), so that there are at most as many rounds as classes, whatever the number of documents. No text
is cut and no document changes by more than one copy, so a source stays off its target by less than
twice the least change that is left.

Defined cases: null text has size 0 and is taken 0 times; a null source is a source, last in order;
a source without words has target 0; equal rows are separate documents that round alike; no rows
give no rows; other columns are not read by `mix` and are kept by `mixed_copies`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.llm.common import WORD, checkpoint, stored

WEIGHTS = (5, 2, 1)
CAP = 3.0
TOLERANCE = 1e-9
NEWTON_STEPS = 40  # from then on the interval is halved
MOST_STEPS = 1_200  # halving any interval of doubles ends before; more is an error
BROADCAST_SOURCES = 50_000  # rates of at most so many sources go out as a broadcast; more are joined by a shuffle


def _prefix(rows: DataFrame, order: list, **sums) -> DataFrame:
    """Adds each of `sums` over all rows before a row in `order`, by range partitions, so that no task holds all rows."""
    parts = checkpoint(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = parts.groupBy("_part").agg(*[F.sum(x).alias(f"_{n}") for n, x in sums.items()])
    # one row for each partition: as many rows as spark.sql.shuffle.partitions at most
    before = totals.select("_part", *[(F.sum(f"_{n}").over(Window.orderBy("_part")) - F.col(f"_{n}")).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = parts.join(F.broadcast(before), "_part").withColumns({n: F.coalesce(F.sum(x).over(inside), F.lit(0)) + F.col(f"_{n}") for n, x in sums.items()})
    return found.drop("_part", *[f"_{n}" for n in sums])


def targets(sources: DataFrame, cap: float = CAP) -> DataFrame:
    """Adds `target` to sources(source, source_size, ...).

    Sources in order of how soon they are full, `cap` sizes by weight: one is full if what the full
    ones before it leave, dealt over all open weights, is its most or more.
    """
    ranked = _prefix(sources, [F.col("source").asc_nulls_last()], at=F.lit(1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod("at", F.lit(len(WEIGHTS))) + 1).cast("int"))
    most = F.lit(cap) * F.col("source_size")
    ranked = checkpoint(ranked.withColumn("weight", weight).withColumn("_most", most).drop("at"))
    total, weights = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    order = [(F.col("_most") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    filled = checkpoint(_prefix(ranked, order, _held=F.col("_most"), _taken=F.col("weight")))
    full = F.col("_most") * (F.lit(weights) - F.col("_taken")) <= F.col("weight") * (F.lit(total) - F.col("_held"))
    held, taken = filled.agg(F.sum(F.when(full, F.col("_most"))), F.sum(F.when(full, F.col("weight")))).first()
    open_weight = (weights or 0.0) - (taken or 0.0)
    level = ((total or 0) - (held or 0.0)) / open_weight if open_weight > 0.5 else math.inf
    return filled.withColumn("target", F.least(F.col("_most"), F.col("weight") * F.lit(level)).cast("double")).drop("_most", "_held", "_taken")


def _stepped(s: Column, step: Column, cap: float) -> Column:
    """The state (solved, lo, hi, lam) of a source after one more step over its `points`; an expression, so that all steps are one plan."""
    rates = F.transform(
        "points",
        lambda p: F.struct(
            (p["size"] * p["n"]).alias("words"), (p["size"] / F.col("mean")).alias("x"), F.least(F.lit(cap), F.exp(s["lam"] * p["size"] / F.col("mean"))).alias("rate")
        ),
    )
    sums = F.aggregate(
        rates,
        F.struct(F.lit(0.0).alias("got"), F.lit(0.0).alias("slope")),
        lambda a, p: F.struct(
            (a["got"] + p["words"] * p["rate"]).alias("got"), (a["slope"] + F.when(p["rate"] < cap, p["words"] * p["x"] * p["rate"]).otherwise(0.0)).alias("slope")
        ),
    )

    def moved(t: Column) -> Column:
        miss = t["got"] - F.col("target")
        done = F.abs(miss) <= TOLERANCE * F.col("target")
        lo, hi = F.when(miss < 0, s["lam"]).otherwise(s["lo"]), F.when(miss > 0, s["lam"]).otherwise(s["hi"])
        newton = s["lam"] - miss / F.nullif(t["slope"], F.lit(0.0))
        inside = (step <= NEWTON_STEPS) & (t["slope"] > 0) & (newton > lo) & (newton < hi)
        # an interval as narrow as its numbers' last digits is as near as numbers come
        narrow = (step % 4 == 0) & (hi - lo <= 1e-15 * F.greatest(F.abs(lo), F.abs(hi)))
        lam = F.when(done, s["lam"]).when(inside, newton).otherwise((lo + hi) / 2)
        return F.struct((done | narrow).alias("solved"), lo.alias("lo"), hi.alias("hi"), lam.alias("lam"))

    return F.transform(F.array(sums), moved)[0]


def _rates(sizes: DataFrame, cap: float) -> DataFrame:
    """(source, source_size, target, lam, mean) by Newton steps on the dual."""
    hist = checkpoint(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    stats = hist.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least")
    )
    state = targets(stats, cap)
    mean = F.when(F.col("source_size") > 0, F.col("source_size") / F.col("docs")).otherwise(F.lit(1.0))
    least = F.coalesce(F.col("least"), F.lit(1)) / F.col("mean")
    state = state.withColumn("mean", mean).withColumn("solved", (F.col("source_size") == 0) | (F.col("target") >= cap * F.col("source_size")))
    state = (
        state.withColumn("lo", F.when(F.col("solved"), F.lit(0.0)).otherwise(F.least(F.lit(0.0), F.log(F.greatest(F.col("target") / F.col("source_size"), F.lit(1e-300))) / least)))
        .withColumn("hi", F.lit(math.log(cap)) / least)
        .withColumn("lam", F.when(F.col("solved"), F.col("hi")).otherwise(F.lit(0.0)))
        .select("source", "source_size", "target", "mean", "solved", "lo", "hi", "lam")
    )
    # a source's distinct sizes: fewer than the square root of twice its words
    points = hist.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("size", "n"))).alias("points"))
    start = F.struct("solved", "lo", "hi", "lam")
    found = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_STEPS)), start, lambda s, step: F.when(s["solved"], s).otherwise(_stepped(s, step, cap)))
    points = points.withColumnRenamed("source", "key")
    state = checkpoint(state.join(points, F.col("source").eqNullSafe(F.col("key"))).select("source", "source_size", "target", "mean", found.alias("found")))
    if state.where("not found.solved").limit(1).count():
        raise RuntimeError("the rates of some sources did not settle")
    return state.select("source", "source_size", "target", "mean", F.round("found.lam", 12).alias("lam"))


def sized(docs: DataFrame) -> DataFrame:
    """Adds `size` in words and `h`, by which a row is rounded and takes its turn."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumn("size", size).withColumn("h", F.xxhash64(F.col("doc_id").cast("long"), F.col("text"), F.lit("mix")))


def mix(docs: DataFrame, cap: float = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken, rate for every row of docs(doc_id, source, text)."""
    sizes = checkpoint(sized(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size", "h"))
    taken = _taken(sizes, _plan(sizes, cap), cap)
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "source")


def _few(sources: DataFrame) -> bool:
    """Asked once of the sources, as each count of a table that is not written yet is one more run of its whole plan."""
    return sources.count() <= BROADCAST_SOURCES


def _with(rows: DataFrame, sources: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """rows with the columns of their source."""
    sources = sources.withColumnRenamed("source", "key")
    sources = F.broadcast(sources) if few else sources
    return rows.join(sources, F.col("source").eqNullSafe(F.col("key")), how).drop("key")


def _rounded(rows: DataFrame, cap: float) -> DataFrame:
    """Adds `rate` and `copies`, the rate rounded to a whole number."""
    rate = F.when(F.col("target") >= cap * F.col("source_size"), F.lit(cap)).otherwise(F.least(F.lit(cap), F.exp(F.col("lam") * F.col("size") / F.col("mean"))))
    dither = F.pmod(F.xxhash64("h"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    copies = F.when(F.col("size") > 0, F.least(F.lit(int(cap)).cast("long"), F.floor(F.col("rate") + dither))).otherwise(F.lit(0))
    return rows.withColumn("rate", rate).withColumn("copies", copies.cast("long"))


def _class():
    """The power of two that a row's size has reached: 0 for one word, 1 for two or three."""
    return F.length(F.bin("size")) - 1


def _changed():
    """Is one copy more or less of a row taken? Its hash is up to that of a fill for its class, or for all (-1)."""
    turn = F.exists("fills", lambda f: ((f["class"] == -1) | (f["class"] == _class())) & (F.col("h") <= f["until"]) & (F.col("size") <= f["most"]))
    return F.coalesce(turn, F.lit(False))


def _can_change(cap: float):
    return (F.col("sign") != 0) & (F.col("size") > 0) & (F.col("copies") + F.col("sign")).between(0, int(cap))


def _fill(plan: DataFrame, rows: DataFrame, few: bool) -> DataFrame:
    """plan after one more fill, of its class `next`, by rows(source, h, words, left): in hash order, as far as their words' exact prefix sum fits in what is left."""
    rows = rows.withColumn("bucket", F.shiftright("h", 52))
    # at most 4,096 buckets of a source
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    buckets = rows.groupBy("source", "bucket", "left").agg(F.sum("words").alias("words"), F.max("h").alias("last")).withColumn("sum", F.sum("words").over(upto))
    full = F.col("sum") <= F.col("left")
    ends = buckets.groupBy("source").agg(
        F.max(F.when(full, F.col("last"))).alias("whole_until"), F.coalesce(F.max(F.when(full, F.col("sum"))), F.lit(0)).alias("whole_words"), F.min(F.when(~full, F.col("bucket"))).alias("split")
    )
    ends = checkpoint(ends)
    # the rows of one bucket of a source
    turns = Window.partitionBy("source").orderBy("h").rangeBetween(Window.unboundedPreceding, 0)
    inner = _with(rows, ends, few).where(F.col("bucket") == F.col("split")).withColumn("sum", F.col("whole_words") + F.sum("words").over(turns)).where(F.col("sum") <= F.col("left"))
    inner = inner.groupBy("source").agg(F.max("h").alias("inner_until"), F.max("sum").alias("inner_words"))
    ends = _with(ends, inner, few, "left").select("source", F.coalesce("inner_until", "whole_until").alias("until"), F.coalesce("inner_words", "whole_words").alias("made_up"))
    filled = F.array_append("fills", F.struct(F.col("next").alias("class"), "until", F.col("left").alias("most")))
    plan = _with(plan, ends, few, "left").withColumn("fills", F.when(F.col("until").isNull(), F.col("fills")).otherwise(filled))
    return plan.withColumn("left", F.col("left") - F.coalesce("made_up", F.lit(0))).drop("until", "made_up")


def _plan(sizes: DataFrame, cap: float) -> DataFrame:
    """The rates, and what makes up for their rounding: `sign` and `fills`; `left` stays open.

    The first fill is of rows of all sizes. What it leaves is less than one row; it is filled by classes
    of sizes, the largest first, each class of a source once: one round for each power of two at most.
    """
    rates = _rates(sizes, cap).select("source", "source_size", "target", "mean", "lam")
    few = _few(rates)
    units = sizes.where("size > 0").groupBy("source", "h", "size").agg(F.count(F.lit(1)).alias("n"))
    words = F.col("size") * F.col("n")
    units = checkpoint(_rounded(_with(units, rates, few), cap).select("source", "h", "size", "copies", words.alias("words")))
    got = units.groupBy("source").agg(F.sum(F.col("copies") * F.col("words")).alias("got"))
    miss = F.col("target") - F.coalesce("got", F.lit(0))
    plan = _with(rates, got, few, "left").withColumns({"sign": F.signum(F.round(miss, 3)).cast("int"), "left": F.abs(miss), "next": F.lit(-1)}).drop("got")
    plan = checkpoint(plan.withColumn("fills", F.array().cast("array<struct<class:int,until:bigint,most:double>>")))

    free = checkpoint(_with(units, plan.select("source", "sign"), few).where(_can_change(cap)).select("source", "h", "size", "words"))
    plan = checkpoint(_fill(plan, _with(free, plan.select("source", "left"), few).where(F.col("size") <= F.col("left")), few))
    rest = checkpoint(_with(free, plan.select("source", "fills"), few).where(~_changed()).select("source", "h", "size", "words", _class().alias("class")))
    stock = rest.groupBy("source", "class").agg(F.min("words").alias("least")).groupBy("source").agg(F.collect_list(F.struct("class", "least")).alias("stock"))
    fits = F.filter("stock", lambda x: (x["class"] < F.col("next")) & (x["least"] <= F.col("left")))
    choice = F.array_max(F.transform(fits, lambda x: x["class"]))
    plan = checkpoint(_with(plan.withColumn("next", F.lit(64)), stock, few, "left").withColumn("next", choice))
    while plan.where("next is not null").limit(1).count():
        rows = _with(rest, plan.select("source", "left", "next"), few).where((F.col("class") == F.col("next")) & (F.col("words") <= F.col("left")))
        # stored, as the constraints that a checkpoint keeps would double with each round
        plan = stored(_fill(plan, rows, few).withColumn("next", choice))
    return plan.drop("next", "stock")


def _taken(sizes: DataFrame, plan: DataFrame, cap: float) -> DataFrame:
    """sizes with its source's plan, `rate` and the whole `copies`."""
    rows = _rounded(_with(sizes, plan, _few(plan)), cap)
    return rows.withColumn("copies", F.when(_can_change(cap) & _changed(), F.col("copies") + F.col("sign")).otherwise(F.col("copies")))


def mixed_copies(docs: DataFrame, cap: float = CAP) -> DataFrame:
    """The mix itself: docs repeated as whole copies."""
    own = sized(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "text"))
    plan = _plan(checkpoint(own.select("doc_id", "source", "size", "h")), cap)
    out = _taken(own, plan, cap).where("copies > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return out.select("row.*")
