"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each source gets the token target its weight gives it, stopped at ``cap`` times its size.
Document rates start at ``prior`` (1 by default) and are tilted exponentially: rate =
min(cap, prior * exp(lambda of the source)).  The lambdas maximise the dual of the entropy
problem; Newton steps over distributed sums of tokens by source and prior find them.  Rates
become whole copies by systematic rounding inside small groups of documents of like size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.shared import stage

#: Documents of one rounding group, about.
GROUP = 64
MADE = ["size", "source_size", "target", "rate", "copies", "taken"]


def word_count(text):
    """The number of ``[^\\x20\\x09-\\x0D]+`` in a text; null: 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``source, source_size, target`` of rows ``source, source_size`` (one a source, null too).

    Sources by code point, null last, weigh ``weights`` repeating.  ``share`` times all
    tokens are dealt; a target stops at ``cap`` times its source, and the excess is dealt
    again by weight.  With ratio = cap * size / weight, the sources that stop are those of
    the least ratios, so one pass over them in that order settles all rounds of redealing.

    The windows run over the table of sources, which holds one row a source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    total = F.sum("source_size").over(Window.partitionBy())
    w = sizes.withColumn("_i", F.row_number().over(order) - 1).withColumn("_w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_i") % len(weights) + 1).cast("int")))
    w = w.withColumn("_all", share * total).withColumn("_limit", cap * F.col("source_size"))
    by = Window.orderBy(F.col("_limit") / F.col("_w"), "_i")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rest = by.rowsBetween(0, Window.unboundedFollowing)
    # The level at which tokens a unit of weight run out, if all before this source stop.
    level = (F.col("_all") - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / F.sum("_w").over(rest)
    w = w.withColumn("_level", level).withColumn("_stops", F.col("_level") * F.col("_w") >= F.col("_limit"))
    least = F.min(F.when(~F.col("_stops"), F.struct(F.col("_limit") / F.col("_w"), "_i", "_level"))).over(Window.partitionBy())
    w = w.withColumn("_free", least["_level"])
    target = F.when(F.col("_free").isNull(), F.col("_limit")).otherwise(F.least(F.col("_limit"), F.col("_free") * F.col("_w")))
    return w.select("source", "source_size", target.cast("double").alias("target"))


def tilts(mass: DataFrame, cap: float, steps: int = 200, eps: float = 1e-9) -> DataFrame:
    """``source, tilt`` that solve sum(tokens * min(cap, prior * exp(tilt))) = target.

    ``mass`` has ``source, prior, tokens, target``, tokens summed by source and prior.  Each
    Newton step is one aggregation; a step that leaves the bracket of the root is halved
    into it, so capped rates, where the dual has kinks, converge too; brackets of 120 halve to 1e-12
    in 47 steps, and this raises if ``steps`` don't do.
    """
    same = lambda a, b: a.eqNullSafe(b)
    state = stage(mass.groupBy("source").agg(F.first("target").alias("target"), F.sum("tokens").alias("all"), F.sum(F.col("tokens") * F.col("prior")).alias("now")).where("all > 0 and target > 0 and now > 0")
        .select("source", "target", F.lit(-60.0).alias("lo"), F.lit(60.0).alias("hi"), F.lit(0.0).alias("tilt"), F.lit(False).alias("done")), "tilts")
    for _ in range(steps):
        s = state.withColumnRenamed("source", "_s")
        rate = F.col("prior") * F.exp("tilt")
        sums = mass.drop("target").join(s, same(F.col("source"), F.col("_s"))).groupBy("source", "target", "lo", "hi", "tilt", "done").agg(
            F.sum(F.col("tokens") * F.least(F.lit(cap), rate)).alias("f"), F.sum(F.when(rate < cap, F.col("tokens") * rate).otherwise(0.0)).alias("slope"))
        gap = F.col("f") - F.col("target")
        sums = sums.withColumn("lo", F.when(gap <= 0, F.col("tilt")).otherwise(F.col("lo"))).withColumn("hi", F.when(gap >= 0, F.col("tilt")).otherwise(F.col("hi")))
        step = F.col("tilt") - gap / F.col("slope")
        inside = (F.col("slope") > 0) & (step > F.col("lo")) & (step < F.col("hi"))
        ended = F.col("done") | (F.abs(gap) <= eps * F.col("target")) | (F.col("hi") - F.col("lo") < 1e-12)
        state = stage(sums.select("source", "target", "lo", "hi", F.when(ended, F.col("tilt")).when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2).alias("tilt"), ended.alias("done")), "tilts")
        if state.where("not done").isEmpty():
            return state.select("source", "tilt")
    raise ValueError(f"tilts haven't converged in {steps} steps")


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, prior: str | None = None, seed: int = 17) -> DataFrame:
    """How many copies of each document the mix takes.

    Args: ``docs`` with ``doc_id, text, source``; other columns stay.  ``prior`` names a
    column of positive base rates.
    Returns the columns of ``docs`` and ``size, source_size`` longs, ``target, rate`` doubles,
    ``copies`` int and ``taken = copies * size`` (of the same names in ``docs``, ours replace
    them).  The same rows give the same copies in whatever order they come.

    Null and blank texts have size 0 and are taken at their rate, which adds no tokens; null
    is a source of its own, after the others.  A source without tokens has target 0 and
    copies 0.  Rows that repeat a doc_id are documents of their own, each with
    its own copies; of rows equal in doc_id and size any may get the larger number.  An empty table gives none.
    """
    docs = docs.drop(*MADE)
    base = F.lit(1.0) if prior is None else F.col(prior).cast("double")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"), base.alias("prior"))
    return _copies(rows, rows.drop("row"), weights, share, cap, seed).select("row.*", *MADE)


def mix_sizes(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """As ``mix``, but only ``doc_id, source`` and the numbers, without moving any text."""
    small = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.lit(1.0).alias("prior")), "sizes")
    return _copies(small, small, weights, share, cap, seed).select("doc_id", "source", *MADE)


def _copies(rows: DataFrame, small: DataFrame, weights, share: float, cap: float, seed: int) -> DataFrame:
    # By source and class of size (half powers of two) one pass of partial sums.
    band = F.when(F.col("size") > 0, F.floor(2 * F.log2("size"))).otherwise(-1).cast("int")
    strata = stage(small.withColumn("band", band).groupBy("source", "prior", "band").agg(F.count("*").alias("n"), F.sum("size").alias("tokens")), "strata")
    per_source = strata.groupBy("source").agg(F.sum("tokens").alias("source_size"))
    targets = stage(source_targets(per_source, weights, share, cap), "targets")
    t = targets.withColumnRenamed("source", "_t")
    mass = strata.groupBy("source", "prior").agg(F.sum("tokens").cast("double").alias("tokens"))
    mass = stage(mass.join(t, F.col("source").eqNullSafe(F.col("_t"))).select("source", "prior", "tokens", "target"), "mass")
    found = tilts(mass, cap).withColumnRenamed("source", "_s")
    known = strata.join(t, F.col("source").eqNullSafe(F.col("_t"))).drop("_t").join(found, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    rate = F.when(F.col("target") > 0, F.least(F.lit(cap), F.col("prior") * F.exp("tilt"))).otherwise(0.0)
    # Newton stops a hair from whole rates such as the cap; don't round that hair.
    rate = F.when(F.abs(rate - F.round(rate)) < 1e-7, F.round(rate)).otherwise(rate)
    known = stage(known.select(
        F.col("source").alias("_s"), F.col("prior").alias("_p"), F.col("band").alias("_b"), "source_size", "target", F.coalesce(rate, F.lit(0.0)).alias("rate"), F.ceil(F.col("n") / GROUP).alias("salts"),
    ), "rates")
    rows = rows.withColumn("band", band).join(known, F.col("source").eqNullSafe(F.col("_s")) & F.col("prior").eqNullSafe(F.col("_p")) & (F.col("band") == F.col("_b")))
    # Systematic rounding: the i-th document of a group gets the whole numbers that rate * i
    # passes, from a start that the group's hash gives; large documents come first.
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("salts")))
    group = ["source", "prior", "band", "salt"]
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("size"), F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id"))
    start = F.pmod(F.xxhash64(F.lit(seed + 2), *group), F.lit(1 << 20)) / float(1 << 20)
    rows = rows.withColumn("i", place).withColumn("u", start)
    copies = (F.floor(F.col("rate") * F.col("i") + F.col("u")) - F.floor(F.col("rate") * (F.col("i") - 1) + F.col("u"))).cast("int")
    return rows.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
