"""Joins of independent record sources: by fingerprint, band, nearest event and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.sources.readers import staged


def fingerprint_match(units: DataFrame, runs: DataFrame) -> DataFrame:
    """Pair ``units(session, unit, key, hint)`` with ``runs(session, run, key, number)`` by key.

    A key that one unit and one run of a session have is exact.  Other keys pair first where the
    unit's hint is the run's number, then by order among what is left.  All rows are kept:
    ``session, unit, run, confidence``, with an unpaired side null.
    """
    k = ["session", "key"]
    count = lambda df, c: df.withColumn(f"n_{c}", F.count("*").over(Window.partitionBy(*k)))
    # Many joins read both sides, so each is computed once.
    u, r = staged(count(units, "u"), "units"), staged(count(runs, "r"), "runs")
    both = u.join(r, k)
    exact = both.where("n_u = 1 and n_r = 1").select("session", "unit", "run", F.lit("fingerprint_exact").alias("confidence"))
    # One unit and one run a hint, the first of each, so pairs are one to one.
    hinted = both.where("(n_u > 1 or n_r > 1) and hint = number")
    hinted = hinted.groupBy(*k, "hint").agg(F.min("unit").alias("unit"), F.min("run").alias("run")).select("session", "unit", "run", F.lit("fingerprint+comment_run").alias("confidence"))
    done = staged(exact.unionByName(hinted), "matched")
    left_u = u.join(done.select("session", "unit"), ["session", "unit"], "left_anti").withColumn("i", F.row_number().over(Window.partitionBy(*k).orderBy("unit")))
    left_r = r.join(done.select("session", "run"), ["session", "run"], "left_anti").withColumn("i", F.row_number().over(Window.partitionBy(*k).orderBy("run")))
    ordered = left_u.join(left_r, [*k, "i"]).select("session", "unit", "run", F.lit("fingerprint+order").alias("confidence"))
    done = staged(done.unionByName(ordered), "matched")
    rest_u = u.join(done.select("session", "unit"), ["session", "unit"], "left_anti").select("session", "unit", F.lit(None).cast(runs.schema["run"].dataType).alias("run"), F.lit("no_run").alias("confidence"))
    rest_r = r.join(done.select("session", "run"), ["session", "run"], "left_anti").select("session", F.lit(None).cast(units.schema["unit"].dataType).alias("unit"), "run", F.lit("no_unit").alias("confidence"))
    return done.unionByName(rest_u).unionByName(rest_r)


def order_fallback(a: DataFrame, b: DataFrame, tolerance: float = 1.5) -> DataFrame:
    """Zip ``a(session, a_id, duration)`` and ``b(session, b_id, duration)`` by order, only in sessions
    where both have as many and all durations differ by less than ``tolerance``."""
    w = lambda c: Window.partitionBy("session").orderBy(c)
    n = Window.partitionBy("session")
    x = a.select("session", "a_id", F.col("duration").alias("da"), F.row_number().over(w("a_id")).alias("i"), F.count("*").over(n).alias("na"))
    y = b.select("session", "b_id", F.col("duration").alias("db"), F.row_number().over(w("b_id")).alias("i"), F.count("*").over(n).alias("nb"))
    z = x.join(y, ["session", "i"]).where("na = nb").withColumn("ok", F.every(F.abs(F.col("da") - F.col("db")) < tolerance).over(n))
    return z.where("ok").select("session", "a_id", "b_id")


def sole_leftovers(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pair by elimination: sessions with exactly one leftover on each side."""
    one = lambda df, c: df.groupBy("session").agg(F.count("*").alias("n"), F.first(c).alias(c)).where("n = 1").drop("n")
    return one(a, "a_id").join(one(b, "b_id"), "session")


def band_join(a: DataFrame, b: DataFrame, on: list[str], x: str, y: str, lo: float, hi: float, how: str = "inner") -> DataFrame:
    """Rows with lo <= b.y - a.x <= hi and equal ``on``, as an equi-join on buckets of y.

    Buckets are as wide as the band, so each row of a looks into two; a key with many rows is
    spread over its buckets.  ``how``: inner, left_semi or left_anti.
    """
    width = max(hi - lo, 1e-9)
    bucket = lambda c: F.floor(c / width)
    right = b.withColumn("_bucket", bucket(F.col(y)))
    wide = a.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(x) + lo), bucket(F.col(x) + hi))))
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in right.columns])
    cond = [F.col(c) == F.col(f"_r_{c}") for c in [*on, "_bucket"]] + [(F.col(f"_r_{y}") - F.col(x)).between(lo, hi)]
    if how == "inner":
        keep = [c for c in b.columns if c not in on]
        return wide.join(r, cond).select(*a.columns, *[F.col(f"_r_{c}").alias(c) for c in keep])
    # A row meets its partners in one of its buckets; any of them decides.
    met = wide.join(r, cond, "left_semi").select(*a.columns).distinct()
    return met if how == "left_semi" else a.join(met, a.columns, "left_anti")


def nearest_event(a: DataFrame, b: DataFrame, on: list[str], x: str, y: str, reach: float) -> DataFrame:
    """For each row of a the nearest y of b within ``reach``, earliest at a tie; dt = y - x; dt 0 is dropped."""
    pairs = band_join(a, b, on, x, y, -reach, reach)
    dt = F.col(y) - F.col(x)
    best = pairs.groupBy(*on, x).agg(F.min(F.struct(F.abs(dt).alias("far"), F.col(y).alias("at"))).alias("m"))
    return best.select(*on, x, F.col("m.at").alias(y), (F.col("m.at") - F.col(x)).alias("dt")).where("dt <> 0")


def mutual_nearest(a: DataFrame, b: DataFrame, on: list[str], x: str, y: str, lo: float, hi: float) -> DataFrame:
    """One-to-one pairs that are each other's nearest with lo <= y - x <= hi (a SQL form of a greedy
    pairing; it differs where contention chains)."""
    p = band_join(a, b, on, x, y, lo, hi).withColumn("_far", F.abs(F.col(y) - F.col(x)))
    best_a = p.groupBy(*on, x).agg(F.min_by(y, F.struct("_far", y)).alias(y))
    best_b = p.groupBy(*on, y).agg(F.min_by(x, F.struct("_far", x)).alias(x))
    return best_a.join(best_b, [*on, x, y])


def greedy_pairs(a: DataFrame, b: DataFrame, on: list[str], x: str, y: str, lo: float, hi: float, also: Column | None = None) -> DataFrame:
    """One-to-one pairs ``on, x, y``: in order of y each row of b takes the nearest x that is still free
    with lo <= y - x <= hi, and ``also`` (a condition on columns of both) true or null.  Times are distinct
    inside ``on``.

    Only rows that contend are handled together: a chain ends where no later y reaches an x that an
    earlier one reaches.
    """
    fits = F.lit(True) if also is None else F.coalesce(also, F.lit(True))
    free = F.sort_array(F.collect_list(F.when(fits, F.col(x))), asc=False)
    reach = band_join(a, b, on, x, y, lo, hi).groupBy(*on, y).agg(free.alias("_xs"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    w = Window.partitionBy(*on).orderBy(y)
    # Chains go by all times in reach: one that ``also`` refuses to this row may be free to a later one.
    before = F.max("_hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    chains = reach.withColumn("_new", (F.coalesce(F.col("_lo") > before, F.lit(True))).cast("long")).withColumn("_chain", F.sum("_new").over(w))
    g = chains.groupBy(*on, "_chain").agg(F.array_sort(F.collect_list(F.struct(F.col(y).alias("y"), F.col("_xs").alias("xs")))).alias("_all"))
    none = F.transform(F.slice("_all", 1, 0), lambda r: F.struct(F.get(r["xs"], F.lit(0)).alias("x"), r["y"].alias("y")))

    def take(done, r):
        free = F.get(F.filter(r["xs"], lambda v: ~F.exists(done, lambda p: p["x"] == v)), F.lit(0))
        return F.when(free.isNull(), done).otherwise(F.concat(done, F.array(F.struct(free.alias("x"), r["y"].alias("y")))))

    return g.select(*on, F.explode(F.aggregate("_all", none, take)).alias("_p")).select(*on, F.col("_p.x").alias(x), F.col("_p.y").alias(y))


def nearest_donor(missing: DataFrame, donors: DataFrame, on: list[str], t: str, value: str) -> DataFrame:
    """The value of the donor nearest in time, by the last before and the first after; earlier wins a tie."""
    u = missing.select(*on, t, F.lit(None).cast(donors.schema[value].dataType).alias(value), F.lit(True).alias("_ask")).unionByName(donors.select(*on, t, value, F.lit(False).alias("_ask")))
    w = Window.partitionBy(*on).orderBy(t, "_ask")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(~F.col("_ask"), F.struct(F.col(t).alias("t"), F.col(value).alias("v")))
    u = u.withColumn("_p", F.last(known, True).over(back)).withColumn("_n", F.first(known, True).over(ahead)).where("_ask")
    early = F.col("_n").isNull() | (F.col(t) - F.col("_p.t") <= F.col("_n.t") - F.col(t))
    return u.select(*on, t, F.when(F.col("_p").isNotNull() & early, F.col("_p.v")).otherwise(F.col("_n.v")).alias(value))


def interpolate_at(samples: DataFrame, grid: DataFrame, on: list[str], t: str, v: str) -> DataFrame:
    """The value at grid times by linear interpolation of non-null samples, held at the ends.

    One window over the union of both sides, so nothing is joined pairwise; repeated sample
    times count by their mean.
    """
    s = samples.where(F.col(v).isNotNull()).groupBy(*on, t).agg(F.avg(v).alias(v))
    u = s.select(*on, t, v, F.lit(0).alias("_grid")).unionByName(grid.select(*on, t, F.lit(None).cast("double").alias(v), F.lit(1).alias("_grid")))
    w = Window.partitionBy(*on).orderBy(t, "_grid")
    known = F.when(F.col(v).isNotNull(), F.struct(F.col(t).alias("t"), F.col(v).alias("v")))
    u = u.withColumn("_p", F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * (F.col(t) - F.col("_p.t")) / (F.col("_n.t") - F.col("_p.t"))
    out = F.when(F.col("_p").isNull(), F.col("_n.v")).when(F.col("_n").isNull() | (F.col("_p.t") == F.col(t)), F.col("_p.v")).otherwise(line)
    return u.where("_grid = 1").select(*on, t, out.alias(v))


def range_average(samples: DataFrame, grid: DataFrame, on: list[str], t: str, v: str, half: float) -> DataFrame:
    """The mean of samples in [t - half, t + half) at grid times; nulls count as 0, none gives 0."""
    pairs = band_join(grid.select(*on, F.col(t).alias("_t")), samples.select(*on, F.col(t).alias("_s"), v), on, "_t", "_s", -half, half).where(F.col("_s") < F.col("_t") + half)
    got = pairs.groupBy(*on, "_t").agg((F.sum(F.coalesce(v, F.lit(0.0))) / F.greatest(F.count("*"), F.lit(1))).alias(v))
    return grid.select(*on, t).join(got.withColumnRenamed("_t", t), [*on, t], "left").select(*on, t, F.coalesce(v, F.lit(0.0)).alias(v))


def pulses_to_volumes(trace: DataFrame, on: list[str], t: str, v: str, planes: int) -> DataFrame:
    """Volume k spans rising edges k * planes to k * planes + planes - 1; its time is their middle.

    An edge crosses halfway between the least and largest value; an incomplete tail is dropped.
    """
    span = Window.partitionBy(*on)
    w = Window.partitionBy(*on).orderBy(t)
    level = (F.min(v).over(span) + F.max(v).over(span)) / 2
    x = trace.withColumn("_l", level).withColumn("_b", F.lag(v).over(w))
    edges = x.where((F.col(v) > F.col("_l")) & (F.col("_b") <= F.col("_l"))).withColumn("k", F.floor((F.row_number().over(w) - 1) / planes))
    return edges.groupBy(*on, "k").agg(F.count("*").alias("n"), ((F.min(t) + F.max(t)) / 2).alias("mid")).where(F.col("n") == planes).drop("n")


def claim_once(wants: DataFrame, owner: str, thing: str, rank: str) -> DataFrame:
    """Two phases of claims: each thing goes to its best-ranked owner, then owners left without take
    their best-ranked of the things still free."""
    first = wants.withColumn("_i", F.row_number().over(Window.partitionBy(thing).orderBy(rank, owner))).where("_i = 1")
    first = first.withColumn("_j", F.row_number().over(Window.partitionBy(owner).orderBy(rank, thing))).where("_j = 1").select(owner, thing, F.lit(1).alias("phase"))
    rest = wants.join(first.select(owner), owner, "left_anti").join(first.select(thing), thing, "left_anti")
    second = rest.withColumn("_i", F.row_number().over(Window.partitionBy(thing).orderBy(rank, owner))).where("_i = 1")
    second = second.withColumn("_j", F.row_number().over(Window.partitionBy(owner).orderBy(rank, thing))).where("_j = 1").select(owner, thing, F.lit(2).alias("phase"))
    return first.unionByName(second)


def best_and_runner_up(scores: DataFrame, key: str, candidate: str, score: str, factor: float = 5.0) -> DataFrame:
    """The least score of each key, the next, and whether the match is weak (next < factor * best)."""
    # Ranks up to 2 are cut before the shuffle, so a key with many scores sends two from each task.
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(score).asc_nulls_last(), candidate))
    two = scores.select(key, candidate, score).withColumn("_i", rank).where("_i <= 2")
    pick = lambda i, c: F.max(F.when(F.col("_i") == i, F.col(c)))
    top = two.groupBy(key).agg(pick(1, candidate).alias(candidate), pick(1, score).alias("best"), pick(2, score).alias("runner_up"))
    return top.withColumn("weak", F.coalesce(F.col("runner_up") < factor * F.col("best"), F.lit(False)))


def keep_latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key (an upsert of a union)."""
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_i = 1").drop("_i")
