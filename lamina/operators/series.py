"""Time-series operators on long tables keyed by ``on`` columns, ordered by ``t``, valued ``f``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.columns import robust_denominator


def over(on: list[str], t: str = "t"):
    return Window.partitionBy(*on).orderBy(t)


def add_group(df: DataFrame, on: list[str], **aggs: Column) -> DataFrame:
    """Columns of aggregates of each group, by an aggregation and a join that Spark may broadcast."""
    return df.join(df.groupBy(*on).agg(*[a.alias(k) for k, a in aggs.items()]), on)


def dff(df: DataFrame, on: list[str], f: str = "f", p: float = 0.1, how: str = "floor") -> DataFrame:
    """(f - F0) / denominator with F0 the exact linear percentile p of the whole group."""
    return add_group(df, on, f0=F.percentile(f, p)).withColumn("dff", (F.col(f) - F.col("f0")) / robust_denominator(F.col("f0"), how))


def reflected(df: DataFrame, on: list[str], f: str, half: int, mode: str = "reflect") -> DataFrame:
    """Rows numbered ``i`` from 1 with ``half`` mirrored (or repeated, "nearest") rows beyond each end (``real`` false)."""
    x = df.withColumn("i", F.row_number().over(over(on))).withColumn("n", F.count("*").over(Window.partitionBy(*on))).withColumn("real", F.lit(True))
    cols = [c for c in x.columns if c not in ("i", "real")]
    if mode == "reflect":
        head = x.where(F.col("i") <= half).select(*cols, (1 - F.col("i")).alias("i"), F.lit(False).alias("real"))
        tail = x.where(F.col("i") > F.col("n") - half).select(*cols, (2 * F.col("n") + 1 - F.col("i")).alias("i"), F.lit(False).alias("real"))
    else:
        away = F.explode(F.sequence(F.lit(1), F.lit(half)))
        head = x.where("i = 1").withColumn("_k", away).select(*cols, (1 - F.col("_k")).alias("i"), F.lit(False).alias("real"))
        tail = x.where("i = n").withColumn("_k", away).select(*cols, (F.col("n") + F.col("_k")).alias("i"), F.lit(False).alias("real"))
    return reduce(DataFrame.unionByName, [head, tail], x)


def rolling_mean(df: DataFrame, on: list[str], f: str = "f", size: int = 15, mode: str = "reflect", out: str = "smooth") -> DataFrame:
    """Centred mean of ``size`` samples, ends padded by reflection or by the end value."""
    half = size // 2
    w = Window.partitionBy(*on).orderBy("i").rowsBetween(-half, half)
    return reflected(df, on, f, half, mode).withColumn(out, F.avg(f).over(w)).where("real").drop("i", "n", "real")


def rolling_percentile(df: DataFrame, on: list[str], f: str = "f", size: int = 21, p: float = 0.1, out: str = "base") -> DataFrame:
    half = size // 2
    w = over(on).rowsBetween(-half, half)
    return df.withColumn(out, F.expr(f"percentile({f}, {p})").over(w))


def robust_noise(df: DataFrame, on: list[str], f: str = "f", size: int = 15) -> DataFrame:
    """1.4826 times the median absolute deviation of f minus its rolling mean: ``noise`` of each group."""
    r = rolling_mean(df, on, f, size).withColumn("r", F.col(f) - F.col("smooth"))
    r = add_group(r, on, m=F.median("r"))
    return r.groupBy(*on).agg((1.4826 * F.median(F.abs(F.col("r") - F.col("m")))).alias("noise"))


def rising_edges(df: DataFrame, on: list[str], f: str = "f", share: float = 0.5) -> DataFrame:
    """Samples that cross lo + share * (hi - lo) upwards."""
    x = add_group(df, on, lo=F.min(f), hi=F.max(f)).withColumn("level", F.col("lo") + share * (F.col("hi") - F.col("lo"))).withColumn("before", F.lag(f).over(over(on)))
    return x.where((F.col(f) > F.col("level")) & (F.col("before") <= F.col("level"))).drop("lo", "hi", "before")


def sessions(df: DataFrame, on: list[str], t: str, gap: Column | int | float, out: str = "session") -> DataFrame:
    """Number groups from 1 that a gap in ``t`` greater than ``gap`` parts."""
    w = over(on, t)
    return df.withColumn(out, F.sum(F.when(F.col(t) - F.lag(t).over(w) > gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1)


def runs_of(df: DataFrame, on: list[str], flag: Column, t: str = "t", gap: int = 1, least: int = 1) -> DataFrame:
    """Runs of samples with ``flag``, with steps of at most ``gap``: ``start, stop, length``, at least ``least`` long."""
    x = sessions(df.where(flag), on, t, gap, "run")
    return x.groupBy(*on, "run").agg(F.min(t).alias("start"), F.max(t).alias("stop"), F.count("*").alias("length")).where(F.col("length") >= least)


def average_rank(value: str, part: list[str]) -> Column:
    """The mean rank of ties from 1, as rank tests use it."""
    w = Window.partitionBy(*part)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(w.orderBy(value).rangeBetween(0, 0)) - 1) / 2


def centred(df: DataFrame, on: list[str], f: str, ddof: int = 0) -> DataFrame:
    """f minus its group's mean, and its z-score with ddof 0 or 1."""
    sd = F.stddev_pop(f) if ddof == 0 else F.stddev_samp(f)
    return add_group(df, on, mean=F.avg(f), sd=sd).withColumn("centred", F.col(f) - F.col("mean")).withColumn("z", F.when(F.col("sd") > 0, F.col("centred") / F.col("sd")))


def prefix_sum(df: DataFrame, on: list[str], f: str, out: str = "total") -> DataFrame:
    return df.withColumn(out, F.sum(F.coalesce(F.col(f), F.lit(0.0))).over(over(on).rowsBetween(Window.unboundedPreceding, 0)))


def fill_gaps(df: DataFrame, on: list[str], f: str = "f") -> DataFrame:
    """Every whole t from a group's first to its last, missing values on the line between neighbours."""
    grid = df.groupBy(*on).agg(F.min("t").alias("a"), F.max("t").alias("b")).select(*on, F.explode(F.sequence("a", "b")).alias("t"))
    x = grid.join(df.select(*on, "t", f), [*on, "t"], "left")
    known = F.when(F.col(f).isNotNull(), F.struct("t", f))
    x = x.withColumn("_p", F.last(known, True).over(over(on).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.first(known, True).over(over(on).rowsBetween(0, Window.unboundedFollowing)))
    line = F.col(f"_p.{f}") + (F.col(f"_n.{f}") - F.col(f"_p.{f}")) * (F.col("t") - F.col("_p.t")) / (F.col("_n.t") - F.col("_p.t"))
    return x.select(*on, "t", F.coalesce(f, line).alias(f), F.col(f).isNull().alias("filled"))


def decimate(df: DataFrame, on: list[str], f: str = "f", how: str = "pick") -> DataFrame:
    """Every second sample, or means of pairs without an odd tail."""
    x = df.withColumn("i", F.row_number().over(over(on)) - 1)
    if how == "pick":
        return x.where("i % 2 = 0").select(*on, "t", f)
    return x.groupBy(*on, F.floor(F.col("i") / 2).alias("k")).agg(F.count("*").alias("n"), F.min("t").alias("t"), F.avg(f).alias(f)).where("n = 2").select(*on, "t", f)


def cross_correlation(df: DataFrame, on: list[str], a: str, b: str, reach: int, how: str = "product") -> DataFrame:
    """For lags -reach..reach: sum of a(t + lag) * b(t) ("product") or their correlation ("pearson").

    A positive lag means that a comes later.  Rows of b are spread over the lags and meet a by
    equality of time, so nothing is joined pairwise.
    """
    x = df.select(*on, F.col("t"), a).where(F.col(a).isNotNull())
    y = df.select(*on, F.col("t").alias("tb"), b).where(F.col(b).isNotNull()).withColumn("lag", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("t", F.col("tb") + F.col("lag"))
    j = x.join(y, [*on, "t"])
    value = F.sum(F.col(a) * F.col(b)) if how == "product" else F.corr(a, b)
    return j.groupBy(*on, "lag").agg(value.alias("c"), F.count("*").alias("n"))


def best_lag(xcorr: DataFrame, on: list[str], absolute: bool = False) -> DataFrame:
    """The lag of the largest value (or magnitude), the first at a tie."""
    v = F.abs("c") if absolute else F.col("c")
    return xcorr.where("c is not null").groupBy(*on).agg(F.max(F.struct(v.alias("v"), (-F.col("lag")).alias("k"), F.col("c").alias("c"))).alias("m")).select(*on, (-F.col("m.k")).alias("lag"), F.col("m.c").alias("c"))


def autocorrelation(df: DataFrame, on: list[str], f: str, lags: list[int]) -> DataFrame:
    """Centred product at each lag over the sum of squares, lags counted in t."""
    x = add_group(df, on, mean=F.avg(f)).withColumn("d", F.col(f) - F.col("mean")).select(*on, "t", "d")
    total = x.groupBy(*on).agg(F.sum(F.col("d") * F.col("d")).alias("ss"))
    y = x.withColumn("lag", F.explode(F.array(*[F.lit(k) for k in lags]))).select(*on, (F.col("t") + F.col("lag")).alias("t"), "lag", F.col("d").alias("e"))
    return x.join(y, [*on, "t"]).groupBy(*on, "lag").agg(F.sum(F.col("d") * F.col("e")).alias("s")).join(total, on).select(*on, "lag", (F.col("s") / F.col("ss")).alias("r"))


def block_trend(df: DataFrame, on: list[str], f: str, size: int, p: float = 0.1) -> DataFrame:
    """Bleaching: the slope of block percentiles over the first block's value."""
    b = df.groupBy(*on, F.floor(F.col("t") / size).alias("block")).agg(F.percentile(f, p).alias("v"))
    return b.groupBy(*on).agg((F.regr_slope("v", "block") / F.min_by("v", "block")).alias("trend"), F.count("*").alias("blocks"))


def active_state(df: DataFrame, signals: list[str]) -> DataFrame:
    """``active`` where any signal is above its median; null signals don't count."""
    cuts = df.agg(*[F.median(s).alias(f"_m_{s}") for s in signals])
    flag = reduce(lambda a, b: a | b, [F.coalesce(F.col(s) > F.col(f"_m_{s}"), F.lit(False)) for s in signals])
    return df.join(F.broadcast(cuts)).withColumn("active", flag).drop(*[f"_m_{s}" for s in signals])


def crop_and_scale(df: DataFrame, on: list[str], f: str, t0: float, t1: float) -> DataFrame:
    """Rows with t0 <= t < t1, f divided by the largest value before t1 / 2 of the crop."""
    x = df.where((F.col("t") >= t0) & (F.col("t") < t1))
    return add_group(x, on, top=F.max(F.when(F.col("t") < (t0 + t1) / 2, F.col(f)))).withColumn("scaled", F.col(f) / F.nullif("top", F.lit(0.0)))


def smooth_kernel(df: DataFrame, on: list[str], f: str, kernel: list[float], out: str = "smooth") -> DataFrame:
    """Convolution with a fixed odd kernel over neighbouring rows, renewed at the ends."""
    w, h = over(on), len(kernel) // 2
    at = [(F.lag(f, h - i).over(w) if i <= h else F.lead(f, i - h).over(w), k) for i, k in enumerate(kernel)]
    return df.withColumn(out, sum((F.coalesce(v * k, F.lit(0.0)) for v, k in at), F.lit(0.0)) / sum((F.when(v.isNotNull(), k).otherwise(0.0) for v, k in at), F.lit(0.0)))
