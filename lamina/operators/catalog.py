"""Catalogs of recordings, per-run metrics and fits that compose the other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def load_catalog(rows: DataFrame, keep: Column, unit: list[str], order: list[str], fingerprint: list[str]) -> DataFrame:
    """One row a unit (the first by ``order``, of equal ones the least in all columns) of those to keep, with a ``fingerprint`` of some columns."""
    first = F.min_by(F.struct(*rows.columns), F.struct(*order, *[c for c in rows.columns if c not in order]))
    one = rows.where(keep).groupBy(*unit).agg(first.alias("_row")).select("_row.*")
    return one.withColumn("fingerprint", F.concat_ws("|", *[F.col(c).cast("string") for c in fingerprint]))


def two_key_lookup(left: DataFrame, right: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """``value`` of the row that shares ``first``, else of the one that shares ``second`` (the least of several)."""
    by = lambda key: right.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(f"_{key}"))
    out = left.join(by(first), first, "left").join(by(second), second, "left")
    return out.withColumn(value, F.coalesce(f"_{first}", f"_{second}")).drop(f"_{first}", f"_{second}")


def reason_phrases(df: DataFrame, z: dict[str, Column], least: float = 2.0, most: int = 3) -> DataFrame:
    """``reasons``: the names of the ``most`` largest z above ``least``, largest first."""
    parts = F.array(*[F.struct((-v).alias("z"), F.lit(k).alias("name")) for k, v in z.items()])
    worst = F.slice(F.array_sort(F.filter(parts, lambda x: x["z"] < -least)), 1, most)
    return df.withColumn("reasons", F.array_join(F.transform(worst, lambda x: x["name"]), ", "))


def tier(p: Column) -> Column:
    """Quarters of a probability, as 1 to 4."""
    return F.when(p.isNull(), None).when(p < 0.25, 1).when(p < 0.5, 2).when(p < 0.75, 3).otherwise(4)


def floor_p(p: Column) -> Column:
    """A p-value of 0 as the least that a report states."""
    return F.when(p == 0, 1e-300).otherwise(p)


def bracketed(coupled: Column, observed: Column, independent: Column) -> Column:
    return (coupled < observed) & (observed < independent)


def decay_fit(points: DataFrame, on: list[str], t: str, y: str, taus: list[float], least: float = 0.6) -> DataFrame:
    """``a, b, tau, r2`` of y = a + b exp(-t / tau), tau from a grid; null tau where r2 is below ``least``.

    For one tau the fit is linear, so each grid point is a regression by partial sums.
    """
    e = points.withColumn("tau", F.explode(F.array(*[F.lit(float(x)) for x in taus]))).withColumn("_e", F.exp(-F.col(t) / F.col("tau")))
    fits = e.groupBy(*on, "tau").agg(F.regr_intercept(y, "_e").alias("a"), F.regr_slope(y, "_e").alias("b"), F.regr_r2(y, "_e").alias("r2"))
    best = fits.where("r2 is not null").groupBy(*on).agg(F.max(F.struct("r2", (-F.col("tau")).alias("_m"), "a", "b")).alias("x"))
    return best.select(*on, "x.a", "x.b", F.when(F.col("x.r2") >= least, -F.col("x._m")).alias("tau"), "x.r2")


def rise_time(trace: DataFrame, on: list[str], t: str, f: str) -> DataFrame:
    """``peak, t10, t90, rise`` before each group's first maximum: the last times below 10 and 90 % of the range."""
    top = trace.groupBy(*on).agg(F.min_by(t, F.struct((-F.col(f)).alias("v"), F.col(t).alias("t"))).alias("peak"), F.min(f).alias("_lo"), F.max(f).alias("_hi"))
    x = trace.join(top, on).where(F.col(t) < F.col("peak"))
    below = lambda p: F.max(F.when(F.col(f) < F.col("_lo") + p * (F.col("_hi") - F.col("_lo")), F.col(t)))
    return x.groupBy(*on, "peak").agg(below(0.1).alias("t10"), below(0.9).alias("t90")).withColumn("rise", F.col("t90") - F.col("t10"))


def boundary_runs(df: DataFrame, on: list[str], t: str, flag: Column) -> DataFrame:
    """``head, tail``: how many rows in a row carry the flag at each end of a group."""
    w = Window.partitionBy(*on)
    x = df.withColumn("_f", F.coalesce(flag, F.lit(False)))
    x = x.withColumn("_i", F.row_number().over(w.orderBy(t))).withColumn("_n", F.count("*").over(w))
    g = x.groupBy(*on).agg(F.min(F.when(~F.col("_f"), F.col("_i"))).alias("_a"), F.max(F.when(~F.col("_f"), F.col("_i"))).alias("_b"), F.max("_n").alias("_n"))
    return g.select(*on, F.coalesce(F.col("_a") - 1, F.col("_n")).alias("head"), F.coalesce(F.col("_n") - F.col("_b"), F.col("_n")).alias("tail"))


def greedy_suppression(df: DataFrame, on: list[str], order: list[Column], axes: list[str], box: int, most: int = 8) -> DataFrame:
    """The first ``most`` rows of each group by ``order`` that lie outside the box of an accepted one.

    Returns ``on, place, *axes``.  The fold runs over a group's candidates, which must fit a task.
    """
    items = F.transform(F.array_sort(F.collect_list(F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)], *axes))), lambda x: F.struct(*[x[a].alias(a) for a in axes]))

    def near(p, q):
        hit = F.lit(True)
        for a in axes:
            hit = hit & (F.abs(p[a] - q[a]) <= box)
        return hit

    g = df.groupBy(*on).agg(items.alias("_all"))
    empty = F.slice(F.col("_all"), 1, 0)
    kept = F.aggregate("_all", empty, lambda s, x: F.when((F.size(s) < most) & ~F.exists(s, lambda q: near(x, q)), F.concat(s, F.array(x))).otherwise(s))
    return g.select(*on, F.posexplode(kept).alias("place", "_p")).select(*on, (F.col("place") + 1).alias("place"), "_p.*")


def principal_axis(df: DataFrame, on: list[str], x: str, y: str) -> DataFrame:
    """``angle`` of the first principal axis of points and ``share``, its part of the variance."""
    g = df.groupBy(*on).agg(F.var_pop(x).alias("a"), F.var_pop(y).alias("c"), F.covar_pop(x, y).alias("b"))
    half = F.sqrt(((F.col("a") - F.col("c")) / 2) ** 2 + F.col("b") ** 2)
    return g.select(*on, (F.atan2(2 * F.col("b"), F.col("a") - F.col("c")) / 2).alias("angle"), (((F.col("a") + F.col("c")) / 2 + half) / F.nullif(F.col("a") + F.col("c"), F.lit(0.0))).alias("share"))


def mahalanobis(df: DataFrame, on: list[str], x: str, y: str) -> DataFrame:
    """Rows with ``d2``, their squared distance from their group's mean in units of its covariance."""
    g = df.groupBy(*on).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.var_samp(x).alias("_a"), F.var_samp(y).alias("_c"), F.covar_samp(x, y).alias("_b"))
    u, v = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    det = F.nullif(F.col("_a") * F.col("_c") - F.col("_b") ** 2, F.lit(0.0))
    return df.join(g, on).withColumn("d2", (F.col("_c") * u * u - 2 * F.col("_b") * u * v + F.col("_a") * v * v) / det).drop("_mx", "_my", "_a", "_b", "_c")


def chunk_means(vox: DataFrame, t: str, axes: list[str], v: str, size: int) -> DataFrame:
    """The mean of each voxel over chunks of ``size`` frames: a volume scanned in pieces."""
    return vox.groupBy(F.floor(F.col(t) / size).alias("chunk"), *axes).agg(F.avg(v).alias(v), F.count("*").alias("n"))


def drift(vox: DataFrame, t: str, axes: list[str], v: str) -> DataFrame:
    """The shift of the centre of positive mass since the frame before, by axis and in length."""
    w = F.greatest(F.col(v), F.lit(0.0))
    c = vox.groupBy(t).agg(*[(F.sum(w * F.col(a)) / F.nullif(F.sum(w), F.lit(0.0))).alias(f"c_{a}") for a in axes])
    pre = c.select((F.col(t) + 1).alias(t), *[F.col(f"c_{a}").alias(f"p_{a}") for a in axes])
    out = c.join(pre, t).select(t, *[(F.col(f"c_{a}") - F.col(f"p_{a}")).alias(f"d_{a}") for a in axes])
    return out.withColumn("length", F.sqrt(sum((F.col(f"d_{a}") ** 2 for a in axes), F.lit(0.0))))


def name_channels(df: DataFrame, file: str, table: str, i: str, own: str, size: str, lists: list[list[str]], carry: list[str] | None = None) -> DataFrame:
    """Names of a file's recorded columns: ``file, channel, size`` and what it is to ``carry``, the longest column of each name.

    A table with as many columns as one of ``lists`` has takes its names by place ``i`` from 0 (the first
    such list); others keep their ``own`` name, or else table_var<i>.  Columns of one value are left out.
    """
    width = F.count("*").over(Window.partitionBy(file, table))
    by_place = [F.when(F.col("_w") == len(names), F.get(F.array(*map(F.lit, names)), F.col(i).cast("int"))) for names in lists]
    label = F.coalesce(*by_place, F.nullif(F.col(own), F.lit("")), F.concat(F.col(table).cast("string"), F.lit("_var"), F.col(i).cast("string")))
    long = df.withColumn("_w", width).where(F.col(size) > 1).groupBy(file, label.alias("channel"))
    if not carry:
        return long.agg(F.max(size).alias(size))
    return long.agg(F.min_by(F.struct(size, *carry), F.struct(-F.col(size), table, i)).alias("_row")).select(file, "channel", "_row.*")
