"""Inference over hierarchical data: corrections, exact tests, resampling and robust fits."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.ranking import place
from lamina.operators.relational import band_join
from lamina.operators.series import add_group, average_rank
from lamina.operators.slopes import theil_sen as theil_sen


def benjamini_hochberg(df: DataFrame, p: str, family: list[str], key: str) -> DataFrame:
    """q-values of a family of tests; null p-values get null and don't count."""
    w = Window.partitionBy(*family)
    up = w.orderBy(F.col(p).asc_nulls_last(), key)
    down = w.orderBy(F.col(p).desc_nulls_first(), F.desc(key)).rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumn("_raw", F.col(p) * F.count(p).over(w) / F.row_number().over(up))
    return x.withColumn("q", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_raw").over(down)))).drop("_raw")


def signed_rank(df: DataFrame, on: list[str], d: str) -> DataFrame:
    """Exact Wilcoxon signed-rank test of differences, zeros left out, for groups of any size.

    ``n, w`` (sum of positive ranks), one-sided ``p_greater`` and two-sided ``p_two``.  The null chances
    of each sum of doubled ranks grow by one difference at a time, n**3 steps for a group.
    """
    x = df.where(F.col(d) != 0).withColumn("_a", F.abs(d))
    x = x.withColumn("_r", average_rank("_a", on))
    g = x.groupBy(*on).agg(F.count("*").alias("n"), F.sum(F.when(F.col(d) > 0, F.col("_r")).otherwise(0.0)).alias("w"), F.collect_list(F.round(2 * F.col("_r")).cast("int")).alias("_ranks"))
    start = F.transform(F.sequence(F.lit(0), (F.col("n") * (F.col("n") + 1)).cast("int")), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    grow = lambda s, r: F.transform(s, lambda c, i: (c + F.when(i >= r, F.get(s, i - r)).otherwise(0.0)) / 2)
    g = g.withColumn("_null", F.aggregate("_ranks", start, grow)).withColumn("_s", F.round(2 * F.col("w")).cast("int"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    ge = total(F.slice("_null", F.col("_s") + 1, F.size("_null"))).alias("p_greater")
    le = total(F.slice("_null", F.lit(1), F.col("_s") + 1)).alias("_le")
    return g.select(*on, "n", "w", ge, le).select(*on, "n", "w", "p_greater", F.least(F.lit(1.0), 2 * F.least("p_greater", "_le")).alias("p_two"))


def signed_rank_z(df: DataFrame, on: list[str], d: str) -> DataFrame:
    """``n, w, z`` and the one-sided normal ``p``: the signed-rank sum in standard units, ties counted;
    partial sums only, for large groups."""
    x = df.where(F.col(d) != 0).withColumn("_a", F.abs(d))
    x = x.withColumn("_r", average_rank("_a", on))
    g = x.groupBy(*on).agg(F.count("*").alias("n"), F.sum(F.when(F.col(d) > 0, F.col("_r")).otherwise(0.0)).alias("w"), F.sum("_r").alias("_all"), F.sum(F.col("_r") ** 2).alias("_sq"))
    return g.select(*on, "n", "w", ((F.col("w") - F.col("_all") / 2) / F.sqrt(F.col("_sq") / 4)).alias("z")).withColumn("p", normal_above(F.col("z")))


def normal_above(z: Column) -> Column:
    """P(Z > z) of a standard normal by its series, to about 1e-15 absolute; beyond 8.3 it is 0 or 1 to that."""
    z = F.greatest(F.lit(-8.3), F.least(F.lit(8.3), z))
    start = F.struct(z.alias("term"), z.alias("sum"))
    step = lambda a, k: F.struct((a["term"] * z * z / (2 * k + 1)).alias("term"), (a["sum"] + a["term"] * z * z / (2 * k + 1)).alias("sum"))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 - F.exp(-z * z / 2) / float(np.sqrt(2 * np.pi)) * F.aggregate(F.sequence(F.lit(1), F.lit(200)), start, step, lambda a: a["sum"])))


#: A rational start for the inverse normal: fixed coefficients of the published approximation by Acklam, centre and tails.
CENTRE = ((-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239), (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0))
TAIL = ((-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783), (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0))


def normal_quantile(p: Column) -> Column:
    """z with P(Z > z) = p of a standard normal, to about 1e-12; null for p outside (0, 1)."""
    def at(x: Column, c: tuple[float, ...]) -> Column:
        return reduce(lambda total, k: total * x + k, c[1:], F.lit(c[0]))

    # Each value is bound once, so that the expression stays small.
    bound = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))

    def start(below: Column) -> Column:
        tail = bound(F.sqrt(-2 * F.log(below)), lambda t: -at(t, TAIL[0]) / at(t, TAIL[1]))
        centre = bound(0.5 - below, lambda q: bound(q * q, lambda r: q * at(r, CENTRE[0]) / at(r, CENTRE[1])))
        return F.when(below < 0.02425, tail).otherwise(centre)

    def better(z: Column, below: Column) -> Column:
        # One step of Halley's method on the smaller tail.
        off = (normal_above(z) - below) * float(np.sqrt(2 * np.pi)) * F.exp(z * z / 2)
        return bound(off, lambda o: z + o / (1 - z * o / 2))

    z = bound(F.least(p, 1 - p), lambda below: bound(start(below), lambda z: better(z, below)))
    return F.when((p > 0) & (p < 1), z * F.when(p <= 0.5, 1.0).otherwise(-1.0))


def stouffer_combined(df: DataFrame, on: list[str], p: str, weight: str | None = None) -> DataFrame:
    """Stouffer's combination of one-sided p-values: ``k, z, p``, by ``weight`` if one is named; p-values outside (0, 1) are left out."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    x = df.withColumn("_z", normal_quantile(F.col(p).cast("double"))).where("_z is not null")
    g = x.groupBy(*on).agg(F.count("*").alias("k"), (F.sum(w * F.col("_z")) / F.sqrt(F.sum(w * w))).alias("z"))
    return g.withColumn("p", normal_above(F.col("z")))


def paired_signed_rank(df: DataFrame, on: list[str], d: str, most: int = 50) -> DataFrame:
    """The two-sided signed-rank test with its method chosen by group: ``n, w, p, method``.

    ``exact`` for at most ``most`` differences of different sizes, none of them 0, else ``normal`` with ties counted.  Groups of zeros only are left out.
    """
    x = df.where(F.col(d).isNotNull() & ~F.isnan(d))
    size = x.groupBy(*on).agg(F.count("*").alias("_n"), F.count_distinct(F.abs(d)).alias("_kinds"), F.min(F.abs(d)).alias("_least"))
    small = size.where((F.col("_n") <= most) & (F.col("_kinds") == F.col("_n")) & (F.col("_least") > 0)).select(*on)
    exact = signed_rank(x.join(small, on, "left_semi"), on, d).select(*on, "n", "w", F.col("p_two").alias("p"), F.lit("exact").alias("method"))
    z = signed_rank_z(x.join(small, on, "left_anti"), on, d)
    return exact.unionByName(z.select(*on, "n", "w", F.least(F.lit(1.0), 2 * normal_above(F.abs("z"))).alias("p"), F.lit("normal").alias("method")))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n rows by Student's t with n - 2 degrees of freedom; null for n < 3.

    With sin = |r| the chance within is a finite sum of n / 2 terms, in powers of cos.
    """
    s, c2, odd = F.abs(r), 1 - r * r, n % 2 == 1
    terms = F.floor(F.when(odd, (n - 3) / 2).otherwise((n - 2) / 2)).cast("int")
    more = F.when(terms >= 2, F.sequence(F.lit(1), terms - 1)).otherwise(F.array().cast("array<int>"))
    grow = lambda k: F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k)) * c2
    step = lambda a, k: F.struct((a["term"] * grow(k)).alias("term"), (a["sum"] + a["term"] * grow(k)).alias("sum"))
    total = F.when(terms >= 1, F.aggregate(more, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), step, lambda a: a["sum"])).otherwise(0.0)
    within = F.when(odd, (F.asin(s) + s * F.sqrt(c2) * total) * (2 / np.pi)).otherwise(s * total)
    return F.when(n >= 3, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - within)))


def spearman(df: DataFrame, on: list[str], x: str, y: str) -> DataFrame:
    """``n, rho`` and its two-sided ``p`` of the average ranks of rows that have both values."""
    r = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_x", average_rank(x, on)).withColumn("_y", average_rank(y, on))
    g = r.groupBy(*on).agg(F.count("*").alias("n"), F.corr("_x", "_y").alias("rho"))
    return g.withColumn("p", correlation_p(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "rho")), F.col("n")))


def partial_spearman(df: DataFrame, on: list[str], x: str, y: str, z: str) -> DataFrame:
    """``n, rho`` of x and y with z held fixed, from the three pairwise values, and its two-sided ``p`` with n - 3 degrees of freedom.

    Rows that lack any of the three are left out.
    """
    r = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull())
    for c in (x, y, z):
        r = r.withColumn(f"_{c}", average_rank(c, on))
    g = r.groupBy(*on).agg(F.count("*").alias("n"), F.corr(f"_{x}", f"_{y}").alias("a"), F.corr(f"_{x}", f"_{z}").alias("b"), F.corr(f"_{y}", f"_{z}").alias("c"))
    g = g.select(*on, "n", ((F.col("a") - F.col("b") * F.col("c")) / F.sqrt((1 - F.col("b") ** 2) * (1 - F.col("c") ** 2))).alias("rho"))
    return g.withColumn("p", correlation_p(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "rho")), F.col("n") - 1))


def within_group_spearman(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """``n, rho`` of ranks centred inside groups of two or more, over all rows, and its two-sided ``p`` with n - groups - 1 degrees of freedom."""
    n = F.count("*").over(Window.partitionBy(group))
    r = df.withColumn("_n", n).where("_n >= 2").withColumn("_x", average_rank(x, [group])).withColumn("_y", average_rank(y, [group]))
    r = add_group(r, [group], mx=F.avg("_x"), my=F.avg("_y"))
    g = r.agg(F.count("*").alias("n"), F.count_distinct(group).alias("_g"), F.corr(F.col("_x") - F.col("mx"), F.col("_y") - F.col("my")).alias("rho"))
    return g.select("n", "rho", correlation_p(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "rho")), F.col("n") - F.col("_g") + 1).alias("p"))


def log_choose(n: Column, k: Column) -> Column:
    """log C(n, k) as a sum of logs."""
    one = lambda m: F.aggregate(F.when(m >= 1, F.sequence(F.lit(1), m.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    return one(n) - one(k) - one(n - k)


def binomial_tail(k: Column, n: Column, p: float = 0.5) -> Column:
    """P(X >= k) of a binomial, summed exactly; each term's logarithm comes from the one before."""
    first = log_choose(n, k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    step = lambda a, i: F.struct((a["term"] + F.log((n - i) / (i + 1.0)) + F.log(F.lit(p / (1 - p)))).alias("term"), (a["sum"] + F.exp(a["term"])).alias("sum"))
    return F.least(F.lit(1.0), F.aggregate(F.sequence(k.cast("int"), n.cast("int")), F.struct(first.alias("term"), F.lit(0.0).alias("sum")), step, lambda a: a["sum"]))


def mean_of_means(df: DataFrame, outer: list[str], inner: list[str], value: str) -> DataFrame:
    return df.groupBy(*outer, *inner).agg(F.avg(value).alias("m")).groupBy(*outer).agg(F.avg("m").alias("mean_of_means"), F.count("*").alias("groups"))


def leave_one_out(df: DataFrame, group: str, value: str) -> DataFrame:
    """The mean of group means without each group, by total minus own."""
    g = df.groupBy(group).agg(F.avg(value).alias("m"))
    t = g.agg(F.sum("m").alias("_s"), F.count("*").alias("_n"))
    return g.join(F.broadcast(t)).select(group, ((F.col("_s") - F.col("m")) / F.nullif(F.col("_n") - 1, F.lit(0))).alias("without"))


def shift_null(src: DataFrame, ref: DataFrame, on: list[str], t: str, period: int, window: int, least: int) -> DataFrame:
    """Exhaustive circular-shift null of the independent fraction.

    All shifts of ``ref`` from ``least`` to period - least - 1 are taken.  The observed fraction
    uses linear distance, shifted ones circular distance: ``observed, null_mean, p`` with
    p = (1 + shifts at or below the observed) / (1 + shifts).  Each pair of events forbids a run of
    shifts; all pairs of a key's events are made, as every pair counts for some shifts.
    """
    s = src.select(*on, F.col(t).alias("a")).distinct()
    r = ref.select(*on, F.col(t).alias("b")).distinct()
    n = s.groupBy(*on).agg(F.count("*").alias("n"))
    near = band_join(s, r, on, "a", "b", -window, window).select(*on, "a").distinct().groupBy(*on).agg(F.count("*").alias("hit"))
    hit = s.join(r, on).select(*on, "a", F.explode(F.transform(F.sequence(F.lit(-window), F.lit(window)), lambda k: F.pmod(F.col("a") - F.col("b") + k, F.lit(period)))).alias("shift"))
    hit = hit.where(F.col("shift").between(least, period - least - 1)).distinct().groupBy(*on, "shift").agg(F.count("*").alias("c"))
    shifts = period - 2 * least
    obs = n.join(near, on, "left").select(*on, "n", (1 - F.coalesce("hit", F.lit(0)) / F.col("n")).alias("observed"))
    each = obs.join(hit, on, "left").withColumn("frac", 1 - F.coalesce("c", F.lit(0)) / F.col("n"))
    g = each.groupBy(*on, "n", "observed").agg(F.count("shift").alias("k"), F.sum(F.when(F.col("shift").isNotNull(), F.col("frac")).otherwise(0.0)).alias("f"), F.sum(((F.col("frac") <= F.col("observed") + 1e-12) & F.col("shift").isNotNull()).cast("int")).alias("le"))
    rest = shifts - F.col("k")
    le = F.col("le") + F.when(F.col("observed") >= 1 - 1e-12, rest).otherwise(0)
    return g.select(*on, "n", "observed", ((F.col("f") + rest) / shifts).alias("null_mean"), ((1 + le) / (1 + shifts)).alias("p"))


def cluster_bootstrap(df: DataFrame, group: str, value: str, draws: int, seed: int = 0) -> DataFrame:
    """Two-stage bootstrap of the mean of group means: groups, then rows in them, are drawn by
    hashes of (seed, draw, position), so any cluster gives the same draws: ``mean, lo, hi``.

    A group's rows meet the list of the draws that took it, about ``draws`` long, in one row."""
    members = place(df.groupBy(group).agg(F.array_sort(F.collect_list(value)).alias("v")), group, name="g").withColumn("g", (F.col("g") - 1).cast("int"))
    n = members.count()
    b = df.sparkSession.range(draws).withColumnRenamed("id", "draw").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0))))).withColumn("g", F.pmod(F.xxhash64(F.lit(seed), "draw", "slot"), F.lit(max(n, 1))).cast("int"))
    m = F.size("v")
    pick = lambda s: F.transform(F.sequence(F.lit(1), m), lambda i: F.get(F.col("v"), F.pmod(F.xxhash64(F.lit(seed + 1), s["draw"], s["slot"], i), m).cast("int")))
    took = b.groupBy("g").agg(F.collect_list(F.struct("draw", "slot")).alias("took"))
    mean = lambda s: F.struct(s["draw"].alias("draw"), (F.aggregate(pick(s), F.lit(0.0), lambda a, x: a + x) / m).alias("m"))
    one = members.join(took, "g").select(F.inline(F.transform("took", mean)))
    return one.groupBy("draw").agg(F.avg("m").alias("m")).agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))


def iid_bootstrap(df: DataFrame, on: list[str], value: str, draws: int, seed: int = 0) -> DataFrame:
    """Percentile interval of the mean of each group."""
    g = df.groupBy(*on).agg(F.array_sort(F.collect_list(value)).alias("v")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    m = F.size("v")
    pick = F.transform(F.sequence(F.lit(1), m), lambda i: F.get(F.col("v"), F.pmod(F.xxhash64(F.lit(seed), F.col("draw"), i), m).cast("int")))
    x = g.withColumn("m", F.aggregate(pick, F.lit(0.0), lambda a, b: a + b) / m)
    return x.groupBy(*on).agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))


def permutation_test(df: DataFrame, group: str, x: str, y: str, draws: int, seed: int = 0) -> DataFrame:
    """Correlation of y with x shuffled inside groups: ``observed, p`` (two-sided, (1 + #) / (1 + n)).

    A shuffle pairs the order of y's rows with the order of hashes of x's rows in each group.  Rows move once for 16
    draws, which are made where both orders are known: each row lends its x to the place of its hash and its y to its own.
    """
    base = df.where(F.col(group).isNotNull()).select(F.col(group).alias("_g"), F.col(x).alias("_x"), F.col(y).alias("_y")).withColumn("i", F.row_number().over(Window.partitionBy("_g").orderBy("_y", "_x")))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = base.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // 16)))).repartition(parts, "_b", "_g")
    many = many.withColumn("draw", F.explode(F.sequence(16 * F.col("_b") + 1, F.least(16 * F.col("_b") + 16, F.lit(draws)))))
    key = ["_b", "_g", "draw"]
    many = many.withColumn("j", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(F.lit(seed), "draw", "i"))))
    none = F.lit(None)
    lent = F.array(F.struct(F.col("j").alias("at"), F.col("_x").alias("x"), none.cast(df.schema[y].dataType).alias("y")), F.struct(F.col("i").alias("at"), none.cast(df.schema[x].dataType).alias("x"), F.col("_y").alias("y")))
    met = many.select(*key, F.inline(lent)).groupBy(*key, "at").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    null = met.groupBy("draw").agg(F.corr("x", "y").alias("r"))
    obs = df.agg(F.corr(x, y).alias("observed"))
    return null.join(F.broadcast(obs)).groupBy("observed").agg(((1 + F.sum((F.abs("r") >= F.abs("observed")).cast("int"))) / (1 + F.count("*"))).alias("p"))


def fisher_combined(df: DataFrame, on: list[str], p: str) -> DataFrame:
    """Fisher's combination of p-values; with 2k degrees of freedom its tail is a finite sum of k terms, each from the one before."""
    g = df.where(F.col(p) > 0).groupBy(*on).agg(F.count("*").cast("int").alias("k"), F.sum(-F.log(p)).alias("h"))
    step = lambda a, i: F.struct((a["term"] + F.log("h") - F.log(i.cast("double"))).alias("term"), (a["sum"] + F.exp(a["term"])).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(1), F.col("k")), F.struct((-F.col("h")).alias("term"), F.lit(0.0).alias("sum")), step, lambda a: a["sum"])
    return g.select(*on, "k", (2 * F.col("h")).alias("chi2"), F.when(F.col("h") > 0, F.least(F.lit(1.0), tail)).otherwise(1.0).alias("p"))


def mad_outliers(df: DataFrame, on: list[str], value: str, factor: float = 4.0) -> DataFrame:
    """Flags of values above median + factor * MAD of their group."""
    x = add_group(df, on, med=F.median(value)).withColumn("_d", F.abs(F.col(value) - F.col("med")))
    x = add_group(x, on, mad=F.median("_d"))
    return x.withColumn("outlier", F.col(value) > F.col("med") + factor * F.col("mad")).drop("_d")


def random_intercept(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """y ~ x + (1 | group) by profile likelihood over a grid of variance ratios.

    A group counts by its sums, and each ratio by sums over groups, so one row a ratio is left.
    Returns ``slope, intercept, ratio, loglik`` and the likelihood ratio to slope 0, ``lr``.
    """
    s = df.groupBy(group).agg(F.count("*").cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("xx"), F.sum(F.col(x) * F.col(y)).alias("xy"), F.sum(F.col(y) * F.col(y)).alias("yy"))
    # The inverse of I + ratio 11' is I - k 11'.
    s = s.withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in np.r_[0, np.logspace(-4, 3, 141)]]))).withColumn("k", F.col("ratio") / (1 + F.col("n") * F.col("ratio")))
    of = lambda full, a, b: F.sum(F.col(full) - F.col("k") * F.col(a) * F.col(b))
    g = s.groupBy("ratio").agg(
        of("n", "n", "n").alias("a"), of("sx", "n", "sx").alias("b"), of("xx", "sx", "sx").alias("c"), of("sy", "n", "sy").alias("u"), of("xy", "sx", "sy").alias("v"), of("yy", "sy", "sy").alias("q"),
        F.sum("n").alias("total"), F.sum(F.log1p(F.col("n") * F.col("ratio"))).alias("logdet"),
    )
    det = F.col("a") * F.col("c") - F.col("b") ** 2
    g = g.withColumn("slope", (F.col("a") * F.col("v") - F.col("b") * F.col("u")) / F.nullif(det, F.lit(0.0))).withColumn("intercept", (F.col("u") - F.col("b") * F.col("slope")) / F.col("a"))
    likely = lambda rss: -0.5 * (F.col("total") * F.log(2 * np.pi * rss / F.col("total")) + F.col("total") + F.col("logdet"))
    g = g.withColumn("full", likely(F.col("q") - F.col("intercept") * F.col("u") - F.col("slope") * F.col("v"))).withColumn("null", likely(F.col("q") - F.col("u") ** 2 / F.col("a")))
    best = F.max_by(F.struct("slope", "intercept", "ratio"), F.struct("full", -F.col("ratio"))).alias("best")
    return g.agg(best, F.max("full").alias("loglik"), F.max("null").alias("null")).select("best.*", "loglik", F.greatest(F.lit(0.0), 2 * (F.col("loglik") - F.col("null"))).alias("lr"))


def subsets(df: DataFrame, predicates: dict[str, Column], aggs: list[Column]) -> DataFrame:
    """The same aggregates over named subsets, in one pass: each row is spread over its subsets."""
    names = F.array_compact(F.array(*[F.when(p, F.lit(k)) for k, p in predicates.items()]))
    return df.withColumn("subset", F.explode(names)).groupBy("subset").agg(*aggs)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson score interval of a share k / n; null for n = 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return tuple((p + z * z / (2 * n) + side * half) / (1 + z * z / n) for side in (-1, 1))
