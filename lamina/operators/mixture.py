"""One or two normal modes: mixtures by EM over partial sums, and a bootstrap of their likelihood ratio.

An EM step is one aggregate: each row weighs itself by its key's parameters, and only sums by key come back.
All keys, and all draws of the bootstrap, are keys of the same steps, so nothing is fitted in a loop over them.
"""

from __future__ import annotations

from functools import reduce
from math import log, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.sources.readers import staged

#: Added to variances, in units of the key's variance.
RIDGE = 1e-6
#: Steps between two tables.
CHAIN = 4
#: Numbers that one row is spread into at a time.
BLOCK = 1024


def _density(z: Column, w: Column, m: Column, v: Column) -> Column:
    return F.log(w) - F.log(v) / 2 - (z - m) * (z - m) / (2 * v)


def _step(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The next parameters of each key and the mean log likelihood of those before.

    Keys go by ``_k``, a struct, so that null keys are keys.
    """
    x = rows.join(state, "_k")
    a, b = _density(F.col("_z"), F.col("w"), F.col("m1"), F.col("v1")), _density(F.col("_z"), 1 - F.col("w"), F.col("m2"), F.col("v2"))
    x = x.withColumn("_a", a).withColumn("_b", b).withColumn("_top", F.greatest("_a", "_b"))
    x = x.withColumn("_l", F.col("_top") + F.log(F.exp(F.col("_a") - F.col("_top")) + F.exp(F.col("_b") - F.col("_top")))).withColumn("_r", F.exp(F.col("_a") - F.col("_l")))
    r, s, z = F.col("_r"), 1 - F.col("_r"), F.col("_z")
    sums = x.groupBy("_k").agg(
        F.count("*").alias("n"), F.sum("_l").alias("_l"), F.sum(r).alias("_r"), F.sum(s).alias("_s"), F.sum(r * z).alias("_rz"), F.sum(s * z).alias("_sz"), F.sum(r * z * z).alias("_rzz"), F.sum(s * z * z).alias("_szz"), F.first("ll").alias("before"))
    least = F.lit(1e-12)
    r, s = F.greatest("_r", least), F.greatest("_s", least)
    m1, m2 = F.col("_rz") / r, F.col("_sz") / s
    return sums.select(
        "_k", (r / (r + s)).alias("w"), m1.alias("m1"), (F.greatest(F.col("_rzz") / r - m1 * m1, F.lit(0.0)) + RIDGE).alias("v1"), m2.alias("m2"), (F.greatest(F.col("_szz") / s - m2 * m2, F.lit(0.0)) + RIDGE).alias("v2"),
        (F.col("_l") / F.col("n") - log(2 * pi) / 2).alias("ll"), "before")


def fit_two_modes(df: DataFrame, on: list[str], x: str, steps: int = 100, tol: float = 1e-3) -> DataFrame:
    """Mixtures of two normals by key ``on``, and how much better they fit than one.

    Args: null and not finite ``x`` are left out.  The modes start one standard deviation to both sides of the mean with the
    variance of all, and steps go on until the mean log likelihood rises by less than ``tol``, looked at every 4 steps, or
    ``steps`` are made.
    Returns ``on, n, weight_1, mean_1, sd_1, weight_2, mean_2, sd_2, lr`` (twice the log likelihood ratio), ``d_bic`` (of one mode less two),
    ``ashman_d`` and ``min_weight``; mode 1 started below.

    Keys of fewer than two values, or of equal ones, come out with nulls.
    """
    held = df.where(F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(F.col(x)) < float("inf"))).select(F.struct(*on).alias("_k") if on else F.struct(F.lit(0)).alias("_k"), F.col(x).cast("double").alias("_x"))
    scale = staged(held.groupBy("_k").agg(F.count("*").alias("n"), F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_sd")), "scales")
    rows = staged(held.join(scale.where("_sd > 0"), "_k").select("_k", ((F.col("_x") - F.col("_m")) / F.col("_sd")).alias("_z")), "values")
    state = scale.where("_sd > 0").select("_k", *[F.lit(v).alias(k) for k, v in {"w": 0.5, "m1": -1.0, "v1": 1.0, "m2": 1.0, "v2": 1.0, "ll": float("-inf"), "before": float("-inf")}.items()])
    ended = None
    done = 0
    while done < steps:
        many = min(CHAIN, steps - done)
        done += many
        state = staged(reduce(lambda s, _: _step(rows, s), range(many), state), "modes")
        settled = F.col("ll") - F.col("before") < tol
        part = state.where(settled) if done < steps else state
        ended = part if ended is None else ended.unionByName(part)
        state = state.where(~settled)
        if done >= steps or state.isEmpty():
            break
    # The likelihood of the last parameters.
    last = ended.select("_k", "w", "m1", "v1", "m2", "v2", "ll", "before")
    final = _step(rows, last).select("_k", F.col("ll").alias("_ll"))
    fits = scale.join(last.drop("ll", "before").join(final, "_k"), "_k", "left")
    n, sd = F.col("n"), F.col("_sd")
    # In units of the standard deviation one mode has variance 1.
    one = -n / 2 * (log(2 * pi) + 1 + F.lit(RIDGE))
    lr = 2 * (n * F.col("_ll") - one)
    keys = [F.col(f"_k.{k}").alias(k) for k in on]
    return fits.select(
        *keys, "n", F.col("w").alias("weight_1"), (F.col("_m") + sd * F.col("m1")).alias("mean_1"), (sd * F.sqrt("v1")).alias("sd_1"),
        (1 - F.col("w")).alias("weight_2"), (F.col("_m") + sd * F.col("m2")).alias("mean_2"), (sd * F.sqrt("v2")).alias("sd_2"),
        lr.alias("lr"), (lr - 3 * F.log(n.cast("double"))).alias("d_bic"),
        (F.abs(F.col("m1") - F.col("m2")) / F.sqrt((F.col("v1") + F.col("v2")) / 2)).alias("ashman_d"), F.least("w", 1 - F.col("w")).alias("min_weight"))


def _uniform(*seed: Column) -> Column:
    """A number inside (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*seed), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal_draws(counts: DataFrame, on: list[str], draws: int, seed: int = 0) -> DataFrame:
    """For each key ``draws`` samples of ``n`` standard normals: ``on, draw, z``, the same on every run."""
    many = counts.select(*on, "n", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).repartition(*on, "draw")
    blocks = many.where("n > 0").select(*on, "n", "draw", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {BLOCK}"))).alias("_b"))
    size = F.least(F.lit(BLOCK), F.col("n") - F.col("_b") * BLOCK)
    rows = blocks.select(*on, "draw", "_b", F.explode(F.sequence(F.lit(1).cast("long"), size)).alias("_i"))
    at = [F.lit(seed), *[F.col(k) for k in on], "draw", "_b", "_i"]
    return rows.select(*on, "draw", (F.sqrt(-2 * F.log(_uniform(F.lit(1), *at))) * F.cos(2 * pi * _uniform(F.lit(2), *at))).alias("z"))


def bimodality(df: DataFrame, on: list[str], x: str, draws: int = 200, seed: int = 0, steps: int = 100, tol: float = 1e-3) -> DataFrame:
    """``fit_two_modes`` with ``p``: the share of samples of one normal, as large as the key, that two modes fit better by as much.

    p = (1 + samples with as large a ratio) / (1 + draws); null where the fit is.
    """
    fits = staged(fit_two_modes(df, on, x, steps, tol), "fits")
    usable = fits.where("lr is not null").select(*on, "n")
    # The ratio does not depend on mean and scale, so samples are of the standard normal.
    null = fit_two_modes(normal_draws(usable, on, draws, seed), [*on, "draw"], "z", steps, tol).select(*[F.col(k).alias(f"_{k}") for k in on], F.col("lr").alias("_lr"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in on], F.lit(True))
    counted = fits.select(*on, "lr").join(null, same).groupBy(*on).agg((F.sum((F.col("_lr") >= F.col("lr")).cast("int")) + 1).alias("_as")).withColumnsRenamed({k: f"_{k}" for k in on})
    return fits.join(counted, same, "left").select(*fits.columns, (F.col("_as") / (1 + draws)).alias("p"))
