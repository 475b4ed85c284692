"""Distances from a reference set by covariances of many columns, shrunk and without the row's own group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Powers of two columns whose sums, over rows that have both, give the fourth moments.
POWERS = [(p, q) for p in range(3) for q in range(3)]


def without_own_group(ref: DataFrame, group: str, features: list[str], groups: DataFrame) -> DataFrame:
    """Exact ``centre`` (median) and ``scale`` of each feature over ``ref`` without a group's rows, by ``groups``.

    Scale is 1.4826 times the median absolute deviation, at least half a standard deviation, plus 1e-9.  Each
    group sees all others' rows, so this part costs rows times groups.
    """
    long = ref.select(F.col(group).alias("_of"), F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f).cast("double").alias("v")) for i, f in enumerate(features)]))).where("v is not null")
    rest = long.join(groups.select(group), ~F.col("_of").eqNullSafe(F.col(group)))
    mid = rest.groupBy(group, "i").agg(F.median("v").alias("centre"), F.stddev_samp("v").alias("_sd"))
    off = rest.join(mid.withColumnsRenamed({group: "_g", "i": "_i"}), F.col(group).eqNullSafe(F.col("_g")) & (F.col("i") == F.col("_i")))
    mad = off.groupBy(group, "i", "centre", "_sd").agg((1.4826 * F.median(F.abs(F.col("v") - F.col("centre")))).alias("_mad"))
    return mad.select(group, "i", "centre", (F.greatest("_mad", F.coalesce(0.5 * F.col("_sd"), F.lit(0.0))) + 1e-9).alias("scale"))


def pair_sums(ref: DataFrame, group: str, features: list[str], about: list[float]) -> DataFrame:
    """Sums by group and pair of columns that add up over any rows: ``group, i, j``, ``n`` and a sum each.

    ``s<p><q>``: of u_i**p u_j**q over rows with both; ``l<p>`` (``r<p>``): of u_i**p (u_j**p) where only it is
    there; ``none``: rows with neither.  u are values less ``about``, which keeps high powers small.
    """
    u = F.array(*[F.col(f).cast("double") - F.lit(a) for f, a in zip(features, about, strict=True)])
    k = len(features)
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.get(u, F.lit(i)).alias("a"), F.get(u, F.lit(j)).alias("b")) for i in range(k) for j in range(i, k)])
    x = ref.select(group, F.inline(pairs))
    a, b, zero = F.col("a"), F.col("b"), F.lit(0.0)
    some = lambda c: F.coalesce(F.sum(c), zero)
    power = lambda c, p: F.lit(1.0) if p == 0 else c if p == 1 else c * c
    both = [some(F.when(a.isNotNull() & b.isNotNull(), power(a, p) * power(b, q))).alias(f"s{p}{q}") for p, q in POWERS]
    left = [some(F.when(a.isNotNull() & b.isNull(), power(a, p))).alias(f"l{p}") for p in range(3)]
    right = [some(F.when(a.isNull() & b.isNotNull(), power(b, p))).alias(f"r{p}") for p in range(3)]
    return x.groupBy(group, "i", "j").agg(*both, *left, *right, some(F.when(a.isNull() & b.isNull(), 1.0)).alias("none"))


def _moments(row: dict, fill_a: float, fill_b: float) -> dict[tuple[int, int], float]:
    """Sums of a**p b**q over all rows, missing values standing at their fills."""
    return {(p, q): row[f"s{p}{q}"] + fill_b**q * row[f"l{p}"] + fill_a**p * row[f"r{q}"] + fill_a**p * fill_b**q * row["none"] for p, q in POWERS}


def shrunk_precision(pairs: pd.DataFrame, centre: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """The inverse of the Ledoit-Wolf covariance of standardised columns, and its weight on the identity.

    ``pairs`` holds the summed rows of ``pair_sums``; ``centre`` and ``scale`` are in the same units.
    """
    k = len(centre)
    n = float(pairs[["s00", "l0", "r0", "none"]].iloc[0].sum())
    m = {(int(r["i"]), int(r["j"])): _moments(r, centre[int(r["i"])], centre[int(r["j"])]) for r in pairs.to_dict("records")}
    mean = np.array([m[i, i][1, 0] / n for i in range(k)])
    cov, fourth = np.zeros((k, k)), 0.0
    for (i, j), s in m.items():
        c, d = mean[i], mean[j]
        cov[i, j] = cov[j, i] = (s[1, 1] / n - c * d) / (scale[i] * scale[j])
        # The sum of (u - c)**2 (w - d)**2, written out.
        square = lambda q: (d * d * s[q, 0] - 2 * d * s[q, 1] + s[q, 2])  # noqa: B023, E731
        term = (square(2) - 2 * c * square(1) + c * c * square(0)) / (scale[i] * scale[j]) ** 2
        fourth += term if i == j else 2 * term
    mu, size = np.trace(cov) / k, float((cov**2).sum())
    spread = (size - 2 * mu * np.trace(cov) + k * mu * mu) / k
    noise = min((fourth / n - size) / (k * n), spread)
    weight = 0.0 if noise <= 0 or spread <= 0 else noise / spread
    return np.linalg.pinv((1 - weight) * cov + weight * mu * np.eye(k), hermitian=True), weight


def mahalanobis_without_group(df: DataFrame, key: str, group: str, features: list[str], reference: Column | None = None) -> DataFrame:
    """``key, group, distance, weight``: how far rows lie from the reference rows of all other groups.

    Columns are centred and scaled as in ``without_own_group``, missing values at the centre; the distance is
    sqrt(z' P z / columns) with P the inverse of the Ledoit-Wolf covariance.  Rows whose complement has no
    values in some column get null.  Covariances need one pass: sums by pair of columns for all rows, less
    those of the group; only matrices of columns by columns come together.
    """
    k = len(features)
    ref = df if reference is None else df.where(reference)
    groups = df.select(group).distinct()
    start = ref.agg(*[F.coalesce(F.avg(F.col(f).cast("double")), F.lit(0.0)).alias(f"_{i}") for i, f in enumerate(features)]).first()
    sums = pair_sums(ref, group, features, list(start))
    names = [c for c in sums.columns if c not in (group, "i", "j")]
    whole = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names])
    own = sums.withColumnsRenamed({c: f"_{c}" for c in (group, "i", "j", *names)})
    match = F.col(group).eqNullSafe(F.col(f"_{group}")) & (F.col("i") == F.col("_i")) & (F.col("j") == F.col("_j"))
    left = groups.crossJoin(F.broadcast(whole)).join(own, match, "left").select(group, "i", "j", *[(F.col(c) - F.coalesce(f"_{c}", F.lit(0.0))).alias(c) for c in names])
    scales = without_own_group(ref, group, features, groups).groupBy(group).agg(F.sort_array(F.collect_list(F.struct("i", "centre", "scale"))).alias("_s")).where(F.size("_s") == k)
    table = left.join(scales.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    kind = dict(df.dtypes)[group]

    def invert(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf["_s"].iloc[0]
        centre, scale = (np.array([r[c] for r in s]) for c in ("centre", "scale"))
        p, weight = shrunk_precision(pdf, centre - np.array(list(start)), scale)
        return pd.DataFrame({group: pdf[group].iloc[:1], "_centre": [centre], "_scale": [scale], "_p": [p.ravel()], "weight": [weight]})

    found = table.groupBy(group).applyInPandas(invert, f"`{group}` {kind}, _centre array<double>, _scale array<double>, _p array<double>, weight double").withColumnRenamed(group, "_g")
    z = F.array(*[F.coalesce((F.col(f).cast("double") - F.get("_centre", F.lit(i))) / F.get("_scale", F.lit(i)), F.lit(0.0)) for i, f in enumerate(features)])
    x = df.join(found, F.col(group).eqNullSafe(F.col("_g")), "left").withColumn("_z", F.when(F.col("_p").isNotNull(), z))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    form = add(F.transform(F.col("_z"), lambda v, i: v * add(F.zip_with(F.slice("_p", i * k + 1, F.lit(k)), "_z", lambda a, b: a * b))))
    return x.select(key, group, F.sqrt(F.when(form < 0, 0.0).otherwise(form) / k).alias("distance"), "weight")
