"""Shrunk distances against a plain computation on rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import shrinkage


def plain(x, group, good):
    out, weights = np.full(len(x), np.nan), {}
    for g in set(group):
        ref = x[good & (group != g)]
        if np.isnan(ref).all(0).any():
            continue
        mid = np.nanmedian(ref, 0)
        scale = np.maximum(1.4826 * np.nanmedian(np.abs(ref - mid), 0), 0.5 * np.nanstd(ref, 0, ddof=1)) + 1e-9
        z = np.where(np.isnan(x), 0, (x - mid) / scale)
        r = z[good & (group != g)]
        c = r - r.mean(0)
        n, k = c.shape
        s = c.T @ c / n
        mu = np.trace(s) / k
        d2 = ((s - mu * np.eye(k)) ** 2).sum() / k
        b2 = min(sum(((np.outer(v, v) - s) ** 2).sum() for v in c) / (k * n * n), d2)
        weights[g] = b2 / d2 if k > 1 else 0.0
        p = np.linalg.inv((1 - weights[g]) * s + weights[g] * mu * np.eye(k))
        for i in np.flatnonzero(group == g):
            out[i] = np.sqrt(z[i] @ p @ z[i] / k)
    return out, weights


@pytest.mark.parametrize("k", [1, 4])
def test_distances_without_own_group(spark, k):
    rng = np.random.default_rng(k)
    x = rng.normal(size=(60, k)) @ rng.normal(size=(k, k)) * 50 + 1e4
    x[rng.random(x.shape) < 0.1] = np.nan
    group, good = rng.integers(0, 5, 60), rng.random(60) < 0.7
    rows = [(i, int(group[i]), bool(good[i]), *(None if np.isnan(v) else float(v) for v in x[i])) for i in range(60)]
    names = [f"c{i}" for i in range(k)]
    df = spark.createDataFrame(rows, f"i int, g int, good boolean, {', '.join(f'{c} double' for c in names)}").repartition(3)
    got = {r["i"]: (r["distance"], r["weight"]) for r in shrinkage.mahalanobis_without_group(df, "i", "g", names, F.col("good")).collect()}
    want, weights = plain(x, group, good)
    assert len(got) == 60
    for i in range(60):
        assert got[i][0] == pytest.approx(want[i], rel=1e-6)
        assert k == 1 or got[i][1] == pytest.approx(weights[group[i]], rel=1e-5)


def test_no_complement_and_null_groups(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 2.0), (2, "a", 2.0, None), (3, None, 5.0, None)], "i int, g string, c double, d double")
    got = {r["i"]: r["distance"] for r in shrinkage.mahalanobis_without_group(df, "i", "g", ["c", "d"]).collect()}
    # Without a's rows no value of d is left; without the null group's row two of c are.
    assert got[1] is None and got[2] is None and got[3] is not None
    assert shrinkage.mahalanobis_without_group(df.where("false"), "i", "g", ["c", "d"]).count() == 0
