"""Normal quantiles, combinations and rank tests against plain forms."""

import itertools
import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from lamina.operators import stats

N = NormalDist()


def test_normal_quantiles(spark):
    ps = [1e-12, 1e-6, 0.01, 0.02425, 0.1, 0.3, 0.5, 0.7, 0.975, 1 - 1e-6, 0.0, 1.0, None]
    got = [r["z"] for r in spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double").coalesce(1).select("i", stats.normal_quantile(F.col("p")).alias("z")).orderBy("i").collect()]
    assert got[-3:] == [None] * 3
    assert all(abs(z - N.inv_cdf(1 - p)) < 1e-9 if p > 1e-7 else abs(z + N.inv_cdf(p)) < 1e-3 for z, p in zip(got[:-3], ps[:-3], strict=True))


def test_stouffer(spark):
    rows = [("a", 0.01, 1), ("a", 0.2, 4), ("a", 0.7, 9), ("b", 0.5, 1), ("b", None, 1), ("b", 1.0, 1)]
    got = {r["k0"]: r for r in stats.stouffer_combined(spark.createDataFrame(rows, "k0 string, p double, w int"), ["k0"], "p", "w").collect()}
    z = sum(w * N.inv_cdf(1 - p) for k, p, w in rows if k == "a") / math.sqrt(1 + 16 + 81)
    assert got["a"]["z"] == pytest.approx(z) and got["a"]["p"] == pytest.approx(1 - N.cdf(z)) and got["a"]["k"] == 3
    assert got["b"]["k"] == 1 and abs(got["b"]["z"]) < 1e-12


def ranks(v):
    return [sum(abs(b) < abs(a) for b in v) + (sum(abs(b) == abs(a) for b in v) + 1) / 2 for a in v]


def test_signed_rank_by_size(spark):
    data = {"small": [1.5, -0.5, 2.5, 3.0, -4.5, 6.0, 7.25], "tied": [1.0, -1.0, 2.0, 3.0, 3.0], "zero": [0.0, 1.0, 2.0, -4.0], "large": [(-1) ** (i % 3) * (i + 0.5) for i in range(60)], "none": [0.0, 0.0]}
    df = spark.createDataFrame([(k, v) for k, x in data.items() for v in x] + [("small", None), ("small", float("nan"))], "k string, d double")
    got = {r["k"]: r for r in stats.paired_signed_rank(df, ["k"], "d").collect()}
    assert {k: r["method"] for k, r in got.items()} == {"small": "exact", "tied": "normal", "zero": "normal", "large": "normal"}
    for k, r in got.items():
        v = [x for x in data[k] if x]
        rank = ranks(v)
        w = sum(a for a, x in zip(rank, v, strict=True) if x > 0)
        if r["method"] == "exact":
            sums = [sum(a for a, s in zip(rank, signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=len(v))]
            p = min(1.0, 2 * min(sum(s >= w for s in sums), sum(s <= w for s in sums)) / len(sums))
        else:
            z = (w - sum(rank) / 2) / math.sqrt(sum(a * a for a in rank) / 4)
            p = 2 * (1 - N.cdf(abs(z)))
        assert (r["n"], r["w"]) == (len(v), w) and r["p"] == pytest.approx(p, abs=1e-9)
