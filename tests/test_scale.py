"""Forms that hold on large groups, against plain numeric ones."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import catalog, stats


@pytest.mark.parametrize(("direct", "block"), [(1 << 18, 65_536), (1_600, 128), (320, 500)])
def test_median_slope_by_counts(spark, direct, block):
    rng, rows, want = np.random.default_rng(1), [], {}
    for g, n in enumerate([300, 301, 40, 900, 600]):
        x = rng.normal(size=n) if g % 2 == 0 else rng.integers(0, 20, n).astype(float)
        y = 2 * x + rng.normal(size=n) * (0.1 if g != 4 else 0)  # the last group has one slope only
        rows += [(g, float(a), float(b)) for a, b in zip(x, y, strict=True)]
        i, j = np.nonzero(x[None] > x[:, None])
        want[g] = float(np.median((y[j] - y[i]) / (x[j] - x[i]))), len(i)
    rows += [(0, None, 1.0), (None, 1.0, 2.0), (7, 1.0, 2.0), (7, 1.0, 3.0), (8, 1.0, None), (8, 2.0, 1.0)]
    got = {r["g"]: r for r in stats.theil_sen(spark.createDataFrame(rows, "g int, x double, y double"), ["g"], "x", "y", direct, block).collect()}
    assert set(got) == {*want, 8} and got[8]["slope"] is None and got[8]["pairs"] == 1
    for g, (slope, pairs) in want.items():
        assert got[g]["pairs"] == pairs and abs(got[g]["slope"] - slope) < 1e-12


def test_tails_of_many_terms(spark):
    """Sums of 20,000 terms; with each term's logarithm summed anew these took 10^8 steps a row."""
    n, k = 20_000, 10_100
    lg = math.lgamma
    want = sum(math.exp(lg(n + 1) - lg(i + 1) - lg(n - i + 1) + n * math.log(0.5)) for i in range(k, n + 1))
    x = spark.range(8).select(F.lit(k).alias("k"), F.lit(n).alias("n"))
    assert all(abs(r[0] - want) < 1e-9 for r in x.select(stats.binomial_tail(F.col("k"), F.col("n"))).collect())
    p = spark.range(n).select(F.lit(1).alias("g"), ((F.col("id") % 97 + 1) / 98).alias("p"))
    h = -sum(math.log((i % 97 + 1) / 98) for i in range(n))
    got = stats.fisher_combined(p, ["g"], "p").first()
    assert abs(got["p"] - min(1.0, sum(math.exp(i * math.log(h) - h - lg(i + 1)) for i in range(n)))) < 1e-8
    assert stats.fisher_combined(spark.sql("SELECT 1 AS g, 1.0D AS p"), ["g"], "p").first()["p"] == 1.0


def test_permutations_are_not_broadcast(spark):
    rows = [(i % 3, float(i * 7 % 101), float(i * 13 % 89)) for i in range(300)] + [(None, 1.0, 2.0)]
    out = stats.permutation_test(spark.createDataFrame(rows, "g int, x double, y double"), "g", "x", "y", 40)
    assert 0 < out.first()["p"] <= 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "HashJoin" in line and "draw" in line]


def test_catalog_settles_ties(spark):
    """Rows that the order holds equal give the same unit however they are dealt."""
    rows = [(1, 2, 5, "R"), (1, 2, 5, "A"), (2, 1, 1, "N")]
    for turned in (rows, rows[::-1]):
        df = spark.createDataFrame(turned, "k long, n int, part long, flag string").coalesce(1)
        got = catalog.load_catalog(df, F.lit(True), ["k"], ["n", "part"], ["flag", "part"]).orderBy("k").collect()
        assert [r["fingerprint"] for r in got] == ["A|5", "N|1"]
