"""Smoothing, growth and redundancy against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import growth


def smooth(x, s, axis):
    reach, n = int(4 * s + 0.5), x.shape[axis]
    w = np.array([math.exp(-k * k / (2 * s * s)) for k in range(-reach, reach + 1)])
    w /= w.sum()
    at = np.arange(n)[:, None] + np.arange(-reach, reach + 1)
    at = np.mod(at, 2 * n)
    at = np.where(at >= n, 2 * n - 1 - at, at)
    return np.moveaxis((np.moveaxis(x, axis, -1)[..., at] * w).sum(-1), -1, axis)


def table(spark, name, x, axes, first=0):
    rows = [(name, *(int(i) + first for i in p), float(v)) for p, v in np.ndenumerate(x)]
    return spark.createDataFrame(rows, f"s string, {', '.join(f'{a} int' for a in axes)}, v double").repartition(3)


def test_smoothing_mirrors_at_edges(spark):
    x = np.random.default_rng(1).normal(size=(4, 9))
    df = table(spark, "a", x, "yx", 5)
    got = {(r["y"] - 5, r["x"] - 5): r["v"] for r in growth.gaussian(df, ["s"], {"y": (5, 8), "x": (5, 13)}, {"y": 2.0, "x": 0.8}, "v").collect()}
    want = smooth(smooth(x, 2.0, 0), 0.8, 1)
    assert len(got) == 36 and all(abs(got[p] - w) < 1e-12 for p, w in np.ndenumerate(want))
    high = {(r["y"] - 5, r["x"] - 5): r["v"] for r in growth.high_pass(df, ["s"], {"y": (5, 8), "x": (5, 13)}, {"x": 0.5}, {"y": 2.0, "x": 3.0}, "v").collect()}
    want = np.maximum(0, smooth(x, 0.5, 1) - smooth(smooth(x, 2.0, 0), 3.0, 1))
    assert all(abs(high[p] - w) < 1e-12 for p, w in np.ndenumerate(want))
    top = growth.normalised(df, ["s"], "v").agg(F.max("v")).first()[0]
    assert top == pytest.approx(x.max() / np.percentile(x, 99.9))


def test_pieces_that_touch_a_seed(spark):
    cells = [("a", 0, 0), ("a", 1, 1), ("a", 5, 5), ("b", 0, 0), ("b", 0, 1)]
    df = spark.createDataFrame(cells, "s string, y int, x int")
    got = growth.keep_touching(df, spark.createDataFrame([("a", 1, 1), ("b", 3, 3)], "s string, y int, x int"), ["s"], ["y", "x"])
    assert sorted(map(tuple, got.collect())) == [("a", 0, 0), ("a", 1, 1)]


def test_growth_follows_the_seed(spark):
    rng = np.random.default_rng(2)
    t, shape = 80, (7, 20)
    signal = rng.normal(size=t)
    mix = np.zeros(shape)
    mix[3, :9], mix[3, 10:14], mix[0, 16:19], mix[6, 18] = 1.0, 0.9, 1.2, 1.0
    v = mix[..., None] * signal + 0.25 * rng.normal(size=(*shape, t)) + 10 + 0.05 * np.arange(t)
    v[6, 18] -= 5
    rows = [("a", int(y), int(x), k, float(v[y, x, k])) for y in range(7) for x in range(20) for k in range(t)]
    vox = spark.createDataFrame(rows, "s string, y int, x int, t int, v double")
    seeds = spark.createDataFrame([("a", 3, 2), ("a", 3, 3)], "s string, y int, x int")
    scored = growth.seed_correlation(vox, seeds, ["s"], "t", ["y", "x"], "v", 11).cache()
    half = 5
    wide = np.concatenate([np.repeat(v[..., :1], half, 2), v, np.repeat(v[..., -1:], half, 2)], 2)
    flat = v - np.stack([wide[..., k : k + 11].mean(2) for k in range(t)], 2)
    trace = flat[3, 2:4].mean(0)
    r = {(a["y"], a["x"]): (a["r"], a["mean"]) for a in scored.collect()}
    for p in np.ndindex(shape):
        assert r[p][0] == pytest.approx(np.corrcoef(flat[p], trace)[0, 1]) and r[p][1] == pytest.approx(v[p].mean())
    grown = lambda **how: {(a["y"], a["x"]) for a in growth.grow_by_seed(scored, seeds, ["s"], ["y", "x"], 0.6, 0.97, **how).collect()}
    line, gap, more = {(3, x) for x in range(9)}, {(3, 9)}, {(3, x) for x in range(10, 14)}
    assert grown() == line
    assert grown(close="x", width=3) == line | gap | more
    assert grown(apart=0.6, cells=3) == line | more | {(0, 16), (0, 17), (0, 18)}
    # The dim cell passes only for its correlation.
    assert (6, 18) in grown(apart=0.6) and ((6, 18) in grown(apart=0.6, share=0.05)) == (r[6, 18][0] >= 0.97)


def test_redundancy_of_planes(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 7))
    vol = np.stack([[base + 0.1 * rng.normal(size=(6, 7)) + z for z in range(4)] for _ in range(5)])
    vol[0, 1] = vol[0, 0]
    rows = [("a", int(t), int(z), int(y), int(x), float(v)) for (t, z, y, x), v in np.ndenumerate(vol)]
    df = spark.createDataFrame(rows, "s string, t int, z int, y int, x int, v double").repartition(4)
    r = growth.plane_redundancy(df, ["s"], "t", "z", ["y", "x"], "v").first()
    m = vol.mean(0).reshape(4, -1)
    s = np.linalg.svd(m - m.mean(), compute_uv=False) ** 2
    c = np.corrcoef(m)
    assert (r["n_frames"], r["n_planes"], r["equal_planes"], r["n_comp_95"]) == (5, 4, 1, int(np.searchsorted(np.cumsum(s / s.sum()), 0.95) + 1))
    assert (r["pc1_share"], r["neighbour_r"], r["first_last_r"], r["mean_range"]) == tuple(map(pytest.approx, (s[0] / s.sum(), np.mean([c[i, i + 1] for i in range(3)]), c[0, 3], np.ptp(m.mean(1)))))
