"""Placement of regions against all windows one at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import placement

ZONES = [(1, "long", 0.0, 60.0), (1, "fits", 60.0, 82.0), (1, "short", 82.0, 85.0), (2, "long", 5.0, 44.0), (2, "empty", 200.0, 260.0)]


def test_windows_of_zones(spark):
    got = {}
    for r in placement.candidate_windows(spark.createDataFrame(ZONES, "cell int, zone string, lo double, hi double")).collect():
        got.setdefault((r["cell"], r["zone"]), set()).add((round(r["start"], 6), round(r["end"], 6)))
    assert got[1, "fits"] == {(60.0, 82.0)} and (1, "short") not in got
    want = set()
    for n in (20.0, 16.0, 24.0, 12.0, 30.0):
        want |= {(round(s, 6), round(min(s + n, 60.0), 6)) for s in np.arange(0, 60 - n + 0.01, 2.0)}
    assert got[1, "long"] == want


def test_best_windows(spark):
    rng = np.random.default_rng(4)
    t = 60
    signal = rng.normal(size=t)
    at = {1: rng.uniform(0, 90, 220), 2: rng.uniform(0, 60, 90)}
    v = {c: rng.normal(size=(len(x), t)) + np.where((x > 22) & (x < 38), 1.5, 0.1)[:, None] * signal for c, x in at.items()}
    rows = [(c, i, float(at[c][i]), k, float(v[c][i, k])) for c in at for i in range(len(at[c])) for k in range(t)]
    vox = spark.createDataFrame(rows, "cell int, voxel int, at double, t int, v double").repartition(3)
    zones = spark.createDataFrame(ZONES, "cell int, zone string, lo double, hi double")
    order = {}
    for r in vox.select("cell", "voxel").distinct().withColumn("h", F.xxhash64("voxel")).collect():
        order.setdefault(r["cell"], []).append(((at[r["cell"]][r["voxel"]], r["h"]), r["voxel"]))
    first = {c: np.isin(np.arange(len(at[c])), [i for n, (_, i) in enumerate(sorted(o)) if n % 2 == 0]) for c, o in order.items()}
    best = {}
    for w in placement.candidate_windows(zones).collect():
        c = w["cell"]
        own = (at[c] >= w["start"]) & (at[c] < w["end"])
        if own.sum() < 25 or not (own & first[c]).any() or not (own & ~first[c]).any():
            continue
        r = np.corrcoef(v[c][own & first[c]].mean(0), v[c][own & ~first[c]].mean(0))[0, 1]
        rel = 2 * r / (1 + r)
        key = (-round(rel, 9), round(w["end"] - w["start"], 9), w["start"], w["end"], int(own.sum()), rel)
        best[c, w["zone"]] = min(best.get((c, w["zone"]), key), key)
    got = {(r["cell"], r["zone"]): r for r in placement.place_regions(vox, zones).collect()}
    assert got.keys() == best.keys() and (2, "empty") not in got
    for k, (_, _, start, end, n, rel) in best.items():
        r = got[k]
        assert (r["start"], r["end"], r["n_voxels"], r["reliability"]) == (pytest.approx(start), pytest.approx(end), n, pytest.approx(rel))
    assert 18 <= got[1, "long"]["start"] <= 30
