"""Session sources against plain loops and small cases."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import relational as rel
from lamina.sources import sessions


def smooth(x, s):
    reach, n = int(4 * s + 0.5), len(x)
    w = np.array([math.exp(-k * k / (2 * s * s)) for k in range(-reach, reach + 1)])
    at = np.mod(np.arange(n)[:, None] + np.arange(-reach, reach + 1), 2 * n)
    return (x[np.where(at >= n, 2 * n - 1 - at, at)] * (w / w.sum())).sum(1)


@pytest.fixture
def short_chunks(monkeypatch):
    monkeypatch.setattr(sessions, "CHUNK", 16)


@pytest.mark.parametrize("n", [1, 3, 15, 16, 17, 70])
def test_smoothing_over_chunks_and_ends(spark, short_chunks, n):
    x = np.random.default_rng(n).normal(size=(2, n))
    rows = [(r, i, float(x[r, i]), float(-x[r, i])) for r in range(2) for i in range(n)]
    df = spark.createDataFrame(rows, "r int, i int, a double, b double").repartition(3)
    got = {(g["r"], g["i"]): (g["a"], g["b"]) for g in sessions.mirrored_gaussian(df, ["r"], "i", {"a": 1.0, "b": 3.0}).collect()}
    assert len(got) == 2 * n
    for r in range(2):
        a, b = smooth(x[r], 1.0), smooth(-x[r], 3.0)
        assert all(got[r, i] == pytest.approx((a[i], b[i])) for i in range(n))


def test_behaviour_starts_on_the_imaging_clock(spark):
    rng = np.random.default_rng(4)
    x = {"early": rng.normal(5, 1, 200), "plain": rng.normal(5, 1, 90)}
    rows = [(k, i, float(v), float(v - 5)) for k, a in x.items() for i, v in enumerate(a)]
    first = spark.createDataFrame([("early", -2.5), ("early", None)], "r string, aligned_time_s double")
    got = sessions.behaviour(spark.createDataFrame(rows, "r string, i int, p double, w double"), first, ["r"], "i", {"p": 2.0, "w": 3.0}, ["w"], 20.0, 0.0).collect()
    for k, start in (("early", 2.5), ("plain", 0.0)):
        p, w, t = smooth(x[k], 2.0), smooth(x[k] - 5, 3.0), np.arange(len(x[k])) / 20
        mine = sorted((g["time"], g["p"], g["w"]) for g in got if g["r"] == k)
        keep = t >= start
        # Without a crop nothing lies before it, so the whole series scales.
        want = zip(t[keep] - start, p[keep] / (p.max() + 1e-6), w[keep] / (np.abs(w).max() + 1e-6), strict=True)
        assert len(mine) == keep.sum() and all(m == pytest.approx(v) for m, v in zip(mine, want, strict=True))


def test_edges_are_counted_across_chunks(spark, short_chunks):
    up = [0.0] * 16 + [1.0] * 16 + [0.0, 1.0, 0.5, 1.0, float("nan"), None, 0.9]
    rows = [("a", 0, 0, "", i, v) for i, v in enumerate(up)] + [("a", 0, 1, "flat", i, 3.0) for i in range(5)] + [("a", 1, 0, "flat", i, float(i)) for i in range(5)] + [("a", 1, 1, "one", 0, 1.0)]
    df = spark.createDataFrame(rows, "f string, tab int, col int, own string, i int, v double").repartition(2)
    got = sorted(map(tuple, sessions.trigger_channels(df, "f", "tab", "col", "own", "i", "v", [["x", "y", "z"]]).collect()))
    assert got == [("a", "0_var0", 39, 4), ("a", "flat", 5, 0)]
    assert sessions.trigger_edges(df.where("false"), ["f"], "i", "v").count() == 0


def test_unit_attributes_that_are_missing_or_broken(spark):
    full = {"MethodTypeDebugString": "zStackScan", "TStepInMs": 20, "MinZ": -10, "MaxZ": 20, "Slices": 2, "MeasurementDatePosix": 86400, "DeviceJSON": json.dumps({"devices": [{"name": "UG", "position": 1}, {"name": "UG", "position": 2}]})}
    snake = full | {"MethodTypeDebugString": "snakeScan", "Slices": 4, "DeviceJSON": "[", "MultiROIProtocolJSON": json.dumps({"scanPatterns": {"patterns": []}})}
    rows = [("f", "s", k, t, [("c", v)]) for k, t, v in (("stack", json.dumps(full), [4, 5, 6]), ("snake", json.dumps(snake), [12, 5, 6]), ("broken", "{", [1, 5, 6]), ("none", None, [7, 5, 6]), ("uneven", json.dumps(snake), [13, 5, 6]))]
    rows.append(("f", "s", "no channel", "{}", []))
    df = spark.createDataFrame(rows, "file string, session string, unit string, attributes string, channels array<struct<name string, shape array<int>>>")
    out = sessions.unit_channels(df)
    got = {r["unit"]: r for r in out.collect()}
    assert len(out.columns) == 47 and set(got) == {"stack", "snake", "broken", "none", "uneven"}
    s, n = got["stack"], got["snake"]
    assert (s["n_z"], s["n_t"], s["z_step_um"], s["zstack_n_planes"], s["duration_calc_s"], s["UG"], s["timestamp"]) == (4, 1, 10.0, 4, None, 2.0, "1970-01-02 00:00:00 UTC")
    assert (n["n_z"], n["n_t"], n["z_step_um"], n["snake_n_slices"], n["duration_calc_s"], n["slice_rate_hz"], n["UG"], n["pixel_x_um"]) == (4, 3, 10.0, 4, 0.06, 200.0, None, None)
    assert (got["broken"]["scan_type"], got["broken"]["timestamp"], got["none"]["n_t"], got["uneven"]["n_t"], got["uneven"]["n_z"]) == ("snapshot", "unknown", 7, 13, 4)


def test_paths_and_renames(spark):
    paths = ["/x/m1/06-12-2026/preprocessed/munit9/run04/a.tif", "m1/06-12-2026/munit9/a", "06-12-2026/x/a", "m1/run4/a", None]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(sessions.run_identity(F.col("p")).alias("r")).collect()
    assert [r["r"] and tuple(r["r"]) for r in got] == [("m1", "06-12-2026", 4, "run04"), ("m1", "06-12-2026", 9, "munit9"), None, None, None]
    folders = spark.createDataFrame([("m/run5", 7), ("m/run06", 6), ("m/odd", None), ("m/run8", 123)], "folder string, number int")
    names = ["run5.tif", "run53d.tif", "run53d_clean.csv", "run5branch.csv", "a_Run3_x_4D.tif", "a_Run3_x_4D_b.tif", "MSession_1_MUnit_2.json", "notes.txt", "munit_5.png", "run07.tif", ".run5"]
    files = [("m/run5", n) for n in names] + [("m/run06", "run06.tif"), ("m/odd", "odd.tif"), ("m/run8", "run8_a.tif"), ("m/gone", "run1.tif")]
    got = sorted((tuple(r) for r in sessions.rename_plan(folders, spark.createDataFrame(files, "folder string, name string")).collect()), key=lambda r: tuple(x or "" for x in r))
    to = {"run5.tif": "run07_4d.tif", "run53d.tif": "run07_4d.tif", "run53d_clean.csv": "run07_clean.csv", "run5branch.csv": "run07branch.csv", "a_Run3_x_4D.tif": "run07_4d.tif", "a_Run3_x_4D_b.tif": "run07_b.tif", "MSession_1_MUnit_2.json": "run07.json", "munit_5.png": "run07.png"}
    want = [("dir", "m/run5", "m/run07"), ("dir", "m/run8", "m/run123"), ("skip", "m/odd", None), ("file", "m/run8/run8_a.tif", "m/run8/run123_a.tif")]
    assert got == sorted(want + [("file", f"m/run5/{a}", f"m/run5/{b}") for a, b in to.items()], key=lambda r: tuple(x or "" for x in r))


def test_hand_masks_need_all_files(spark):
    r = spark.createDataFrame([("a", 1, "hand"), ("b", 1, "hand"), ("b", 2, "auto"), ("c", 1, "auto"), ("c", 2, "hand"), ("d", 1, "hand"), ("e", 1, None)], "s string, i int, tool string")
    p = spark.createDataFrame([(s + x,) for s in "abce" for x in (".tif", "_r.tif")] + [("a.tif",), ("d.tif",)], "path string")
    found = lambda last: sorted(x["s"] for x in sessions.hand_masks(r, p, "s", ["i"], "tool", "hand", "auto", [".tif", "_r.tif"], last).collect())
    assert found(False) == ["a"] and found(True) == ["a", "c"]


def test_pairs_with_a_pad_follow_the_greedy_loop(spark):
    rng = np.random.default_rng(5)
    for _ in range(4):
        xs, ys = rng.choice(400, 60, replace=False), rng.choice(400, 60, replace=False)
        took, record = rng.integers(0, 40, 60), [None if k % 7 == 0 else int(k) for k in rng.integers(0, 60, 60)]
        a = spark.createDataFrame([("k", int(x), int(t)) for x, t in zip(xs, took, strict=True)], "k string, x int, took int")
        b = spark.createDataFrame([("k", int(y), r) for y, r in zip(ys, record, strict=True)], "k string, y int, record int")
        got = {(r["x"], r["y"]) for r in rel.greedy_pairs(a, b, ["k"], "x", "y", 0, 30, (F.col("record") - F.col("took")).between(0, 20)).collect()}
        free, want = dict(zip(xs.tolist(), took.tolist(), strict=True)), set()
        for y, r in sorted(zip(ys.tolist(), record, strict=True), key=lambda p: p[0]):
            fit = [x for x, t in free.items() if 0 <= y - x <= 30 and (r is None or 0 <= r - t <= 20)]
            if fit:
                want.add((max(fit), y))
                del free[max(fit)]
        assert got == want
