"""Small cases of operators whose results are random, iterative or streamed."""

import math

import pytest
from pyspark.sql import functions as F

from lamina.operators import catalog, learn, ranking, relational, stats, volume
from lamina.sources import readers
from lamina.streaming import windows


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_band_join_kinds(spark):
    a = rows(spark, [(1, 0.0), (1, 5.0), (2, 1.0)], "k int, x double")
    b = rows(spark, [(1, 1.0), (1, 9.0), (3, 1.0)], "k int, y double")
    assert sorted(map(tuple, relational.band_join(a, b, ["k"], "x", "y", -2, 2).select("k", "x", "y").collect())) == [(1, 0.0, 1.0)]
    assert sorted(map(tuple, relational.band_join(a, b, ["k"], "x", "y", -2, 2, "left_semi").collect())) == [(1, 0.0)]
    assert sorted(map(tuple, relational.band_join(a, b, ["k"], "x", "y", -2, 2, "left_anti").collect())) == [(1, 5.0), (2, 1.0)]


def test_bootstrap_holds_the_mean_and_repeats(spark):
    df = rows(spark, [(g, float(g + i)) for g in range(6) for i in range(5)], "g int, v double")
    one, two = (stats.cluster_bootstrap(df, "g", "v", 300).first() for _ in range(2))
    assert one == two and one["lo"] <= 4.5 <= one["hi"] and abs(one["mean"] - 4.5) < 0.5


def test_permutation_finds_a_strong_link(spark):
    df = rows(spark, [(i % 3, float(i), float(i * i)) for i in range(30)], "g int, x double, y double")
    got = stats.permutation_test(df, "g", "x", "y", 100).first()
    assert got["observed"] > 0.9 and got["p"] < 0.05


def test_random_intercept_slope(spark):
    df = rows(spark, [(g, float(i), 2.0 * i + 10 * g + math.sin(7 * i + g)) for g in range(8) for i in range(12)], "g int, x double, y double")
    got = stats.random_intercept(df, "g", "x", "y").first()
    assert abs(got["slope"] - 2) < 0.1 and got["ratio"] > 1 and got["lr"] > 50


def test_wilson_of_nothing_is_null(spark):
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    got = rows(spark, [(0, 0), (5, 10)], "k int, n int").select(lo.alias("lo"), hi.alias("hi")).collect()
    assert got[0]["lo"] is None and got[1]["lo"] < 0.5 < got[1]["hi"]


def test_groups_and_paths(spark):
    t = [(1, u, i, math.sin(i + (0 if u < 2 else 2)) + 0.01 * u) for u in range(4) for i in range(40)]
    got = {r["u"]: r["cluster"] for r in learn.correlation_groups(rows(spark, t, "run int, u int, t int, f double"), ["run"], "u", "t", "f").collect()}
    assert got[0] == got[1] != got[2] == got[3]
    edges = rows(spark, [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (4, 5, 1.0)], "src int, dst int, w double")
    dist = dict(volume.shortest_paths(edges, rows(spark, [(1,)], "id int")).select("id", "dist").collect())
    assert dist == {1: 0.0, 2: 1.0, 3: 2.0}


def test_unit_or_fail(spark):
    u = rows(spark, [("a", 9), ("b", 10)], "unit string, frames int")
    assert readers.unit_or_fail(u, F.col("unit") == "a", "frames", 3).first()["volumes"] == 3
    with pytest.raises(Exception, match="don't divide"):
        readers.unit_or_fail(u, F.col("unit") == "b", "frames", 3).collect()


def test_versions_are_not_overwritten(spark, tmp_path):
    df = rows(spark, [(1,)], "a int")
    readers.write_version(df, str(tmp_path), "v1")
    with pytest.raises(Exception, match="(?i)exist"):
        readers.write_version(df, str(tmp_path), "v1")


def test_csv_and_json_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,pupil\n1,\n2,0.5\n")
    got = readers.read_csv(spark, str(tmp_path / "a.csv"), "time int, pupil double", {"best": ["missing", "pupil"]}).orderBy("time").collect()
    assert [r["best"] for r in got] == [None, 0.5]
    (tmp_path / "j" / "old").mkdir(parents=True)
    (tmp_path / "j" / "m.json").write_text('{"k": 1}')
    (tmp_path / "j" / "old" / "m.json").write_text('{"k": 2}')
    assert [r["k"] for r in readers.read_json_tree(spark, str(tmp_path / "j"), "k int").collect()] == [1]


def test_stream_windows_over_two_files(spark, tmp_path):
    day = "timestamp_ntz'2024-01-01 00:00:00'"
    for i in range(2):
        spark.range(10).select(F.expr(f"{day} + make_interval(0,0,0,0,0, id * 20)").alias("ts"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value")).write.parquet(str(tmp_path / "in" / f"p{i}"))
    got = windows.hourly_counts(spark, str(tmp_path / "in" / "*")).orderBy("hour").collect()
    assert [r["n"] for r in got] == [6, 6, 6, 2] and sum(r["total"] for r in got) == 20


def test_places_of_ties_nulls_and_no_rows(spark):
    t = [(i, None if i % 7 == 0 else i % 3) for i in range(500)]
    got = dict(ranking.place(rows(spark, t, "id int, v int").repartition(5), F.asc_nulls_last("v"), F.desc("id")).select("id", "place").collect())
    want = sorted(t, key=lambda r: (r[1] is None, r[1] or 0, -r[0]))
    assert got == {r[0]: k + 1 for k, r in enumerate(want)}
    assert ranking.place(rows(spark, [], "id int"), "id").count() == 0


def test_greedy_pairs_in_order_of_the_later_side(spark):
    import random

    draw = random.Random(5)
    a = [(k, x) for k in range(3) for x in draw.sample(range(400), 60)]
    b = [(k, y) for k in range(3) for y in draw.sample(range(400), 60)]
    want, taken = set(), set()
    for k, y in sorted(b):
        free = [x for g, x in a if g == k and 0 <= y - x <= 15 and (k, x) not in taken]
        if free:
            taken.add((k, max(free)))
            want.add((k, max(free), y))
    got = relational.greedy_pairs(rows(spark, a, "k int, x int"), rows(spark, b, "k int, y int"), ["k"], "x", "y", 0, 15)
    assert {tuple(r) for r in got.select("k", "x", "y").collect()} == want


def test_p_of_correlations_and_signed_ranks_against_numeric_integrals(spark):
    import numpy as np

    for n, r in ((3, 0.5), (4, -0.3), (5, 0.9), (12, 0.0), (41, 0.31), (200, 0.11)):
        # Under no correlation the density of r is (1 - r**2) ** ((n - 4) / 2), here with r = sin(u).
        u = np.linspace(-np.pi / 2, np.pi / 2, 400_001)
        f = np.cos(u) ** (n - 3)
        want = f[np.abs(np.sin(u)) >= abs(r)].sum() / f.sum()
        got = spark.range(1).select(stats.correlation_p(F.lit(r), F.lit(n)).alias("p")).first()["p"]
        assert abs(got - want) < 1e-4
    assert spark.range(1).select(stats.correlation_p(F.lit(0.5), F.lit(2)).alias("p")).first()["p"] is None
    for z in (-20.0, -2.5, 0.0, 1.0, 4.0, 30.0):
        got = spark.range(1).select(stats.normal_above(F.lit(z)).alias("p")).first()["p"]
        assert abs(got - 0.5 * math.erfc(z / math.sqrt(2))) < 1e-14


def test_names_of_channels_and_picked_elements(spark):
    t = [("f", "t1", 0, None, 5), ("f", "t1", 1, "own", 9), ("f", "t2", 0, None, 4), ("f", "t2", 1, "", 4), ("f", "t2", 2, "own", 12), ("f", "t3", 0, "gone", 1)]
    got = {(r["channel"], r["n"]) for r in catalog.name_channels(rows(spark, t, "file string, tab string, i int, own string, n int"), "file", "tab", "i", "own", "n", [["d0", "d1"], ["a0"]]).collect()}
    assert got == {("d0", 5), ("d1", 9), ("t2_var0", 4), ("t2_var1", 4), ("own", 12)}
    p = rows(spark, [(1, [3, 4]), (9, [3, 4]), (9, [3, 5]), (-1, [3]), (0, []), (None, [1])], "i int, l array<int>")
    assert [r["e"] for r in p.select(readers.pick_element(F.col("l"), F.col("i"), lambda v: v % 2 == 0).alias("e")).collect()] == [4, 4, 3, 3, None, 1]


def test_mixed_model_against_generalised_least_squares(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    t = [(g, float(x), float(2 * x + 1 + shift + rng.normal())) for g in range(12) for shift in [rng.normal() * 2] for x in rng.normal(size=int(rng.integers(2, 9)))]
    g, x, y = (np.array(c) for c in zip(*t, strict=True))

    def fit(ratio, design):
        v = np.eye(len(y)) + ratio * (g[:, None] == g)
        beta = np.linalg.solve(design.T @ np.linalg.solve(v, design), design.T @ np.linalg.solve(v, y))
        res = y - design @ beta
        return -0.5 * (len(y) * np.log(2 * np.pi * (res @ np.linalg.solve(v, res)) / len(y)) + len(y) + np.linalg.slogdet(v)[1]), beta

    grid = np.r_[0, np.logspace(-4, 3, 141)]
    best = max((fit(r, np.c_[np.ones(len(y)), x]) + (r,) for r in grid), key=lambda q: q[0])
    null = max(fit(r, np.ones((len(y), 1)))[0] for r in grid)
    got = stats.random_intercept(rows(spark, t, "g int, x double, y double"), "g", "x", "y").first()
    assert np.allclose([got["loglik"], got["intercept"], got["slope"], got["ratio"], got["lr"]], [best[0], *best[1], best[2], 2 * (best[0] - null)], rtol=1e-6)
