"""Registration, distances, skeletons, paths, mixtures, trees and stateful streams against plain numeric forms."""

import heapq
import itertools
import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import distance, mixture, registration, skeleton, trees
from lamina.streaming import stateful, windows

BOX = {"y": (0, 31), "x": (2, 41)}


def blobs(dy, dx):
    y, x = np.mgrid[:32, :40]
    return sum(np.exp(-((y - cy - dy) ** 2 + (x - cx - dx) ** 2) / 8) for cy, cx in [(10, 12), (20, 25), (15, 30)])


def cells(spark, frames, schema="stack string, t int, y int, x int, v double"):
    rows = [(s, t, int(y), int(x) + 2, float(v)) for s, t, f in frames for (y, x), v in np.ndenumerate(f)]
    return spark.createDataFrame(rows, schema)


def test_planted_shifts_are_found(spark):
    planted = [(0.0, 0.0), (1.3, -2.7), (-3.4, 0.6), (2.0, 5.0)]
    vox = cells(spark, [(s, i, blobs(*p)) for s in ("a", None) for i, p in enumerate(planted)])
    ref = cells(spark, [("a", 0, blobs(0, 0)), (None, 0, blobs(0, 0))]).drop("t")
    out = registration.register(vox, ["stack"], "t", "v", BOX, ref).cache()
    for r in out.select("stack", "t", "shift_y", "shift_x").distinct().collect():
        assert abs(r["shift_y"] + planted[r["t"]][0]) <= 0.1 + 1e-9 and abs(r["shift_x"] + planted[r["t"]][1]) <= 0.1 + 1e-9
    # What is moved by whole cells comes back onto the reference inside the edges.
    moved = {(r["y"], r["x"] - 2): r["v"] for r in out.where("t = 3 and stack = 'a'").collect()}
    assert max(abs(moved[y, x] - blobs(0, 0)[y, x]) for y in range(6, 26) for x in range(6, 34)) < 1e-9
    assert out.groupBy("stack", "t").count().where("count <> 1280").count() == 0
    clipped = registration.register(vox, ["stack"], "t", "v", BOX, ref, max_shift=1.0)
    assert clipped.agg(F.max("shift_x"), F.min("shift_x")).first()[:] == (1.0, -1.0)
    assert registration.register(vox, ["stack"], "t", "v", BOX, ref.where("stack = 'b'")).where("shift_y is not null").count() == 0


def test_two_passes_sharpen_a_moving_stack(spark):
    rng = np.random.default_rng(1)
    vox = cells(spark, [("a", t, blobs(*rng.uniform(-3, 3, 2))) for t in range(9)])
    sharp = lambda x: registration.sharpness(registration.mean_frame(x, ["stack"], ["y", "x"], "v"), ["stack"], "y", "x", "v").first()["sharpness"]
    assert sharp(registration.register_twice(vox, ["stack"], "t", "v", BOX)) > 1.5 * sharp(vox)


def test_drift_of_thirds_in_three_axes(spark):
    z, y, x = np.mgrid[:6, :12, :12]
    ball = lambda d: np.exp(-((z - 2 - d) ** 2 + (y - 5 + d) ** 2 + (x - 4 - 2 * d) ** 2) / 3)
    rows = [(s, t, *map(int, p), float(v)) for s in (1, 2) for t in range(9) for p, v in np.ndenumerate(ball(0 if t < 6 or s == 2 else 1))]
    vox = spark.createDataFrame(rows, "stack int, t int, z int, y int, x int, v double")
    got = registration.drift(vox, ["stack"], "t", "v", {"z": (0, 5), "y": (0, 11), "x": (0, 11)})
    assert sorted(map(tuple, got.collect())) == [(1, -1, 1, -2), (2, 0, 0, 0)]


@pytest.mark.parametrize("axes", [2, 3])
def test_distances_are_exact(spark, axes):
    rng = np.random.default_rng(axes)
    spacing = dict(zip("zyx"[-axes:], (1.5, 1.0, 0.7)[-axes:], strict=True))
    shape = (5, 7, 9)[-axes:]
    rows, want = [], {}
    for v in range(4):
        hit = rng.random(shape) < (0.08 if v else 0)
        at = np.argwhere(hit) * list(spacing.values())
        for p in np.ndindex(shape):
            rows.append((v, *map(int, p), bool(hit[p])))
            want[v, *p] = min((math.dist(np.array(p) * list(spacing.values()), q) for q in at), default=None)
    df = spark.createDataFrame([*rows, rows[0]], f"v int, {', '.join(f'{a} int' for a in spacing)}, hit boolean").repartition(5)
    got = {tuple(r)[:-1]: r["dist"] for r in distance.distance_transform(df, "hit", ["v"], spacing).collect()}
    assert got.keys() == want.keys() and all(got[k] is None if w is None else abs(got[k] - w) < 1e-9 for k, w in want.items())


def pieces(cells, steps):
    left, n = set(cells), 0
    while left:
        todo, n = [left.pop()], n + 1
        while todo:
            p = todo.pop()
            near = {tuple(a + b for a, b in zip(p, s, strict=True)) for s in steps} & left
            left -= near
            todo += near
    return n


FULL = {k: [s for s in itertools.product((-1, 0, 1), repeat=k) if any(s)] for k in (2, 3)}
FACE = {k: [s for s in v if sum(map(abs, s)) == 1] for k, v in FULL.items()}


@pytest.mark.parametrize("axes", [2, 3])
def test_skeletons_keep_pieces_and_holes(spark, axes):
    rng = np.random.default_rng(axes)
    shape = (3, 10, 12)[-axes:]
    names = list("zyx"[-axes:])
    solid = {}
    for v in range(3 if axes == 2 else 1):
        seeds = rng.random(shape) < 0.06
        grown = {tuple(np.add(p, s)) for p in np.argwhere(seeds) for s in [*FULL[axes], (0,) * axes]}
        solid[v] = {tuple(map(int, p)) for p in grown}
    df = spark.createDataFrame([(v, *p) for v, c in solid.items() for p in c], f"v int, {', '.join(f'{a} int' for a in names)}")
    thin = {v: set() for v in solid}
    for r in skeleton.thin(df.unionByName(df.limit(3)), ["v"], names).collect():
        thin[r["v"]].add(tuple(r)[1:])
    for v, whole in solid.items():
        kept = thin[v]
        around = set(itertools.product(*[range(-2, n + 3) for n in shape]))
        assert kept < whole
        assert pieces(kept, FULL[axes]) == pieces(whole, FULL[axes])
        assert pieces(around - kept, FACE[axes]) == pieces(around - whole, FACE[axes])
        # No border cell could still go: all that stays are ends and cells that hold it together.
        bits = {p: sum(1 << i for i, s in enumerate(skeleton.NEIGHBOURS) if tuple(a + b for a, b in zip(p, s[3 - axes :], strict=True)) in kept and not any(s[: 3 - axes])) for p in kept}
        can = skeleton.simple_points(np.array(list(bits.values())))
        assert not any(c and b.bit_count() > 1 for c, b in zip(can, bits.values(), strict=True))


def test_skeleton_of_a_bar_and_a_ring(spark):
    bar = [(0, y, x) for y in range(3) for x in range(12)]
    ring = [(1, y, x) for y in range(9) for x in range(9) if not (3 <= y <= 5 and 3 <= x <= 5)]
    got = skeleton.thin(spark.createDataFrame(bar + ring, "v int, y int, x int"), ["v"], ["y", "x"]).collect()
    line = [(r["y"], r["x"]) for r in got if r["v"] == 0]
    assert len({x for _, x in line}) == len(line) >= 8
    loop = {(r["y"], r["x"]) for r in got if r["v"] == 1}
    assert all(sum((y + a, x + b) in loop for a, b in FULL[2]) == 2 for y, x in loop)


def test_simple_points_against_counting():
    rng = np.random.default_rng(3)
    patterns = rng.integers(0, 1 << 26, 400)
    for bits, got in zip(patterns, skeleton.simple_points(patterns), strict=True):
        on = {s for i, s in enumerate(skeleton.NEIGHBOURS) if bits >> i & 1}
        off = {s for s in skeleton.NEIGHBOURS if s not in on and sum(map(abs, s)) <= 2}
        faces = {s for s in off if sum(map(abs, s)) == 1}
        left = set(faces)
        seen = 0
        while left:
            seen += 1
            todo = [left.pop()]
            reached = set(todo)
            while todo:
                p = todo.pop()
                near = {q for q in off if q not in reached and sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1}
                reached |= near
                todo += near
            left -= reached
        assert got == (pieces(on, FULL[3]) == 1 and seen == 1)


def skel(spark, art):
    rows = [(0, y, x, y * 100 + x) for y, line in enumerate(art) for x, c in enumerate(line) if c == "#"]
    return spark.createDataFrame(rows, "v int, y int, x int, id int")


def test_graph_of_a_fork(spark):
    nodes, arcs = skeleton.skeleton_graph(skel(spark, ["#....#...", ".#..#...#", "..##.....", "..#......", "..#......", "..#......"]), ["v"], {"y": 1.0, "x": 1.0}, "id")
    kinds = {r["id"]: r["kind"] for r in nodes.collect()}
    assert {k for k, v in kinds.items() if v == "tip"} == {0, 5, 502} and kinds[108] == "lone"
    assert {k for k, v in kinds.items() if v == "junction"} == {202, 203, 302}
    got = sorted((r["from_node"], r["to_node"], r["n_cells"], round(r["length"], 6)) for r in arcs.collect())
    d = math.sqrt(2)
    assert got == sorted([(0, 202, 1, round(2 * d, 6)), (5, 202, 1, round(2 * d, 6)), (202, 502, 1, 2.0)])


def test_graph_of_a_loop_and_of_two_cells(spark):
    _, arcs = skeleton.skeleton_graph(skel(spark, [".##....", "#..#.##", ".##...."]), ["v"], {"y": 1.0, "x": 1.0}, "id")
    got = sorted((r["n_cells"], r["from_node"], r["to_node"], round(r["length"], 6)) for r in arcs.collect())
    assert got == [(0, 105, 106, 1.0), (6, None, None, round(2 + 4 * math.sqrt(2), 6))]


def dijkstra(edges, sources):
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    dist, todo = {}, [(0.0, s) for s in sources]
    heapq.heapify(todo)
    while todo:
        d, u = heapq.heappop(todo)
        if u in dist:
            continue
        dist[u] = d
        for v, w in near.get(u, []):
            if v not in dist:
                heapq.heappush(todo, (d + w, v))
    return dist


def test_paths_are_shortest(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 60, 130), rng.integers(0, 60, 130), rng.uniform(0.1, 2, 130), strict=True) if a != b]
    df = spark.createDataFrame(edges, "src int, dst int, w double")
    tree = skeleton.geodesic_tree(df, spark.createDataFrame([(1,), (2,)], "id int")).cache()
    want = dijkstra(edges, [1, 2])
    got = {r["id"]: r for r in tree.collect()}
    assert {k: round(r["dist"], 9) for k, r in got.items()} == {k: round(v, 9) for k, v in want.items()}
    for r in got.values():
        assert r["prev"] is None or abs(got[r["prev"]]["dist"] + min(w for a, b, w in edges if {a, b} == {r["id"], r["prev"]}) - r["dist"]) < 1e-9
        assert r["source"] == (r["id"] if r["prev"] is None else got[r["prev"]]["source"])
    goal = sorted(want, key=want.get)[-3:]
    walked = {}
    for r in skeleton.path_to(tree, spark.createDataFrame([(g,) for g in [*goal, 999]], "id int")).collect():
        walked.setdefault(r["target"], set()).add(r["id"])
    for g in goal:
        way, at = set(), g
        while at is not None:
            way.add(at)
            at = got[at]["prev"]
        assert walked[g] == way
    assert 999 not in walked
    with pytest.raises(ValueError):
        skeleton.geodesic_tree(df.withColumn("w", F.lit(0.0)), spark.createDataFrame([(1,)], "id int"))


def test_anatomy_and_growth(spark):
    art = ["..........#...", "..........#...", "##############", "....#.........", "....#........."]
    cells = skel(spark, art).withColumn("radius", F.when(F.col("id") == 200, 2.0).otherwise(1.0))
    part = {r["id"]: r["part"] for r in skeleton.anatomy(cells, ["v"], {"y": 1.0, "x": 1.0}, "id", "radius").collect()}
    assert {k for k, p in part.items() if p == 1} == {200, 201, 202}
    assert {k for k, p in part.items() if p == 2} == set(range(203, 214))
    assert {part[10], part[110]} == {3} and {part[304], part[404]} == {4}
    lit = cells.withColumn("light", F.when(F.col("id") > 300, 0.1).otherwise(1.0))
    tree = skeleton.geodesic_tree(skeleton.weighted_edges(cells, ["v"], {"y": 1.0, "x": 1.0}, "id"), cells.where("id in (200, 213)").select("id"))
    grown = {r["id"]: r["source"] for r in skeleton.grow(lit, tree, "id", "light", "radius", 0.5, 3.0).collect()}
    assert grown == {**{i: 200 for i in range(200, 207)}, **{i: 213 for i in (210, 211, 212, 213)}}


def em(x, steps):
    mu, sd = x.mean(), x.std()
    z, w, m, v = (x - mu) / sd, 0.5, np.array([-1.0, 1.0]), np.ones(2)
    for i in range(steps + 1):
        a, b = (np.log(p) - np.log(v[k]) / 2 - (z - m[k]) ** 2 / (2 * v[k]) for k, p in enumerate((w, 1 - w)))
        l = np.logaddexp(a, b)  # noqa: E741
        if i == steps:
            break
        r = np.exp(a - l)
        w = r.mean()
        m = np.array([(r * z).sum() / r.sum(), ((1 - r) * z).sum() / (1 - r).sum()])
        v = np.array([(r * z * z).sum() / r.sum(), ((1 - r) * z * z).sum() / (1 - r).sum()]) - m**2 + 1e-6
    one = -len(x) / 2 * (math.log(2 * math.pi) + 1 + 1e-6)
    return w, mu + sd * m[0], mu + sd * m[1], 2 * ((l - math.log(2 * math.pi) / 2).sum() - one)


def test_mixtures_and_their_p(spark):
    rng = np.random.default_rng(5)
    data = {"two": np.r_[rng.normal(0, 1, 60), rng.normal(6, 1, 40)], "one": rng.normal(3, 2, 80), None: np.r_[rng.normal(100, 1, 30), rng.normal(110, 2, 30)]}
    rows = [(k, float(x)) for k, v in data.items() for x in v] + [("one", None), ("one", float("nan")), ("flat", 1.0), ("flat", 1.0), ("single", 2.0)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(3)
    fit = {r["k"]: r for r in mixture.fit_two_modes(df, ["k"], "x", 8, -1.0).collect()}
    for k, x in data.items():
        w, a, b, lr = em(x, 8)
        r = fit[k]
        assert (r["n"], r["weight_1"], r["mean_1"], r["mean_2"], r["lr"]) == (len(x), pytest.approx(w), pytest.approx(a), pytest.approx(b), pytest.approx(lr, abs=1e-6))
    assert fit["flat"]["lr"] is None and fit["single"]["lr"] is None
    got = [{r["k"]: r for r in mixture.bimodality(d, ["k"], "x", 19).collect()} for d in (df, df.repartition(7))]
    assert {k: r["p"] for k, r in got[0].items()} == {k: r["p"] for k, r in got[1].items()}
    assert got[0]["two"]["p"] == 0.05 == got[0][None]["p"] and got[0]["one"]["p"] > 0.1 and got[0]["flat"]["p"] is None
    assert got[0]["two"]["ashman_d"] > 4 and got[0]["two"]["min_weight"] == pytest.approx(0.4, abs=0.02)
    z = np.array([r["z"] for r in mixture.normal_draws(spark.createDataFrame([("a", 5000)], "k string, n long"), ["k"], 2).collect()])
    assert len(z) == 10_000 and abs(z.mean()) < 0.05 and abs(z.std() - 1) < 0.05 and len(set(z)) == len(z)


def best_split(rows, features, least):
    gini = lambda a, b: 2 * a * b / (a + b) if a + b else 0.0
    found = []
    for f in features:
        own = sorted((r for r in rows if r[f] is not None), key=lambda r: r[f])
        side = lambda part: (sum(r["w"] for r in part if r["y"]), sum(r["w"] for r in part if not r["y"]))
        for i in range(least, len(own) - least + 1):
            if own[i - 1][f] < own[i][f]:
                fall = round(gini(*side(own)) - gini(*side(own[:i])) - gini(*side(own[i:])), 9)
                if fall > 0:
                    found.append((-fall, f, (own[i - 1][f] + own[i][f]) / 2))
    return min(found, default=None)


def test_tree_splits_are_best(spark):
    rng = np.random.default_rng(6)
    data = [{"a": float(rng.integers(0, 9)), "b": float(rng.normal()) if i % 7 else None, "c": 1.0, "y": None if i == 5 else bool(rng.random() < 0.3 + 0.4 * (i % 3 == 0))} for i in range(120)]
    df = spark.createDataFrame([(r["a"], r["b"], r["c"], r["y"]) for r in data], "a double, b double, c double, y boolean")
    tree = trees.decision_tree(df, ["a", "b", "c"], "y", 2, 5)
    got = {r["node"]: r for r in tree.collect()}
    known = [r for r in data if r["y"] is not None]
    n, a = len(known), sum(r["y"] for r in known)
    for r in known:
        r["w"] = n / (2 * a) if r["y"] else n / (2 * (n - a))
    todo = [(1, known)]
    while todo:
        node, rows = todo.pop()
        r = got.pop(node)
        split = best_split(rows, ["a", "b", "c"], 5) if node < 4 else None
        assert (r["n"], r["n_positive"], r["depth"]) == (len(rows), sum(x["y"] for x in rows), node.bit_length() - 1)
        assert r["p"] == pytest.approx(sum(x["w"] for x in rows if x["y"]) / sum(x["w"] for x in rows))
        assert (r["feature"], r["threshold"]) == (split[1:] if split else (None, None))
        if split:
            left = [x for x in rows if x[split[1]] is not None and x[split[1]] <= split[2]]
            todo += [(2 * node, left), (2 * node + 1, [x for x in rows if x not in left])]
    assert not got
    lines = [r["text"] for r in trees.tree_text(tree).orderBy("line").collect()]
    assert lines[0].startswith("|--- ") and " <= " in lines[0] and any(x.startswith("|   |   |--- class: ") for x in lines)
    assert trees.decision_tree(df.limit(0), ["a"], "y").count() == 0
    assert [(r["node"], r["feature"]) for r in trees.decision_tree(df.where("y"), ["a"], "y").collect()] == [(1, None)]


def boosted(bins, y, w, n_trees, depth, rate, ridge, least):
    p = (w * y).sum() / w.sum()
    raw = np.full(len(y), math.log(p / (1 - p)))
    for _ in range(n_trees):
        q = 1 / (1 + np.exp(-raw))
        g, h, node = w * (q - y), w * q * (1 - q), np.ones(len(y), int)
        for level in range(depth):
            for k in range(1 << level, 2 << level):
                own, found = node == k, []
                score = lambda m: g[m].sum() ** 2 / (h[m].sum() + ridge)
                for f in range(bins.shape[1]):
                    for b in np.unique(bins[own, f]):
                        left = own & (bins[:, f] <= b)
                        if least <= left.sum() <= own.sum() - least:
                            gain = round(score(left) + score(own & ~left) - score(own), 9)
                            if gain > 0:
                                found.append((-gain, f, b))
                if found:
                    _, f, b = min(found)
                    node[own] = 2 * k + (bins[own, f] > b)
        for k in np.unique(node):
            m = node == k
            raw[m] -= rate * g[m].sum() / (h[m].sum() + ridge)
    return raw


def test_boosting_as_plain_loops(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.3).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), bool(c)) for i, (r, c) in enumerate(zip(x, y, strict=True))], "i int, a double, b double, c double, y boolean").repartition(4)
    made = trees.Bins(df, ["a", "b", "c"], 8)
    rows = df.select("i", made.column().alias("bins"), "y", F.lit(1.5).alias("weight"), F.lit(True).alias("train"), F.lit("f").alias("fold"))
    out, model = trees.boost(rows, 3, 2, 0.3, 1.0, 10)
    got = {r["i"]: r for r in out.collect()}
    bins = np.array([got[i]["bins"] for i in range(300)])
    assert bins.min() == 0 and bins.max() == 7
    want = boosted(bins, y, np.full(300, 1.5), 3, 2, 0.3, 1.0, 10)
    assert np.allclose([got[i]["raw"] for i in range(300)], want)
    assert model.where("value is not null").groupBy("tree").count().where("count > 4").count() == 0


def test_leaving_cells_out(spark):
    rng = np.random.default_rng(8)
    rows = [(g, float(a), float(b), bool(a + 0.2 * rng.normal() > 0.5)) for g in ("p", "q", "r") for a, b in rng.normal(size=(200, 2))]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0, True), ("p", 1.0, 1.0, None)], "g string, a double, b double, y boolean")
    got = trees.leave_one_out(df, "g", ["a", "b"], "y", [0.3, 0.5, 0.7], trees=5, depth=2, rate=0.5, least=10).collect()
    assert {(r["g"], r["n"]) for r in got} == {("p", 200), ("q", 200), ("r", 200)}
    assert all(r["best_dice"] >= r["dice_half"] > 0.75 and r["best_cut"] in (0.3, 0.5, 0.7) and r["recall_half"] > 0.75 for r in got)


def stream_of(spark, tmp_path, parts):
    for i, part in enumerate(parts):
        spark.createDataFrame(part, "k string, ts timestamp, x double, y double").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    schema = "k string, ts timestamp, x double, y double"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


def test_moments_over_batches_and_their_timeouts(spark, tmp_path):
    start = datetime(2024, 1, 1)
    row = lambda k, minute, x, y: (k, start + timedelta(minutes=minute), x, y)
    rng = np.random.default_rng(9)
    one = [row("a", i, float(rng.normal(5)), float(rng.normal())) for i in range(30)]
    two = [row("a", 30 + i, float(rng.normal(5)), float(rng.normal())) for i in range(30)] + [row("b", 35, 1.0, None), row("c", 36, 2.0, 3.0)]
    late = [row("z", 600, 1.0, 1.0)]
    end = [row("z", 1300, 3.0, 5.0), row("a", 1299, 7.0, 8.0)]
    stream = stream_of(spark, tmp_path, [one, two, late, end])
    out = stateful.running_moments(stream, "k", "x", "y", 120 * 60_000, "10 minutes")
    rows = windows.drain(out, "update", None, {stateful.PROVIDER: stateful.ROCKS}).collect()
    x, y = (np.array([r[i] for r in one + two if r[0] == "a"]) for i in (2, 3))
    most = max((r for r in rows if r["k"] == "a"), key=lambda r: r["n"])
    assert most["n"] == 60 and most["mean_x"] == pytest.approx(x.mean()) and most["var_y"] == pytest.approx(y.var()) and most["cov_xy"] == pytest.approx(np.cov(x, y, bias=True)[0, 1])
    # The key was closed while others went on, and began anew.
    assert [(r["k"], r["n"]) for r in rows if r["closed"] and r["k"] in "ac"] in ([("a", 60), ("c", 1)], [("c", 1), ("a", 60)])
    assert any(r["k"] == "a" and r["n"] == 1 and r["mean_x"] == 7.0 for r in rows) and not any(r["k"] == "b" for r in rows)


def test_joined_moments():
    rng = np.random.default_rng(10)
    x, y = rng.normal(size=(2, 40))
    of = lambda s: (len(x[s]), x[s].mean(), y[s].mean(), ((x[s] - x[s].mean()) ** 2).sum(), ((y[s] - y[s].mean()) ** 2).sum(), ((x[s] - x[s].mean()) * (y[s] - y[s].mean())).sum())
    assert stateful.joined(of(slice(0, 13)), of(slice(13, 40))) == pytest.approx(of(slice(0, 40)))
    nothing = (0, 0.0, 0.0, 0.0, 0.0, 0.0)
    assert stateful.joined(nothing, of(slice(0, 5))) == of(slice(0, 5)) == stateful.joined(of(slice(0, 5)), nothing)
