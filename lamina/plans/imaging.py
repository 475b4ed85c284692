"""Queries on registration, skeletons, paths, distances, mixtures and trees."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.operators import distance, growth, hierarchy, mixture, placement, registration, run_row, skeleton, trees
from lamina.plans.fixtures import query, r6, runs, voxels
from lamina.sources.readers import staged

YX = ["y", "x"]
BOX = {"y": (0, 7), "x": (0, 7)}
SPACING = {"y": 1.0, "x": 2.0}

# The discrete Fourier transform of 8 x 8 frames: k are its frequencies, c the cells.
WAVES = """k AS (SELECT CASE WHEN a < 4 THEN a ELSE a - 8 END AS fy, CASE WHEN b < 4 THEN b ELSE b - 8 END AS fx FROM range(8) t(a), range(8) u(b))
, c AS (SELECT a AS y, b AS x FROM range(8) t(a), range(8) u(b))"""
TURN = "(2 * pi() * (fy * {y} + fx * {x}) / 8)"


def _wave(y: str, x: str) -> str:
    return TURN.format(y=y, x=x)


@query(f"""
WITH {WAVES}
, f AS (SELECT label, frame, fy, fx, sum(v * cos({_wave("y", "x")})) AS re, -sum(v * sin({_wave("y", "x")})) AS im FROM voxels, k GROUP BY ALL)
, r AS (SELECT label, fy, fx, avg(re) AS re, avg(im) AS im FROM f GROUP BY ALL)
, p AS (SELECT frame, fy, fx, r.re * f.re + r.im * f.im AS re, r.im * f.re - r.re * f.im AS im FROM f JOIN r USING (label, fy, fx))
, w AS (SELECT frame, y, x, power(sum(re * cos({_wave("y", "x")}) - im * sin({_wave("y", "x")})), 2) + power(sum(re * sin({_wave("y", "x")}) + im * cos({_wave("y", "x")})), 2) AS m FROM p, c GROUP BY ALL)
, s AS (SELECT frame, CASE WHEN y > 4 THEN y - 8 ELSE y END AS sy, CASE WHEN x > 4 THEN x - 8 ELSE x END AS sx FROM w QUALIFY row_number() OVER (PARTITION BY frame ORDER BY m DESC, y, x) = 1)
, g AS (SELECT frame, sy + a / 10.0 AS y, sx + b / 10.0 AS x FROM s, range(-8, 9) t(a), range(-8, 9) u(b))
, z AS (SELECT frame, y, x, power(sum(re * cos({_wave("y", "x")}) - im * sin({_wave("y", "x")})), 2) + power(sum(re * sin({_wave("y", "x")}) + im * cos({_wave("y", "x")})), 2) AS m FROM g JOIN p USING (frame) GROUP BY ALL)
SELECT frame, round(CAST(y AS DOUBLE), 6) AS shift_y, round(CAST(x AS DOUBLE), 6) AS shift_x FROM z QUALIFY row_number() OVER (PARTITION BY frame ORDER BY m DESC, y, x) = 1
""")
def vol15_registration(spark, d):
    v = voxels(spark, d).select("label", "frame", *YX, "v")
    return registration.register(v, ["label"], "frame", "v", BOX).groupBy("frame").agg(*[F.round(F.first(f"shift_{a}"), 6).alias(f"shift_{a}") for a in YX])


@query()
def vol15_two_pass(spark, d):
    v = voxels(spark, d).select("label", "frame", *YX, "v")
    done = staged(registration.register_twice(v, ["label"], "frame", "v", BOX), "registered")
    return registration.sharpness(registration.mean_frame(done, ["label"], YX, "v"), ["label"], "y", "x", "v").select("label", *r6("sharpness"))


@query(f"""
WITH {WAVES}
, n AS (SELECT label, frame, row_number() OVER (PARTITION BY label ORDER BY frame) AS i, count(*) OVER (PARTITION BY label) // 3 AS third, count(*) OVER (PARTITION BY label) AS n FROM (SELECT DISTINCT label, frame FROM voxels))
, e AS (SELECT label, frame, i <= third AS head FROM n WHERE third > 0 AND (i <= third OR i > n - third))
, f AS (SELECT label, head, fy, fx, sum(m * cos({_wave("y", "x")})) AS re, -sum(m * sin({_wave("y", "x")})) AS im FROM (SELECT label, head, y, x, avg(v) AS m FROM voxels JOIN e USING (label, frame) GROUP BY ALL), k GROUP BY ALL)
, p AS (SELECT a.label, fy, fx, a.re * b.re + a.im * b.im AS re, a.im * b.re - a.re * b.im AS im FROM f a JOIN f b USING (label, fy, fx) WHERE a.head AND NOT b.head)
, q AS (SELECT label, fy, fx, re / (sqrt(re * re + im * im) + 1e-9) AS re, im / (sqrt(re * re + im * im) + 1e-9) AS im FROM p)
, w AS (SELECT label, y, x, power(sum(re * cos({_wave("y", "x")}) - im * sin({_wave("y", "x")})), 2) + power(sum(re * sin({_wave("y", "x")}) + im * cos({_wave("y", "x")})), 2) AS m FROM q, c GROUP BY ALL)
SELECT label, CASE WHEN y > 4 THEN y - 8 ELSE y END AS drift_y, CASE WHEN x > 4 THEN x - 8 ELSE x END AS drift_x FROM w QUALIFY row_number() OVER (PARTITION BY label ORDER BY m DESC, y, x) = 1
""")
def ts20_drift(spark, d):
    return registration.drift(voxels(spark, d).select("label", "frame", *YX, "v"), ["label"], "frame", "v", BOX)


@query("""
WITH t AS (SELECT frame, y, x FROM voxels WHERE v > 0.25)
SELECT a.frame, a.y, a.x, round(min(sqrt((a.y - t.y) * (a.y - t.y) + 4 * (a.x - t.x) * (a.x - t.x))), 6) AS dist FROM voxels a LEFT JOIN t USING (frame) GROUP BY ALL
""")
def vol5_exact_distance(spark, d):
    v = voxels(spark, d).select("frame", *YX, (F.col("v") > 0.25).alias("target"))
    return distance.distance_transform(v, "target", ["frame"], SPACING).select("frame", *YX, F.round("dist", 6).alias("dist"))


def _skeleton(spark, d):
    """The thinned cells of values above 0 and their ids."""
    thick = voxels(spark, d).where("v > 0").select("frame", *YX)
    return staged(skeleton.thin(thick, ["frame"], YX).withColumn("id", F.col("frame") * 64 + F.col("y") * 8 + F.col("x")), "skeleton")


@query()
def vol7_skeleton(spark, d):
    return _skeleton(spark, d)


@query()
def vol7_arcs(spark, d):
    _, arcs = skeleton.skeleton_graph(_skeleton(spark, d), ["frame"], SPACING, "id")
    return arcs.withColumn("length", F.round("length", 6))


@query()
def vol7_anatomy(spark, d):
    inside = voxels(spark, d).select("frame", *YX, (F.col("v") <= 0).alias("target"))
    wide = distance.distance_transform(inside, "target", ["frame"], SPACING).withColumnRenamed("dist", "radius")
    cells = _skeleton(spark, d).join(wide, ["frame", *YX]).withColumn("radius", F.coalesce("radius", F.lit(0.0)))
    return skeleton.anatomy(cells, ["frame"], SPACING, "id", "radius").withColumn("dist", F.round("dist", 6))


def _bright(spark, d):
    """Cells with a value from 0 to 1 and its cost."""
    v = voxels(spark, d).withColumn("id", F.col("frame") * 64 + F.col("y") * 8 + F.col("x"))
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(F.col("v") * 2, 3)))
    return staged(v.withColumn("value", value).withColumn("cost", skeleton.ridge_cost(F.col("value"))).select("frame", *YX, "id", "value", "cost"), "bright")


@query()
def vol10_path(spark, d):
    cells = _bright(spark, d)
    end = lambda x: cells.where(F.col("x") == x).groupBy("frame").agg(F.max_by("id", F.struct("value", -F.col("y"))).alias("id")).select("id")
    tree = staged(skeleton.cell_tree(cells, ["frame"], SPACING, "id", end(0), "cost"), "tree")
    return skeleton.cell_path(tree, ["frame"], YX, end(7)).select("target", "id", F.round("dist", 6).alias("dist"))


@query()
def vol10_growth(spark, d):
    cells = _bright(spark, d)
    line = cells.where("value > 0.5")
    # The way costs more where it is dark.
    dark = cells.withColumn("cost", 1 / (F.col("value") + 0.05))
    tree = staged(skeleton.cell_tree(dark, ["frame"], SPACING, "id", line.select("id"), "cost"), "tree")
    grown = skeleton.grow(cells.withColumn("radius", 8 * F.col("value")), tree, "id", "value", "radius", 0.4, 2.0)
    return grown.withColumn("dist", F.round("dist", 6))


STEPS = 12


def _em(steps: int) -> str:
    """Steps of EM as common table expressions."""
    out = ["""
WITH q AS (SELECT grp, count(*) AS n, avg(x) AS mu, stddev_pop(x) AS sd FROM runs GROUP BY grp), z AS (SELECT grp, (x - mu) / sd AS z FROM runs JOIN q USING (grp))
, s0 AS (SELECT grp, 0.5::DOUBLE AS w, -1.0::DOUBLE AS m1, 1.0::DOUBLE AS v1, 1.0::DOUBLE AS m2, 1.0::DOUBLE AS v2 FROM q)"""]
    for i in range(steps + 1):
        out.append(f"""
, a{i} AS MATERIALIZED (SELECT grp, z, ln(w) - ln(v1) / 2 - (z - m1) * (z - m1) / (2 * v1) AS a, ln(1 - w) - ln(v2) / 2 - (z - m2) * (z - m2) / (2 * v2) AS b FROM z JOIN s{i} USING (grp))
, l{i} AS (SELECT grp, z, a, greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS l FROM a{i})
, r{i} AS (SELECT grp, z, l, exp(a - l) AS r FROM l{i})
, t{i} AS (SELECT grp, sum(l) AS l, sum(r) AS r, sum(1 - r) AS s, sum(r * z) AS rz, sum((1 - r) * z) AS sz, sum(r * z * z) AS rzz, sum((1 - r) * z * z) AS szz FROM r{i} GROUP BY grp)
, s{i + 1} AS MATERIALIZED (SELECT grp, r / (r + s) AS w, rz / r AS m1, greatest(rzz / r - power(rz / r, 2), 0) + 1e-6 AS v1, sz / s AS m2, greatest(szz / s - power(sz / s, 2), 0) + 1e-6 AS v2 FROM t{i})""")
    return "".join(out) + f"""
SELECT grp, n, round(w, 6) AS weight_1, round(mu + sd * m1, 4) AS mean_1, round(sd * sqrt(v1), 4) AS sd_1, round(mu + sd * m2, 4) AS mean_2, round(sd * sqrt(v2), 4) AS sd_2,
    round(2 * (l - n * ln(2 * pi()) / 2 + n / 2 * (ln(2 * pi()) + 1 + 1e-6)), 5) AS lr, round(abs(m1 - m2) / sqrt((v1 + v2) / 2), 6) AS ashman_d
FROM s{steps} JOIN q USING (grp) JOIN t{steps} USING (grp)"""


@query(_em(STEPS))
def st15_mixture(spark, d):
    fit = mixture.fit_two_modes(runs(spark, d), ["grp"], "x", STEPS, -1.0)
    rounded = {"weight_1": 6, "mean_1": 4, "sd_1": 4, "mean_2": 4, "sd_2": 4, "lr": 5, "ashman_d": 6}
    return fit.select("grp", "n", *[F.round(c, n).alias(c) for c, n in rounded.items()])


@query()
def st15_bimodality(spark, d):
    fit = mixture.bimodality(runs(spark, d), ["grp"], "x", 30)
    return fit.select("grp", "n", *r6("lr", "d_bic", "ashman_d", "min_weight", "p"))


def _level(i: int) -> str:
    """The splits of the nodes of one level, and the rows below them."""
    return f"""
, v{i} AS (SELECT node, feature, value, count(*) AS n, sum(CASE WHEN pos THEN w ELSE 0 END) AS a, sum(CASE WHEN pos THEN 0 ELSE w END) AS b FROM (UNPIVOT (SELECT node, pos, w, x, y, z FROM n{i} WHERE node >= {1 << i}) ON x, y, z INTO NAME feature VALUE value) GROUP BY ALL)
, c{i} AS (SELECT node, feature, value, lead(value) OVER o AS nxt, sum(n) OVER o AS ln, sum(a) OVER o AS la, sum(b) OVER o AS lb, sum(n) OVER p AS tn, sum(a) OVER p AS ta, sum(b) OVER p AS tb FROM v{i} WINDOW o AS (PARTITION BY node, feature ORDER BY value ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY node, feature))
, g{i} AS (SELECT node, feature, (value + nxt) / 2 AS threshold, round(2 * ta * tb / (ta + tb) - 2 * la * lb / (la + lb) - 2 * (ta - la) * (tb - lb) / (ta + tb - la - lb), 9) AS fall FROM c{i} WHERE nxt IS NOT NULL AND ln >= 20 AND tn - ln >= 20)
, b{i} AS MATERIALIZED (SELECT node, feature, threshold FROM g{i} WHERE fall > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY fall DESC, feature, threshold) = 1)
, n{i + 1} AS MATERIALIZED (SELECT pos, w, x, y, z, CASE WHEN threshold IS NULL THEN node ELSE 2 * node + CASE WHEN CASE feature WHEN 'x' THEN x WHEN 'y' THEN y ELSE z END <= threshold THEN 0 ELSE 1 END END AS node FROM n{i} LEFT JOIN b{i} USING (node))"""


TREE = f"""
WITH t AS (SELECT count(*) AS n, count(*) FILTER (sub % 2 = 0) AS a FROM runs)
, n0 AS MATERIALIZED (SELECT sub % 2 = 0 AS pos, CASE WHEN sub % 2 = 0 THEN n / (2.0 * a) ELSE n / (2.0 * (n - a)) END AS w, x, y, z, 1 AS node FROM runs, t){_level(0)}{_level(1)}
, u AS (SELECT pos, w, unnest(list_distinct([node, node // 2, node // 4])) AS node FROM n2)
SELECT node, floor(log2(node))::INT AS depth, feature, round(threshold, 4) AS threshold, count(*) AS n, count(*) FILTER (pos) AS n_positive, round(sum(CASE WHEN pos THEN w ELSE 0 END) / sum(w), 6) AS p
FROM u LEFT JOIN (SELECT * FROM b0 UNION ALL SELECT * FROM b1) USING (node) WHERE node > 0 GROUP BY ALL
"""


def _tree(spark, d):
    return trees.decision_tree(runs(spark, d).withColumn("pos", F.col("sub") % 2 == 0), ["x", "y", "z"], "pos", 2, 20)


@query(TREE)
def ml12_tree(spark, d):
    return _tree(spark, d).select("node", "depth", "feature", F.round("threshold", 4).alias("threshold"), "n", "n_positive", F.round("p", 6).alias("p"))


@query()
def ml12_tree_text(spark, d):
    return trees.tree_text(_tree(spark, d))


@query()
def ml9_leave_one_out(spark, d):
    v = voxels(spark, d).select("label", "frame", *YX, "v")
    row, column = (v.groupBy("frame", a).agg(F.avg("v").alias(f"mean_{a}"), F.max("v").alias(f"top_{a}")) for a in YX)
    x = v.join(row, ["frame", "y"]).join(column, ["frame", "x"]).withColumn("bright", F.col("v") + F.col("mean_y") + F.col("mean_x") > 0.15)
    out = trees.leave_one_out(x, "label", ["v", "mean_y", "mean_x", "top_y", "top_x", "y", "x"], "bright", [0.3 + 0.05 * i for i in range(12)], trees=4, depth=3, rate=0.3)
    return out.select("label", "n", "n_positive", *r6("dice_half", "precision_half", "recall_half", "best_dice", "best_cut"))


@query()
def ts25_full_row(spark, d):
    """Labels as runs of frames and lines of a plane as regions; some runs lack a soma, a rate or branches."""
    v = voxels(spark, d).select(F.col("label").alias("run"), "frame", *YX, "v")
    t = v.select("run", "frame").distinct().withColumn("t", F.row_number().over(Window.partitionBy("run").orderBy("frame")) - 1)
    x = v.join(t, ["run", "frame"]).where("run <> 9 or y < 3")
    vox = x.select("run", F.col("y").alias("region"), F.col("x").alias("cell"), "t", (F.col("v") + 1).alias("v"), F.col("x").between(1, 6).alias("core"))
    kind = F.when((F.col("region") == 0) & (F.col("run") % 3 != 1), "soma").when(F.col("region") < 3, "trunk").otherwise("branch")
    regions = vox.select("run", "region").distinct().select("run", "region", kind.alias("compartment"), F.col("region").cast("double").alias("place"))
    per_run = vox.select("run").distinct().select("run", F.when(F.col("run") != 4, 0.2 + F.col("run") * 0.05).alias("rate"), (F.col("run") % 2 == 0).alias("deep_first"))
    signals = x.groupBy("run", "t").agg(F.avg("v").alias("pupil"), F.max(F.when(F.col("x") < 4, F.col("v"))).alias("whisker"))
    row = run_row.metric_rows(vox, regions, per_run, run_row.state_of(signals, ["pupil", "whisker"]), draws=200)
    return row.select(*[F.round(c, 5).alias(c) if k == "double" else c for c, k in row.dtypes])


@query()
def ml3_cell_types(spark, d):
    profile = runs(spark, d).groupBy("sub").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), F.stddev_samp("x").alias("spread"))
    out = hierarchy.cell_types(profile.withColumn("sub", F.col("sub").cast("long")), "sub", ["x", "y", "z", "spread"])
    return out.withColumn("silhouette", F.round("silhouette", 6))


@query("""
WITH v AS (SELECT label AS cell, frame AS t, y * 8 + x AS voxel, x * 4.0 + y * 0.5 AS loc, v FROM voxels)
, z AS (SELECT DISTINCT cell, zone, lo, hi FROM v, (VALUES (0, 0.0, 16.0), (1, 16.0, 32.0)) t(zone, lo, hi))
, w AS (SELECT cell, zone, lo + i * 2.0 AS start, least(lo + i * 2.0 + n, hi) AS "end" FROM z, (VALUES (6.4), (8.0), (9.6), (5.0), (12.0)) l(n), range(8) r(i) WHERE lo + i * 2.0 + n <= hi + 0.01)
, p AS (SELECT cell, zone, start, "end", count(*) AS n_voxels FROM (SELECT DISTINCT cell, voxel, loc FROM v) JOIN w USING (cell) WHERE loc >= start AND loc < "end" GROUP BY ALL)
SELECT cell, zone, CAST(start AS DOUBLE) AS start, CAST("end" AS DOUBLE) AS "end", n_voxels FROM p WHERE n_voxels >= 10
""")
def vol12_windows(spark, d):
    vox, zones = _zones(spark, d)
    out = placement.window_reliability(vox, placement.candidate_windows(zones, 8.0, 5.0, 2.0), 10)
    return out.select("cell", "zone", "start", "end", "n_voxels")


@query()
def vol12_regions(spark, d):
    vox, zones = _zones(spark, d)
    return placement.place_regions(vox, zones, 8.0, 5.0, 2.0, 10).withColumn("reliability", F.round("reliability", 6))


def _zones(spark, d):
    """Planes as cells along x, and their halves as zones."""
    vox = voxels(spark, d).select(F.col("label").alias("cell"), F.col("frame").alias("t"), (F.col("y") * 8 + F.col("x")).alias("voxel"), (F.col("x") * 4.0 + F.col("y") * 0.5).alias("at"), "v")
    zone = F.explode(F.array(*[F.struct(F.lit(i).alias("zone"), F.lit(16.0 * i).alias("lo"), F.lit(16.0 * (i + 1)).alias("hi")) for i in range(2)]))
    return vox, vox.select("cell").distinct().select("cell", zone.alias("_z")).select("cell", "_z.*")


@query()
def x24_high_pass(spark, d):
    v = voxels(spark, d).select("frame", *YX, "v")
    high = growth.high_pass(v, ["frame"], BOX, {"y": 0.5, "x": 0.5}, {"y": 2.0, "x": 2.0}, "v")
    scaled = staged(growth.normalised(high, ["frame"], "v"), "scaled")
    return growth.keep_touching(scaled.where("v > 0.2"), scaled.where("v > 0.9"), ["frame"], YX)


@query()
def vol17_connected_growth(spark, d):
    v = voxels(spark, d).select("label", "frame", *YX, "v")
    seeds = v.where("y in (3, 4) and x in (3, 4)").select("label", *YX).distinct()
    scored = staged(growth.seed_correlation(v, seeds, ["label"], "frame", YX, "v", 9), "scored")
    return growth.grow_by_seed(scored, seeds, ["label"], YX, 0.05, 0.6, 0.2, "x", 3, 0.3, 2)


@query("""
WITH n AS (SELECT label, frame, row_number() OVER (PARTITION BY label ORDER BY frame) AS i FROM (SELECT DISTINCT label, frame FROM voxels))
, m AS (SELECT label, y, x, avg(v) AS m, arg_min(v, frame) AS first FROM voxels GROUP BY ALL)
, p AS (SELECT a.label, a.y AS p, b.y AS q, corr(a.m, b.m) AS r, bool_and(a.first = b.first) AS same FROM m a JOIN m b ON a.label = b.label AND a.x = b.x AND a.y <= b.y GROUP BY ALL)
, l AS (SELECT label, max(m) - min(m) AS mean_range FROM (SELECT label, y, avg(m) AS m FROM m GROUP BY ALL) GROUP BY label)
SELECT label, (SELECT count(*) FROM n WHERE n.label = p.label) AS n_frames, count(DISTINCT p) AS n_planes, round(avg(r) FILTER (q = p + 1), 6) AS neighbour_r, round(max(r) FILTER (p = 0 AND q = 7), 6) AS first_last_r, count(*) FILTER (q = p + 1 AND same) AS equal_planes, round(any_value(mean_range), 6) AS mean_range
FROM p JOIN l USING (label) GROUP BY label
""")
def ml11_plane_likeness(spark, d):
    out = growth.plane_redundancy(voxels(spark, d), ["label"], "frame", "y", ["x"], "v")
    return out.select("label", "n_frames", "n_planes", *r6("neighbour_r", "first_last_r"), "equal_planes", F.round("mean_range", 6).alias("mean_range"))


@query()
def ml11_redundancy(spark, d):
    return growth.plane_redundancy(voxels(spark, d), ["label"], "frame", "y", ["x"], "v").select("label", F.round("pc1_share", 6).alias("pc1_share"), "n_comp_95")
