"""Queries on voxels, masks and graphs, and one on a stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.operators import volume as vol
from lamina.plans.fixtures import mask, panel, query, r6, read, voxels
from lamina.streaming import stateful, windows

YX = ["y", "x"]
BOX = {"y": (0, 7), "x": (0, 7)}
STEPS = "(SELECT a - 1 AS dy, b - 1 AS dx FROM (SELECT unnest(range(0, 3)) AS a), (SELECT unnest(range(0, 3)) AS b) WHERE a <> 1 OR b <> 1)"


@query("SELECT frame, label, y, round(avg(v), 6) AS f FROM voxels GROUP BY ALL")
def agg1_region_trace(spark, d):
    return voxels(spark, d).groupBy("frame", "label", "y").agg(F.round(F.avg("v"), 6).alias("f"))


@query("""
WITH n AS (SELECT *, v - lag(v) OVER (PARTITION BY y, x ORDER BY frame) AS dv FROM voxels)
SELECT y, x, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(quantile_cont(v, 0.995), 6) AS p995, round(median(v), 6) AS med, round(var_pop(dv) / 2, 6) AS noise FROM n GROUP BY ALL
""")
def agg4_voxel_stats(spark, d):
    n = voxels(spark, d).withColumn("dv", F.col("v") - F.lag("v").over(Window.partitionBy("y", "x").orderBy("frame")))
    parts = {"mean": F.avg("v"), "sd": F.stddev_pop("v"), "p995": F.percentile("v", 0.995), "med": F.median("v"), "noise": F.var_pop("dv") / 2}
    return n.groupBy(*YX).agg(*[F.round(v, 6).alias(k) for k, v in parts.items()])


@query("SELECT frame, x, round(max(v), 6) AS top, count(*) FILTER (v > 0) AS n, round(sum(y) FILTER (v > 0) / nullif(count(*) FILTER (v > 0), 0), 6) AS centre FROM voxels GROUP BY ALL")
def agg10_profile(spark, d):
    up = F.when(F.col("v") > 0, F.col("y"))
    return voxels(spark, d).groupBy("frame", "x").agg(F.round(F.max("v"), 6).alias("top"), F.count(up).alias("n"), F.round(F.sum(up) / F.nullif(F.count(up), F.lit(0)), 6).alias("centre"))


@query("""
WITH o AS (SELECT frame, y, x FROM voxels WHERE v > 0.2), j AS (SELECT coalesce(a.frame, b.frame) AS frame, a.y IS NOT NULL AS a, b.y IS NOT NULL AS b FROM mask a FULL JOIN o b ON a.frame = b.frame AND a.y = b.y AND a.x = b.x)
, g AS (SELECT frame, count(*) FILTER (a) AS na, count(*) FILTER (b) AS nb, count(*) FILTER (a AND b) AS tp FROM j GROUP BY frame)
SELECT frame, tp, nb - tp AS fp, na - tp AS fn, round(2 * tp / (na + nb), 6) AS dice, round(tp / (na + nb - tp), 6) AS iou, round(tp / nullif(nb, 0), 6) AS precision, round(tp / nullif(na, 0), 6) AS recall FROM g
""")
def agg13_overlap(spark, d):
    b = voxels(spark, d).where("v > 0.2").select("frame", *YX)
    return vol.overlap_scores(mask(spark, d), b, ["frame"], YX).select("frame", "tp", "fp", "fn", *r6("dice", "iou", "precision", "recall"))


@query(f"SELECT DISTINCT frame, y + dy AS y, x + dx AS x FROM mask, (SELECT * FROM {STEPS} UNION ALL SELECT 0, 0) WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7")
def vol4_dilate(spark, d):
    return vol.dilate(mask(spark, d), ["frame"], YX, BOX)


@query(f"WITH m AS (SELECT frame, y, x FROM voxels WHERE abs(v) > 0.02) SELECT m.frame, m.y, m.x FROM m JOIN (SELECT frame, y + dy AS y, x + dx AS x, count(*) AS n FROM m, {STEPS} GROUP BY ALL) s USING (frame, y, x) WHERE n = 8")
def vol4_erode(spark, d):
    return vol.erode(mask(spark, d, 0.02), ["frame"], YX)


NODES = "WITH RECURSIVE n AS (SELECT frame, y, x, frame * 64 + y * 8 + x AS id FROM mask), e AS (SELECT a.id AS src, b.id AS dst FROM n a JOIN n b ON a.frame = b.frame AND {near}) "


def _nodes(spark, d):
    return mask(spark, d).withColumn("id", F.col("frame") * 64 + F.col("y") * 8 + F.col("x"))


@query(NODES.format(near="abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND a.id <> b.id") + ", r(id, root) AS (SELECT id, id FROM n UNION SELECT e.dst, r.root FROM r JOIN e ON e.src = r.id WHERE r.root < e.dst) SELECT id, min(root) AS root FROM r GROUP BY id")
def vol8_components(spark, d):
    n = _nodes(spark, d)
    return vol.components(n.select("id"), vol.neighbour_edges(n, ["frame"], YX, "id"))


@query(NODES.format(near="abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND a.id <> b.id") + ", r(id, root) AS (SELECT id, id FROM n UNION SELECT e.dst, r.root FROM r JOIN e ON e.src = r.id WHERE r.root < e.dst), c AS (SELECT id, min(root) AS root FROM r GROUP BY id) SELECT id, root FROM c WHERE root IN (SELECT root FROM c GROUP BY root HAVING count(*) >= 3)")
def vol1_large_components(spark, d):
    n = _nodes(spark, d)
    c = vol.components(n.select("id"), vol.neighbour_edges(n, ["frame"], YX, "id"))
    return c.join(c.groupBy("root").agg(F.count("*").alias("size")).where("size >= 3"), "root", "left_semi").select("id", "root")


@query(NODES.format(near="abs(a.y - b.y) + abs(a.x - b.x) = 1") + ", r(id, dist) AS (SELECT id, 0 FROM n WHERE x = 0 UNION SELECT e.dst, r.dist + 1 FROM r JOIN e ON e.src = r.id WHERE r.dist < 64) SELECT id, CAST(min(dist) AS DOUBLE) AS dist FROM r GROUP BY id")
def vol6_geodesic(spark, d):
    n = _nodes(spark, d)
    e = vol.neighbour_edges(n, ["frame"], YX, "id", faces=True).withColumn("w", F.lit(1.0))
    return vol.shortest_paths(e, n.where("x = 0").select("id"))


@query("""
WITH p AS (SELECT a.y, a.x, corr(a.v, b.v) AS r FROM voxels a JOIN voxels b ON a.frame = b.frame AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY a.y, a.x, b.y, b.x)
SELECT y, x, round(greatest(0.0, max(r)), 6) AS r FROM p GROUP BY ALL
""")
def vol2_neighbour_correlation(spark, d):
    return vol.neighbour_correlation(voxels(spark, d), "frame", YX, "v").select(*YX, F.round("r", 6).alias("r"))


@query("""
WITH t AS (SELECT y, x FROM voxels GROUP BY ALL HAVING avg(v) > 0.005), g AS (SELECT DISTINCT y, x FROM voxels)
SELECT g.y, g.x, round(min(sqrt((g.y - t.y) * (g.y - t.y) + 4 * (g.x - t.x) * (g.x - t.x))), 6) AS dist FROM g LEFT JOIN t ON abs(g.y - t.y) <= 2 AND abs(g.x - t.x) <= 2 GROUP BY ALL
""")
def vol5_distance(spark, d):
    g = voxels(spark, d).groupBy(*YX).agg(F.avg("v").alias("m"))
    targets = g.where("m > 0.005")
    return vol.nearest_set_distance(g, targets, YX, [1.0, 2.0], 2).select(*YX, F.round("dist", 6).alias("dist"))


@query("""
WITH c AS (SELECT *, x // 4 AS chunk FROM voxels), q AS (SELECT frame, chunk, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM c GROUP BY ALL)
SELECT frame, y, x, round(least(1.0, greatest(0.0, (v - lo) / nullif(hi - lo, 0))), 6) AS v FROM c JOIN q USING (frame, chunk)
""")
def vol16_chunk_scale(spark, d):
    c = voxels(spark, d).withColumn("chunk", F.floor(F.col("x") / 4))
    q = c.groupBy("frame", "chunk").agg(F.percentile("v", 0.02).alias("lo"), F.percentile("v", 0.98).alias("hi"))
    scaled = (F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    return c.join(q, ["frame", "chunk"]).select("frame", *YX, F.round(F.when(scaled.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled))).otherwise(0.0), 6).alias("v"))


@query("SELECT frame, x, round(max(v), 6) AS v, arg_max(y, struct_pack(v := v, y := -y)) AS at FROM voxels GROUP BY ALL")
def vol21_projection(spark, d):
    return voxels(spark, d).groupBy("frame", "x").agg(F.round(F.max("v"), 6).alias("v"), F.max_by("y", F.struct("v", -F.col("y"))).alias("at"))


@query()
def vol9_path(spark, d):
    return vol.dp_path(voxels(spark, d).withColumn("cost", -F.col("v")), ["frame"], "x", "y", "cost").withColumn("total", F.round("total", 6))


@query("SELECT vec_id, label, dense_rank() OVER (ORDER BY label) AS new_label FROM embeddings WHERE label > 2 UNION ALL SELECT vec_id, label, 0 FROM embeddings WHERE label <= 2")
def x20_relabel(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "label", F.when(F.col("label") > 2, F.col("label")).otherwise(0).alias("kept"))
    return vol.relabel(e, "kept", []).select("vec_id", "label", F.col("new_label").cast("long").alias("new_label"))


@query("WITH l AS (SELECT frame, y, x, 1 AS ord, 5 AS label FROM mask UNION ALL SELECT frame, y, x, 2, 9 FROM mask WHERE x < 4) SELECT frame, y, x, arg_max(label, ord) AS label FROM l GROUP BY ALL")
def vol13_overlay(spark, d):
    m = mask(spark, d)
    layer = lambda df, o, v: df.select("frame", *YX, F.lit(o).alias("ord"), F.lit(v).alias("label"))
    return vol.overlay(layer(m, 1, 5).unionByName(layer(m.where("x < 4"), 2, 9)), ["frame", *YX], "ord", "label")


@query("SELECT region, b, round(avg(f), 6) AS f, count(*) AS n FROM (SELECT region, t // 40 AS b, f FROM panel) GROUP BY ALL HAVING count(*) >= 3")
def x30_binned_trajectory(spark, d):
    p = panel(spark, d).groupBy("region", F.floor(F.col("t") / 40).alias("b")).agg(F.round(F.avg("f"), 6).alias("f"), F.count("*").alias("n"))
    return p.where("n >= 3")


@query("SELECT o_custkey AS session, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def x12_shared_sessions(spark, d):
    return read(spark, d, "orders").groupBy(F.col("o_custkey").alias("session")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_hourly_counts(spark, d):
    return windows.hourly_counts(spark, f"{d}/events.parque[t]")  # a pattern, as streams take no single file


@query("""
WITH w AS (SELECT *, unnest([0, 1, 2, 3]) AS k, to_timestamp(epoch(date_trunc('hour', ts)) + CASE WHEN minute(ts) >= 30 THEN 1800 ELSE 0 END)::TIMESTAMP AS latest FROM events)
SELECT latest - to_minutes(30 * k) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM w GROUP BY ALL
""")
def stream_sliding_counts(spark, d):
    return windows.sliding_counts(spark, f"{d}/events.parque[t]")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k
""")
def stream_sessions(spark, d):
    return windows.user_sessions(spark, f"{d}/events.parque[t]", "6 hours")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_x, round(avg(user_id), 6) AS mean_y, round(var_pop(value), 5) AS var_x, round(var_pop(user_id), 4) AS var_y, round(covar_pop(value, user_id), 4) AS cov_xy FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL GROUP BY event_type")
def stream_moments(spark, d):
    out = stateful.running_moments(windows.event_stream(spark, f"{d}/events.parque[t]"), "event_type", "value", "user_id", 40 * 86_400_000, "31 days")
    last = windows.drain(out, "update", ["event_type"], {stateful.PROVIDER: stateful.ROCKS})
    return last.select("event_type", "n", *r6("mean_x", "mean_y"), F.round("var_x", 5).alias("var_x"), F.round("var_y", 4).alias("var_y"), F.round("cov_xy", 4).alias("cov_xy"))
