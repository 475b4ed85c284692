"""Queries on recording sessions: orders as units, customers as run folders, events as arrays."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.operators import relational as rel
from lamina.plans.fixtures import points, query, r6, read, voxels
from lamina.sources import sessions

METHODS = ["snakeScan", "transverseRibbonScan", "multiROILongitudinalRibbonScan", "zStack", "", "timeSeries"]


@query("""
WITH c AS (SELECT l_orderkey AS k, l_returnflag AS channel, count(*) * 12 AS frames FROM lineitem GROUP BY ALL)
, u AS (SELECT o_orderkey AS k, (['snakeScan', 'transverseRibbonScan', 'multiROILongitudinalRibbonScan', 'zStack', '', 'timeSeries'])[1 + o_orderkey % 6] AS method, o_custkey, o_orderstatus, o_orderpriority, o_totalprice AS price, o_orderdate, nullif(1 + o_orderkey % 5, 3) AS slices, 16.0e0 * (o_orderkey % 7) AS step, o_orderkey % 4 = 1 AS ribbon FROM orders)
, n AS (SELECT *, contains(method, 'zStack') AS stack, CASE WHEN contains(method, 'zStack') THEN frames WHEN slices IS NOT NULL THEN slices ELSE 1 END AS n_z, CASE WHEN contains(method, 'zStack') THEN 1 WHEN slices IS NOT NULL AND frames % slices = 0 THEN frames // slices ELSE frames END AS n_t FROM u JOIN c USING (k))
, t AS (SELECT *, CASE WHEN method = 'snakeScan' THEN 'snake' WHEN method = 'transverseRibbonScan' THEN 'ribbon_transverse' WHEN method = 'multiROILongitudinalRibbonScan' THEN 'ribbon_longitudinal' WHEN stack THEN 'zstack' WHEN o_orderstatus = 'F' THEN 'camera_series' ELSE coalesce(nullif(method, ''), 'timeseries') END AS scan_type, 1000 / nullif(step, 0) AS rate FROM n)
SELECT 'f' || o_custkey AS file, 's' || k % 3 AS session, CAST(k AS VARCHAR) AS unit, channel, scan_type, coalesce(nullif(method, ''), CASE WHEN k % 4 = 0 THEN o_orderpriority END, CASE WHEN o_orderstatus = 'F' THEN 'Camera' ELSE 'Resonant' END) AS type, o_orderpriority AS comment,
  CASE WHEN k % 11 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' UTC' END AS timestamp, round(floor(price) * 20 / 1000, 2) AS duration_s, round(CASE WHEN NOT stack THEN n_t * nullif(step, 0) / 1000 END, 2) AS duration_calc_s,
  round(rate, 3) AS frame_rate_hz, round(CASE WHEN scan_type = 'snake' THEN rate END, 3) AS volume_rate_hz, round(CASE WHEN scan_type = 'snake' AND n_z > 1 THEN rate * n_z END, 2) AS slice_rate_hz, step AS t_step_ms,
  CASE WHEN scan_type = 'snake' THEN n_z END AS snake_n_slices, CASE WHEN stack THEN n_z END AS zstack_n_planes, CASE WHEN k % 5 <> 0 THEN CAST(k % 5 AS DOUBLE) END AS pixel_average, k % 8 AS display_average, CASE WHEN k % 3 = 0 THEN 2 END AS frame_loop, CASE WHEN k % 2 = 0 THEN 'Piezo' END AS z_mode,
  CASE WHEN k % 9 > 0 THEN (k % 9) * 0.125e0 END AS pixel_dwell_us, floor(price) AS pixel_clock_hz, n_t, n_z, 8 AS n_y, 16 AS n_x, CASE WHEN ribbon THEN 0.75e0 ELSE 0.25e0 * (1 + k % 3) END AS pixel_x_um, CASE WHEN ribbon THEN 0.5e0 ELSE 1.5e0 END AS pixel_y_um, CASE WHEN NOT ribbon THEN 2.0e0 END AS voxel_z_um, CASE WHEN ribbon THEN 40.0e0 END AS z_extent_um, CASE WHEN NOT ribbon THEN 12.5e0 END AS transverse_um,
  -1.0e0 * (k % 40) AS min_z_um, 8.0e0 * (k % 30) AS max_z_um, round(CASE WHEN n_z > 1 THEN (8.0e0 * (k % 30) + k % 40) / (n_z - 1) END, 4) AS z_step_um, CASE WHEN k % 13 > 0 THEN (k % 100) * 0.5e0 END AS stage_x_um, CAST(NULL AS DOUBLE) AS stage_y_um, CASE WHEN k % 13 > 0 THEN 7.5e0 END AS stage_z_um,
  CASE WHEN k % 13 > 0 THEN 920.0e0 END AS "wavelength_LP1", CASE WHEN k % 13 > 0 THEN CAST(k % 60 AS DOUBLE) END AS "power_LP1", CAST(NULL AS DOUBLE) AS "wavelength_LP2", CAST(NULL AS DOUBLE) AS "power_LP2", CASE WHEN k % 13 > 0 THEN 80.0e0 END AS "UG", CAST(NULL AS DOUBLE) AS "UR", CAST(NULL AS DOUBLE) AS "AO", CAST(NULL AS DOUBLE) AS "GDD2", CASE WHEN k % 2 = 1 THEN '16x' END AS objective, 'v' || k % 4 AS software
FROM t
""")
def src4_unit_channels(spark, d):
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    step = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("double").alias("position"))
    plain = F.struct((0.25 * (1 + k % 3)).alias("pixelSizeL"), F.lit(1.5).alias("pixelSizeT"), F.lit(2.0).alias("voxelSizeZ"), F.lit(None).cast("double").alias("zSize"), F.lit(12.5).alias("transverseSize"), F.lit(None).cast("double").alias("pixelSizeX"), F.lit(None).cast("double").alias("pixelSizeY"))
    none = [F.lit(None).cast("double").alias(c) for c in ("pixelSizeL", "pixelSizeT", "voxelSizeZ")]
    ribbon = F.struct(*none, F.lit(40.0).alias("zSize"), F.lit(None).cast("double").alias("transverseSize"), F.lit(0.75).alias("pixelSizeX"), F.lit(0.5).alias("pixelSizeY"))
    doc = lambda *c: F.to_json(F.struct(*c))
    attributes = {
        "MethodTypeDebugString": F.get(F.array(*map(F.lit, METHODS)), (k % 6).cast("int")), "SectionTypeDebugString": F.when(k % 4 == 0, F.col("o_orderpriority")).otherwise(""),
        "TechnologyTypeDebugString": F.when(F.col("o_orderstatus") == "F", "Camera").otherwise("Resonant"),
        "MeasurementDatePosix": F.when(k % 11 != 0, F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)")), "MeasurementLengthInMs": F.floor(price) * 20,
        "Comment": F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" ")), "TStepInMs": 16.0 * (k % 7), "Slices": F.nullif(1 + k % 5, F.lit(3)), "MinZ": -1.0 * (k % 40), "MaxZ": 8.0 * (k % 30),
        "DwellTime": (k % 9) * 0.000125, "Pixelclock": F.floor(price).cast("double"), "DisplayAverage": (k % 8).cast("double"), "FrameLoop": F.when(k % 3 == 0, 2), "ZModeDebugString": F.when(k % 2 == 0, "Piezo"),
        "VersionInfoJSON": doc(F.concat(F.lit("v"), (k % 4).cast("string")).alias("mesVersion")), "AOSettingsJSON": F.when(k % 5 == 0, "{broken").otherwise(doc((k % 5).alias("pixelAverage"))),
        "DeviceJSON": F.when(k % 13 != 0, doc(F.array(step("FemtoStageX", (k % 100) * 0.5), step("ObjectiveArm", F.lit(7.5)), step("wavelength_LP1", F.lit(920)), step("power_LP1", k % 60), step("UG", F.lit(80))).alias("devices"))),
        "ModalityJSON": doc(F.array(F.struct(F.when(k % 2 == 1, "Objective").otherwise("Filter").alias("name"), F.lit("16x").alias("currentState"))).alias("modalities")),
        "MultiROIProtocolJSON": doc(F.struct(F.array(plain, ribbon).alias("patterns")).alias("scanPatterns"), F.struct(F.when(k % 4 != 3, k % 4).otherwise(-1).alias("mainPatternIndex")).alias("protocol")),
    }
    shape = F.array((F.col("n") * 12).cast("int"), F.lit(8), F.lit(16))
    # Dealt by number: the texts are made and read behind this shuffle of narrow rows, whose bytes would merge it into a few tasks.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    flags = read(spark, d, "lineitem").select("l_orderkey", "l_returnflag").repartition(parts, "l_orderkey")
    channels = flags.groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n")).groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("name"), shape.alias("shape"))).alias("channels"))
    units = read(spark, d, "orders").repartition(parts, "o_orderkey").join(channels, F.col("l_orderkey") == k).select(F.concat(F.lit("f"), "o_custkey").alias("file"), F.concat(F.lit("s"), k % 3).alias("session"), k.cast("string").alias("unit"), doc(*[v.alias(n) for n, v in attributes.items()]).alias("attributes"), "channels")
    return sessions.unit_channels(units)


@query("""
WITH s AS (SELECT user_id, event_id % 3 AS tab, event_type AS own, value AS v, row_number() OVER (PARTITION BY user_id, event_id % 3, event_type ORDER BY event_id) AS i FROM events)
, c AS (SELECT DISTINCT user_id, tab, own, dense_rank() OVER (PARTITION BY user_id, tab ORDER BY own) - 1 AS col FROM s)
, r AS (SELECT *, min(v) OVER g AS lo, max(v) OVER g AS hi FROM s WINDOW g AS (PARTITION BY user_id, tab, own))
, b AS (SELECT *, hi - lo >= 1e-9 AND v > lo + 0.5 * (hi - lo) AS up FROM r), l AS (SELECT *, up AND NOT lag(up) OVER (PARTITION BY user_id, tab, own ORDER BY i) AS step FROM b)
, e AS (SELECT user_id, tab, own, count(*) AS size, count(*) FILTER (step) AS edges FROM l GROUP BY ALL)
, w AS (SELECT *, count(*) OVER (PARTITION BY user_id, tab) AS w FROM e JOIN c USING (user_id, tab, own))
, n AS (SELECT *, coalesce(CASE WHEN w = 3 THEN ['d0', 'd1', 'd2'][CAST(col AS INT) + 1] WHEN w = 2 THEN ['a0', 'a1'][CAST(col AS INT) + 1] END, CASE WHEN own <> 'error' THEN own END, tab || '_var' || col) AS channel FROM w WHERE size > 1)
SELECT user_id, channel, size, edges FROM (SELECT *, row_number() OVER (PARTITION BY user_id, channel ORDER BY size DESC, tab, col) AS j FROM n) WHERE j = 1
""")
def src11_trigger_edges(spark, d):
    key = ["user_id", "tab", "kind"]
    e = read(spark, d, "events").select("user_id", (F.col("event_id") % 3).alias("tab"), F.col("event_type").alias("kind"), "event_id", "value")
    e = e.withColumn("i", F.row_number().over(Window.partitionBy(*key).orderBy("event_id")) - 1)
    cols = e.select(*key).distinct().withColumn("col", F.row_number().over(Window.partitionBy("user_id", "tab").orderBy("kind")) - 1)
    s = e.join(cols, key).withColumn("own", F.when(F.col("kind") != "error", F.col("kind")).otherwise(""))
    return sessions.trigger_channels(s, "user_id", "tab", "col", "own", "i", "value", [["d0", "d1", "d2"], ["a0", "a1"]])


@query("""
WITH h AS (SELECT event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, value AS pupil, value - 250 AS whisker FROM events)
, n AS (SELECT run, count(*) AS n FROM h GROUP BY run), k AS (SELECT unnest(range(-12, 13)) AS k)
, a AS (SELECT h.run, h.i, k, CASE WHEN h.i + k < 0 THEN -1 - h.i - k WHEN h.i + k >= n THEN 2 * n - 1 - h.i - k ELSE h.i + k END AS j FROM h JOIN n USING (run), k)
, g AS (SELECT a.run, a.i, sum(CASE WHEN abs(k) <= 8 THEN exp(-k * k / 8.0) * h.pupil END) / sum(CASE WHEN abs(k) <= 8 THEN exp(-k * k / 8.0) END) AS pupil, sum(exp(-k * k / 18.0) * h.whisker) / sum(exp(-k * k / 18.0)) AS whisker FROM a JOIN h ON h.run = a.run AND h.i = a.j GROUP BY ALL)
, t AS (SELECT *, i / 20e0 AS t, CASE run WHEN 'click' THEN 0.6e0 WHEN 'error' THEN 1.3e0 ELSE 0e0 END AS s FROM g)
, m AS (SELECT run, coalesce(max(pupil) FILTER (t >= s AND t < s + 2), max(pupil)) AS p, coalesce(max(abs(whisker)) FILTER (t >= s AND t < s + 2), max(abs(whisker))) AS w FROM t GROUP BY run)
SELECT run, round(t - s - 2, 6) AS time, round(pupil / (p + 1e-6), 6) AS pupil, round(whisker / (w + 1e-6), 6) AS whisker FROM t JOIN m USING (run) WHERE t >= s + 2
""")
def src12_behaviour(spark, d):
    e = read(spark, d, "events").select(F.col("event_type").alias("run"), "event_id", F.col("value").alias("pupil"), (F.col("value") - 250).alias("whisker"))
    s = e.withColumn("i", F.row_number().over(Window.partitionBy("run").orderBy("event_id")) - 1).drop("event_id")
    first = e.select("run").distinct().where("run in ('click', 'error')").withColumn("aligned_time_s", F.when(F.col("run") == "click", -0.6).otherwise(-1.3))
    return sessions.behaviour(s, first, ["run"], "i", {"pupil": 2.0, "whisker": 3.0}, ["whisker"], 20.0, 2.0).select("run", *r6("time", "pupil", "whisker"))


@query("SELECT l_orderkey, l_linenumber, 'm' || l_suppkey AS mouse, strftime(l_shipdate, '%m-%d-%Y') AS date, l_partkey AS number, CASE WHEN l_partkey % 2 = 0 THEN 'run' || l_partkey ELSE 'munit' || l_partkey END AS folder FROM lineitem WHERE l_linenumber <> 3 AND l_shipdate IS NOT NULL")
def src19_run_identity(spark, d):
    kind = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("munit7/run"), "l_partkey")).otherwise(F.concat(F.lit("munit"), "l_partkey"))
    path = F.concat(F.lit("/data/m"), "l_suppkey", F.lit("/"), F.when(F.col("l_linenumber") != 3, F.date_format("l_shipdate", "MM-dd-yyyy")).otherwise("undated"), F.lit("/preprocessed/"), kind, F.lit("/a_4d.tif"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", sessions.run_identity(path).alias("id")).where("id is not null").select("l_orderkey", "l_linenumber", "id.*")


NAMES = ["_clean.tif", "3d.tif", "", "", "", ".tif", "branch.csv"]


@query("""
WITH f AS (SELECT c_custkey AS k, 'm' || c_nationkey || '/c' || c_custkey || '/run' || c_custkey % 12 AS folder, 'run' || c_custkey % 12 AS own, CASE WHEN c_custkey % 9 > 0 THEN c_custkey % 7 END AS number FROM customer)
, g AS (SELECT *, 'run' || lpad(CAST(number AS VARCHAR), 2, '0') AS stem, CAST(k % 12 AS VARCHAR) AS dig FROM f)
, n AS (SELECT DISTINCT o_custkey AS k, o_orderkey % 7 AS c FROM orders), b AS (SELECT g.*, c, CASE c WHEN 0 THEN own || '_clean' WHEN 1 THEN own || '3d' WHEN 2 THEN '3dstack' WHEN 3 THEN 'munit_' || dig || '_mask' WHEN 4 THEN 'rb_Run12_x_4D' WHEN 5 THEN own ELSE own || 'branch' END AS base, CASE WHEN c IN (2, 6) THEN '.csv' ELSE '.tif' END AS ext FROM n JOIN g USING (k) WHERE number IS NOT NULL)
, t AS (SELECT *, list_sort(list_filter([own, own || '3d', '3dstack', 'munit' || dig, 'munit_' || dig, 'rb_Run12_x_4D'], lambda s: starts_with(base, s)), 'DESC')[1] AS tok FROM b), m AS (SELECT *, stem || substr(base, len(tok) + 1) AS fresh FROM t)
, r AS (SELECT *, CASE WHEN fresh = stem AND ext = '.tif' THEN stem || '_4d' ELSE regexp_replace(fresh, '^(run\\d{2})3d$', '\\1_4d') END AS dst FROM m WHERE fresh <> base)
SELECT 'file' AS kind, folder || '/' || base || ext AS src, folder || '/' || dst || ext AS dst FROM r
UNION ALL SELECT CASE WHEN number IS NULL THEN 'skip' ELSE 'dir' END, folder, CASE WHEN number IS NOT NULL THEN 'm' || split_part(folder, '/run', 1)[2:] || '/' || stem END FROM g WHERE number IS NULL OR own <> stem
""")
def src19_rename_plan(spark, d):
    k = F.col("c_custkey")
    f = read(spark, d, "customer").select(k, F.concat(F.lit("m"), "c_nationkey", F.lit("/c"), k, F.lit("/run"), k % 12).alias("folder"), F.when(k % 9 > 0, k % 7).alias("number"))
    own, c = F.concat(F.lit("run"), k % 12), F.col("o_orderkey") % 7
    name = F.when(c == 2, "3dstack.csv").when(c == 3, F.concat(F.lit("munit_"), k % 12, F.lit("_mask.tif"))).when(c == 4, "rb_Run12_x_4D.tif").otherwise(F.concat(own, F.get(F.array(*map(F.lit, NAMES)), c.cast("int"))))
    files = read(spark, d, "orders").join(f, F.col("o_custkey") == k).select("folder", name.alias("name"))
    return sessions.rename_plan(f.select("folder", "number"), files)


@query("""
WITH g AS (SELECT o_custkey AS cell, count(*) AS n_reviews, bool_or(o_orderstatus = 'F') AND NOT bool_or(o_orderstatus = 'P') AS by_hand, arg_max(o_orderstatus, o_orderkey) = 'F' AS last, bool_or(o_orderpriority = '1-URGENT') AND bool_or(o_orderpriority = '2-HIGH') AS whole FROM orders GROUP BY ALL)
SELECT cell, n_reviews, 'ever' AS rule FROM g WHERE by_hand AND whole UNION ALL SELECT cell, n_reviews, 'last' FROM g WHERE last AND whole
""")
def src20_hand_masks(spark, d):
    o = read(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("stem"), "o_custkey", "o_orderkey", "o_orderstatus", F.when(F.col("o_orderpriority") == "1-URGENT", "_ref3d.tif").when(F.col("o_orderpriority") == "2-HIGH", ".tif").alias("s"))
    paths = o.where("s is not null").select(F.concat("stem", "s").alias("path"))
    found = lambda last: sessions.hand_masks(o, paths, "stem", ["o_orderkey"], "o_orderstatus", "F", "P", [".tif", "_ref3d.tif"], last).withColumn("rule", F.lit("last" if last else "ever"))
    return found(False).unionByName(found(True)).select(F.substring("stem", 2, 20).cast("long").alias("cell"), "n_reviews", "rule")


@query("""
WITH p AS (SELECT label, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.999) AS hi FROM voxels GROUP BY label)
SELECT frame, y, x, round(greatest(0, least(1, (v - lo) / (hi - lo + 1e-9))), 6) AS v FROM voxels JOIN p USING (label)
""")
def src20_reference_channel(spark, d):
    return sessions.reference_channel(voxels(spark, d), ["label"], "v").select("frame", "y", "x", *r6("v"))


@query("""
SELECT user_id, CASE WHEN list_contains(l, 'purchase') THEN 'purchase' WHEN list_contains(l, 'signup') THEN 'signup' ELSE coalesce(l[2], l[1]) END AS channel
FROM (SELECT user_id, list(DISTINCT event_type ORDER BY event_type) AS l FROM events WHERE event_id % 5 < 2 GROUP BY user_id)
""")
def src20_pick_channel(spark, d):
    x = read(spark, d, "events").where("event_id % 5 < 2").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("l"))
    return x.select("user_id", sessions.pick_channel(F.col("l"), "purchase", "signup").alias("channel"))


@query("""
WITH c AS (SELECT y, x, frame // 32 AS chunk, quantile_cont(v, 0.995) AS p, sum(v) AS s, count(*) AS n FROM voxels GROUP BY ALL)
SELECT y, x, round(max(p), 6) AS peak, round(sum(s) / sum(n), 6) AS mean FROM c GROUP BY ALL
""")
def src17_chunk_peak(spark, d):
    return sessions.chunk_peak(voxels(spark, d), ["y", "x"], "frame", "v", 32).select("y", "x", *r6("peak", "mean"))


@query("""
WITH RECURSIVE a AS (SELECT user_id, s AS x, max(value) AS took FROM points WHERE region = 'purchase' GROUP BY ALL), b AS (SELECT user_id, s AS y, nullif(max(value) + 40, 0) AS record FROM points WHERE region = 'view' AND event_id % 6 <> 0 GROUP BY ALL UNION ALL SELECT user_id, s, NULL FROM points q WHERE region = 'view' AND event_id % 6 = 0 AND NOT EXISTS (SELECT 1 FROM points r WHERE r.region = 'view' AND r.event_id % 6 <> 0 AND r.user_id = q.user_id AND r.s = q.s) GROUP BY ALL)
, c AS (SELECT a.user_id, y, list(x ORDER BY x DESC) AS xs, row_number() OVER (PARTITION BY a.user_id ORDER BY y) AS i FROM a JOIN b ON a.user_id = b.user_id AND y - x BETWEEN 0 AND 864000 AND coalesce(record - took BETWEEN 0 AND 300, true) GROUP BY a.user_id, y)
, s AS (
    SELECT user_id, i, y, xs[1] AS x, xs[1:1] AS taken FROM c WHERE i = 1
    UNION ALL
    SELECT user_id, i, y, free, CASE WHEN free IS NULL THEN taken ELSE list_append(taken, free) END
    FROM (SELECT c.user_id, c.i, c.y, s.taken, list_filter(c.xs, lambda v: NOT list_contains(s.taken, v))[1] AS free FROM s JOIN c ON c.user_id = s.user_id AND c.i = s.i + 1)
) SELECT user_id, x, y FROM s WHERE x IS NOT NULL
""")
def join4_record_pad(spark, d):
    p = points(spark, d)
    a = p.where("region = 'purchase'").groupBy("user_id", F.col("s").alias("x")).agg(F.max("value").alias("took"))
    b = p.where("region = 'view'").groupBy("user_id", F.col("s").alias("y")).agg((F.max(F.when(F.col("event_id") % 6 != 0, F.col("value"))) + 40).alias("record"))
    return rel.greedy_pairs(a, b, ["user_id"], "x", "y", 0, 864000, (F.col("record") - F.col("took")).between(0, 300))
