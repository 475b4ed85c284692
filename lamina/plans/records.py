"""Queries on records: projections, rules, sources, sets and aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.functions import columns as fc
from lamina.operators import catalog, series, stats
from lamina.operators.ranking import place
from lamina.plans.fixtures import panel, query, r6, read, runs
from lamina.sources import readers


def _like(words, col="c"):
    return " + ".join(f"(CASE WHEN contains({col}, '{w}') THEN 1 ELSE 0 END)" for w in words)


def _any(words, col="c"):
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


_NOTES = ", ".join(
    [f"CASE WHEN contains(c, '{w}') THEN '+{w}' END" for w in fc.STRONG_POSITIVE] + ["'+' || plain", "'?' || weak"]
    + [f"CASE WHEN contains(c, '{w}') THEN '-{w}' END" for w in fc.STRONG_NEGATIVE] + [f"CASE WHEN contains(c, '{w}') THEN '~{w}' END" for w in fc.MILD_NEGATIVE] + ["CASE WHEN hedged THEN '?hedged' END"]
)
GRADED = f"""
WITH b AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS c FROM conversations)
, e AS (SELECT *, {_any(fc.STRONG_POSITIVE)} AS strong, {_any(fc.HEDGES)} AS hedged, {_like(fc.STRONG_NEGATIVE)} AS ns, {_like(fc.MILD_NEGATIVE)} AS nm,
  CASE WHEN contains(c, 'maybe') THEN 'maybe' WHEN contains(c, 'might be useful') THEN 'might be useful' WHEN contains(c, 'first time') THEN 'first time' END AS weak,
  CASE WHEN {_any(fc.STRONG_POSITIVE)} THEN NULL WHEN regexp_matches(c, '\\bgood') THEN 'good' WHEN regexp_matches(c, '\\bok') THEN 'ok' END AS plain FROM b)
, s AS (SELECT *, CASE WHEN strong THEN 3 ELSE 0 END + CASE WHEN plain IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN weak IS NOT NULL THEN 1 ELSE 0 END - 3 * ns - nm AS score FROM e)
, g AS (SELECT conv_id, turn, CASE WHEN c = '' THEN 'unknown' WHEN ns > 0 THEN 'bad' WHEN score >= 2 AND nm = 0 AND NOT hedged THEN 'good' WHEN score >= 1 THEN 'ok' WHEN score <= -1 THEN 'caution' ELSE 'unknown' END AS quality,
  CAST(CASE WHEN c = '' THEN 0 ELSE score END AS INT) AS score, CASE WHEN c = '' THEN '' ELSE array_to_string(list_filter([{_NOTES}], lambda x: x IS NOT NULL), ';') END AS notes FROM s)
"""


@query(GRADED + "SELECT * FROM g")
def prj2_comment_quality(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", fc.comment_grade(F.col("text")).alias("g")).select("conv_id", "turn", "g.*")


@query("SELECT doc_id, TRY_CAST(nullif(regexp_extract(lower(text), '\\brun\\s*#?\\s*(\\d{1,2})\\b', 1), '') AS INT) AS run FROM (SELECT doc_id, text || ' Run #' || CAST(doc_id % 120 AS VARCHAR) AS text FROM documents)")
def prj3_run_number(spark, d):
    return read(spark, d, "documents").select("doc_id", fc.run_number(F.concat("text", F.lit(" Run #"), (F.col("doc_id") % 120).cast("string"))).alias("run"))


@query("""
WITH r AS (SELECT o_orderkey AS k, o_orderkey % 11 <> 0 AS present, o_orderkey % 7 <> 0 AS paired, o_orderkey % 13 <> 0 AS unit, (['good', 'ok', 'caution', 'unknown', 'bad'])[1 + o_orderkey % 5] AS quality,
 (['fingerprint_exact', 'fingerprint+order', 'duration_order_fallback', 'fingerprint+comment_run'])[1 + o_orderkey % 4] AS conf, o_totalprice / 50000 AS loss, o_orderkey % 17 = 0 AS conflict FROM orders)
, p AS (SELECT *, list_distinct(list_filter([CASE WHEN conf = 'fingerprint+order' THEN 'match by order inside a same-fingerprint group' WHEN conf = 'duration_order_fallback' THEN 'no trigger-count match; paired by duration+order' END,
 CASE WHEN conflict THEN 'comment run number disagrees with the pairing' END, CASE WHEN loss >= 5 THEN 'large behavior frame loss' END, CASE WHEN quality = 'caution' THEN 'comment caveat' END], lambda x: x IS NOT NULL)) AS pr FROM r)
SELECT k, CASE WHEN NOT present OR NOT paired OR NOT unit THEN 'P4' WHEN quality = 'bad' THEN 'P4' WHEN len(pr) = 0 AND quality IN ('good', 'ok') THEN 'P1' WHEN len(pr) = 0 THEN 'P2' WHEN quality = 'good' AND len(pr) = 1 THEN 'P2' WHEN len(pr) = 1 AND conf IN ('fingerprint_exact', 'fingerprint+comment_run') THEN 'P2' ELSE 'P3' END AS priority FROM p
""")
def prj4_priority(spark, d):
    k = F.col("o_orderkey")
    pick = lambda xs, n: F.get(F.array(*[F.lit(x) for x in xs]), (k % n).cast("int"))
    none = F.lit(None)
    p = fc.priority(k % 11 != 0, k % 7 != 0, k % 13 != 0, pick(["good", "ok", "caution", "unknown", "bad"], 5), none.cast("string"), pick(["fingerprint_exact", "fingerprint+order", "duration_order_fallback", "fingerprint+comment_run"], 4), k % 17 == 0, F.lit(0), F.col("o_totalprice") / 50000, F.lit(0.0), none.cast("string"))
    return read(spark, d, "orders").select(k.alias("k"), p["priority"].alias("priority"))


@query("""
WITH s AS (SELECT l.doc_id, coalesce(toxic, 0) = 1 AS marked, CASE WHEN quality = 1 THEN 2.0 ELSE 0.0 END + CASE WHEN n_chars >= 3000 THEN 1.0 WHEN n_chars >= 1000 THEN 0.5 ELSE 0.0 END AS score FROM labels l JOIN documents USING (doc_id))
SELECT doc_id, CAST(score AS DOUBLE) AS score, CASE WHEN marked THEN 'P5' WHEN score >= 4 THEN 'P1' WHEN score >= 2.5 THEN 'P2' WHEN score >= 1 THEN 'P3' ELSE 'P4' END AS priority, row_number() OVER (ORDER BY marked, score DESC, doc_id) AS place FROM s
""")
def prj5_record_score(spark, d):
    x = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    s = F.when(F.col("quality") == 1, 2.0).otherwise(0.0) + F.when(F.col("n_chars") >= 3000, 1.0).when(F.col("n_chars") >= 1000, 0.5).otherwise(0.0)
    x = x.select("doc_id", s.alias("score"), (F.coalesce("toxic", F.lit(0)) == 1).alias("marked"))
    p = F.when(F.col("marked"), "P5").when(F.col("score") >= 4, "P1").when(F.col("score") >= 2.5, "P2").when(F.col("score") >= 1, "P3").otherwise("P4")
    return place(x.withColumn("priority", p), "marked", F.desc("score"), "doc_id").drop("marked")


@query("SELECT user_id, " + "(['" + "','".join(fc.STAGES) + "'])[1 + greatest(0, CASE WHEN bool_or(event_type = 'view') THEN 1 ELSE 0 END, CASE WHEN bool_or(event_type = 'click') THEN 2 ELSE 0 END, CASE WHEN bool_or(event_type = 'signup') THEN 3 ELSE 0 END, CASE WHEN bool_or(value > 485) THEN 4 ELSE 0 END)] AS stage FROM events GROUP BY user_id")
def prj6_stage(spark, d):
    has = lambda t: F.bool_or(F.col("event_type") == t)
    x = read(spark, d, "events").groupBy("user_id").agg(has("view").alias("a"), has("click").alias("b"), has("signup").alias("c"), F.bool_or(F.col("value") > 485).alias("e"))
    return x.select("user_id", fc.furthest_stage(F.col("a"), F.col("b"), F.col("c"), F.col("e")).alias("stage"))


@query("SELECT user_id, arg_min(event_id, struct_pack(p := CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END, e := event_id)) AS event_id FROM events GROUP BY user_id")
def prj7_best_source(spark, d):
    p = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    return read(spark, d, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct(p, "event_id")).alias("event_id"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'of') AND lang = 'en'")
def prj8_grid_filter(spark, d):
    return read(spark, d, "documents").where(fc.all_words_in(F.lit("the of"), F.col("text")) & (F.col("lang") == "en")).select("doc_id")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 2, 3, 7, 32, 33, 34)")
def prj9_range_spec(spark, d):
    spec = spark.createDataFrame([("1-3, 7,32-34",)], "spec string").select(F.explode(fc.range_numbers(F.col("spec"))).alias("k")).select(F.col("k").cast("long").alias("o_orderkey"))
    return read(spark, d, "orders").join(F.broadcast(spec), "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT doc_id, CASE quality WHEN 1 THEN 'very_good' ELSE NULL END AS rating FROM labels")
def prj10_rating(spark, d):
    return read(spark, d, "labels").select("doc_id", fc.rating(F.when(F.col("quality") == 1, " VG ").otherwise("clear")).alias("rating"))


@query("SELECT o_orderkey, round(1000 / nullif(o_custkey % 7, 0), 6) AS rate, round(100 * (o_totalprice - 50000) / o_totalprice, 6) AS loss_pct FROM orders")
def prj13_units(spark, d):
    loss = 100 * fc.safe_div(F.col("o_totalprice") - 50000, F.col("o_totalprice"))
    return read(spark, d, "orders").select("o_orderkey", F.round(fc.safe_div(F.lit(1000), F.col("o_custkey") % 7), 6).alias("rate"), F.round(loss, 6).alias("loss_pct"))


@query("""
WITH b AS (SELECT o_orderkey, o_totalprice AS x, floor(log10(o_totalprice)) AS k FROM orders), m AS (SELECT *, x / pow(10.0, k) AS m FROM b)
SELECT o_orderkey, round(list_min(list_filter([1, 1.2, 1.5, 2, 2.5, 3, 4, 5, 6, 8, 10], lambda s: m <= s + 1e-9)) * pow(10.0, k), 6) AS lane FROM m
""")
def prj14_nice_numbers(spark, d):
    return read(spark, d, "orders").select("o_orderkey", fc.nice_ceil(F.col("o_totalprice")).alias("lane"))


@query("""
WITH l AS (SELECT s_suppkey, lower((['Branch', 'trunk', 'soma', 'dendrite', 'nexus', 'branch-far'])[1 + s_suppkey % 6] || CAST(s_suppkey AS VARCHAR)) AS n FROM supplier)
, g AS (SELECT *, CASE WHEN contains(n, 'dend') THEN 0 WHEN contains(n, 'branch') THEN 1 WHEN contains(n, 'nexus') THEN 2 WHEN contains(n, 'trunk') THEN 3 WHEN contains(n, 'soma') THEN 4 ELSE 2 END AS g FROM l)
SELECT s_suppkey, n AS name, row_number() OVER (ORDER BY g, CASE WHEN g = 1 THEN -CAST(regexp_extract(n, '(\\d+)', 1) AS INT) ELSE 0 END, CASE WHEN g = 1 AND contains(n, 'far') THEN -1 ELSE 0 END, n) AS place FROM g
""")
def prj15_anatomical_order(spark, d):
    name = F.concat(F.get(F.array(*[F.lit(x) for x in ("Branch", "trunk", "soma", "dendrite", "nexus", "branch-far")]), (F.col("s_suppkey") % 6).cast("int")), F.col("s_suppkey").cast("string"))
    x = read(spark, d, "supplier").select("s_suppkey", F.lower(name).alias("name"), fc.anatomy_key(name).alias("key"))
    return place(x, "key").drop("key")


@query("SELECT o_orderkey, CASE WHEN p <= 1.0 / 501 + 1e-15 THEN '< 1/501' ELSE printf('%.3e', p) END AS txt FROM (SELECT o_orderkey, (o_orderkey % 1000) / 1000.0 AS p FROM orders)")
def prj16_p_text(spark, d):
    return read(spark, d, "orders").select("o_orderkey", fc.p_text((F.col("o_orderkey") % 1000) / 1000.0, F.lit(500)).alias("txt"))


@query("""
WITH t AS (SELECT o_orderkey AS k, (o_orderkey % 100) / 100.0 AS q, o_totalprice - 100000 AS e, (['greater', 'less', 'two'])[1 + o_orderkey % 3] AS w FROM orders)
SELECT k, CASE WHEN w = 'two' THEN CASE WHEN q < 0.05 AND e > 0 THEN 'difference detected (higher)' WHEN q < 0.05 THEN 'difference detected (lower)' ELSE 'no detectable difference' END
 WHEN q < 0.05 AND (w = 'greater') = (e > 0) THEN 'SUPPORTED' WHEN q < 0.05 THEN 'CONTRADICTED (significant, opposite direction)' WHEN (w = 'greater') = (e > 0) THEN 'trend in the predicted direction, not significant' ELSE 'not supported (estimate in the opposite direction)' END AS verdict FROM t
""")
def prj17_verdict(spark, d):
    k = F.col("o_orderkey")
    w = F.get(F.array(F.lit("greater"), F.lit("less"), F.lit("two")), (k % 3).cast("int"))
    q = (k % 100) / 100.0
    return read(spark, d, "orders").select(k.alias("k"), fc.verdict(q, q, F.col("o_totalprice") - 100000, F.lit(0.0), w, F.lit(1), F.lit(3)).alias("verdict"))


@query("SELECT p_partkey, CASE WHEN starts_with(lower(n), 'soma') THEN 'soma' WHEN starts_with(lower(n), 'trunk') THEN 'trunk' ELSE 'branch' END AS kind FROM (SELECT p_partkey, (['Soma', 'TRUNK2', 'branch1'])[1 + p_partkey % 3] AS n FROM part)")
def prj1_compartment(spark, d):
    n = F.get(F.array(F.lit("Soma"), F.lit("TRUNK2"), F.lit("branch1")), (F.col("p_partkey") % 3).cast("int"))
    return read(spark, d, "part").select("p_partkey", fc.compartment(n).alias("kind"))


@query("""
WITH m AS (SELECT p_partkey AS k, (['multiROILongitudinalRibbonScan', 'transverseRibbon', 'ribbonScan', 'snakeScan', 'zStack', '', 'raster'])[1 + p_partkey % 7] AS method, CASE WHEN p_partkey % 2 = 0 THEN 'Camera' ELSE '' END AS tech, p_size AS n FROM part)
SELECT k, CASE WHEN contains(lower(method), 'snake') THEN 'snake' WHEN contains(lower(method), 'transverse') AND contains(lower(method), 'ribbon') THEN 'ribbon_transverse' WHEN contains(lower(method), 'longitudinal') THEN 'ribbon_longitudinal' WHEN contains(lower(method), 'ribbon') THEN 'ribbon'
 WHEN contains(lower(method), 'zstack') THEN 'zstack' WHEN tech = 'Camera' THEN CASE WHEN n = 1 THEN 'camera_snapshot' ELSE 'camera_series' END WHEN n = 1 THEN 'snapshot' ELSE coalesce(nullif(method, ''), 'timeseries') END AS kind FROM m
""")
def src5_scan_type(spark, d):
    names = ["multiROILongitudinalRibbonScan", "transverseRibbon", "ribbonScan", "snakeScan", "zStack", "", "raster"]
    m = F.get(F.array(*[F.lit(x) for x in names]), (F.col("p_partkey") % 7).cast("int"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("k"), fc.scan_type(m, F.when(F.col("p_partkey") % 2 == 0, "Camera").otherwise(""), F.col("p_size")).alias("kind"))


@query("SELECT o_custkey AS unit, count(*) AS frames, count(*) // 3 AS volumes FROM orders GROUP BY ALL HAVING count(*) >= 5 AND count(*) % 3 = 0")
def src1_container_scan(spark, d):
    n = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("unit")).agg(F.count("*").alias("frames"))
    return readers.usable_units(n, "frames", planes=3, least=5)


@query("SELECT event_id, event_id // 4 AS t, event_id % 4 AS z FROM events")
def src3_reshape(spark, d):
    return readers.frame_to_plane(read(spark, d, "events").select("event_id"), "event_id", 4)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) * 0.5 AS rate FROM events")
def src4_metadata(spark, d):
    return readers.parse_json(read(spark, d, "events"), "props", "k bigint").select("event_id", "k", (F.col("k") * 0.5).alias("rate"))


@query("SELECT user_id, coalesce(l[1 + user_id % 400], list_filter(l, lambda v: v % 2 = 0)[1], l[1]) AS picked FROM (SELECT user_id, list(event_id ORDER BY event_id) AS l FROM events GROUP BY user_id)")
def src6_pattern(spark, d):
    x = read(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("l"))
    return x.select("user_id", readers.pick_element(F.col("l"), F.col("user_id") % 400, lambda v: v % 2 == 0).alias("picked"))


@query("SELECT doc_id, CAST(nullif(regexp_extract(text, 'Frames: (\\d+)', 1), '') AS DOUBLE) AS frames, CAST(nullif(regexp_extract(text, 'Loss: ([0-9.]+)', 1), '') AS DOUBLE) AS loss, 2 AS n_warnings, 'late start | short' AS warnings FROM (SELECT doc_id, 'Frames: ' || CAST(n_chars AS VARCHAR) || ' Loss: ' || CAST(doc_id % 9 AS VARCHAR) || '.5' AS text FROM documents)")
def src9_text_report(spark, d):
    report = F.concat(F.lit("Frames: "), F.col("n_chars").cast("string"), F.lit(" Loss: "), (F.col("doc_id") % 9).cast("string"), F.lit(".5\nWarnings (2):\n - late start\n - short\n - late start\nFiles written: 3"))
    return read(spark, d, "documents").select("doc_id", readers.report(report, {"frames": r"Frames: (\d+)", "loss": r"Loss: ([0-9.]+)"}).alias("r")).select("doc_id", "r.*")


@query("""
WITH v AS (SELECT user_id, event_id % 3 AS wh, event_type AS e, count(*) AS n FROM events GROUP BY ALL)
, i AS (SELECT *, row_number() OVER (PARTITION BY user_id, wh ORDER BY e) AS i, count(*) OVER (PARTITION BY user_id, wh) AS w FROM v)
, l AS (SELECT user_id, n, coalesce(CASE WHEN w = 3 THEN ['d0', 'd1', 'd2'][i] WHEN w = 2 THEN ['a0', 'a1'][i] END, CASE WHEN e <> 'error' THEN e END, wh || '_var' || (i - 1)) AS channel FROM i WHERE n > 1)
SELECT user_id, channel, max(n) AS n FROM l GROUP BY ALL
""")
def src11_longest_channel(spark, d):
    v = read(spark, d, "events").groupBy("user_id", (F.col("event_id") % 3).alias("wh"), F.col("event_type").alias("e")).agg(F.count("*").alias("n"))
    own = F.when(F.col("e") != "error", F.col("e"))
    x = v.withColumn("i", F.row_number().over(Window.partitionBy("user_id", "wh").orderBy("e")) - 1).withColumn("own", own)
    return catalog.name_channels(x, "user_id", "wh", "i", "own", "n", [["d0", "d1", "d2"], ["a0", "a1"]])


@query("SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def src14_explode_nested(spark, d):
    l = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("items"))
    return read(spark, d, "orders").join(l, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", F.inline("items"))


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS click_n, round(avg(value) FILTER (event_type = 'click'), 6) AS click_mean, count(*) FILTER (event_type = 'view') AS view_n, round(avg(value) FILTER (event_type = 'view'), 6) AS view_mean FROM events GROUP BY user_id")
def src15_dict_to_wide(spark, d):
    e = read(spark, d, "events").where("event_type in ('click', 'view')").groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return read(spark, d, "events").select("user_id").distinct().join(e, "user_id", "left").select("user_id", *[F.coalesce(f"{c}_n", F.lit(0)).alias(f"{c}_n") for c in ("click", "view")], "click_mean", "view_mean")


@query("SELECT d.doc_id, array_to_string(list_filter([CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 0 THEN 'poor' END, CASE WHEN n_chars < 500 THEN 'short' END, CASE WHEN l.doc_id IS NULL THEN 'unlabelled' END], lambda x: x IS NOT NULL), ';') AS flags FROM documents d LEFT JOIN labels l USING (doc_id)")
def src16_flags(spark, d):
    x = read(spark, d, "documents").join(read(spark, d, "labels").withColumn("known", F.lit(True)), "doc_id", "left")
    f = F.array_compact(F.array(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 0, "poor"), F.when(F.col("n_chars") < 500, "short"), F.when(F.col("known").isNull(), "unlabelled")))
    return x.select("doc_id", F.array_join(f, ";").alias("flags"))


@query("SELECT doc_id, md5(text) AS md5, count(*) OVER (PARTITION BY md5(text)) = 1 AS restorable FROM documents")
def src18_manifest(spark, d):
    m = read(spark, d, "documents").select("doc_id", F.md5("text").alias("md5"))
    return m.join(m.groupBy("md5").agg(F.count("*").alias("n")), "md5").select("doc_id", "md5", (F.col("n") == 1).alias("restorable"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, len(string_split(url, '/')) AS parts, lpad(CAST(page_id AS VARCHAR), 6, '0') AS code FROM pages")
def src19_path_parsing(spark, d):
    return read(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.size(F.split("url", "/")).cast("long").alias("parts"), F.lpad(F.col("page_id").cast("string"), 6, "0").alias("code"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def snk1_round_trip(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    for kind in ("csv", "json", "orc"):
        path = readers.shared_path(spark, kind)
        rows.write.format(kind).option("compression", "none" if kind == "orc" else "gzip").save(path)
        rows = spark.read.format(kind).schema(rows.schema).load(path)
    return rows


@query("SELECT n_nationkey, n_name, n_regionkey AS region FROM nation")
def src8_csv(spark, d):
    path = readers.shared_path(spark, "csv")
    read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").write.csv(path, header=True)
    return readers.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int", {"region": ["area", "n_regionkey"]}).select("n_nationkey", "n_name", "region")


@query("SELECT event_id, value * 2 AS twice FROM events")
def src10_trace_csv(spark, d):
    path = readers.shared_path(spark, "trace")
    read(spark, d, "events").select("event_id", "value").write.csv(path, header=True)
    return readers.read_csv(spark, path, "event_id long, value double").select("event_id", (F.col("value") * 2).alias("twice"))


@query("SELECT n_regionkey AS area, count(*) AS n, min(n_name) AS first FROM nation GROUP BY ALL")
def src13_json_harvest(spark, d):
    root = readers.shared_path(spark, "tree")
    # One document a region, each an array of its nations.
    doc = F.to_json(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey")))
    docs = read(spark, d, "nation").groupBy("n_regionkey").agg(doc.alias("value")).select("value", F.col("n_regionkey").alias("area"))
    docs.repartition("area").write.partitionBy("area").text(f"{root}/now")
    docs.repartition("area").write.partitionBy("area").text(f"{root}/old/before")
    found = readers.read_json_tree(spark, root, "n_nationkey int, n_name string, n_regionkey int")
    return found.groupBy(F.col("n_regionkey").alias("area")).agg(F.count("*").alias("n"), F.min("n_name").alias("first"))


@query("SELECT n_nationkey, 'b' AS stamp FROM nation WHERE n_regionkey < 3")
def snk2_versions(spark, d):
    root, rows = readers.shared_path(spark, "versions"), read(spark, d, "nation").select("n_nationkey", "n_regionkey")
    readers.write_version(rows, root, "a")
    readers.write_version(rows.where("n_regionkey < 3"), root, "b")
    return readers.latest_version(rows, root, "n_nationkey int, n_regionkey int").select("n_nationkey", "stamp")


@query("SELECT o_custkey AS unit, count(*) AS frames, count(*) // 2 AS volumes FROM orders GROUP BY ALL HAVING count(*) >= 4 AND count(*) % 2 = 0")
def src2_unit_lookup(spark, d):
    units = readers.usable_units(read(spark, d, "orders").groupBy(F.col("o_custkey").alias("unit")).agg(F.count("*").alias("frames")), "frames", 2, 4)
    return readers.unit_or_fail(units, F.col("unit").isNotNull(), "frames", 2).select("unit", "frames", "volumes")


@query("SELECT sub AS grp, round(avg(m), 6) AS mean_of_means, count(*) AS groups FROM (SELECT grp AS sub, sub AS s, avg(y) AS m FROM runs GROUP BY ALL) GROUP BY ALL")
def agg6_mean_of_means(spark, d):
    return stats.mean_of_means(runs(spark, d), ["grp"], ["sub"], "y").withColumn("mean_of_means", F.round("mean_of_means", 6))


@query("SELECT sub, round(sum(y) / sum(n_orders), 6) AS ratio FROM runs GROUP BY sub")
def agg7_ratio_of_sums(spark, d):
    return runs(spark, d).groupBy("sub").agg(F.round(F.sum("y") / F.sum("n_orders"), 6).alias("ratio"))


@query("SELECT lang, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY lang")
def agg8_counts(spark, d):
    return read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@query("SELECT CAST(floor(o_totalprice / 40000) AS BIGINT) AS bin, count(*) AS n, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY ALL HAVING count(*) >= 3")
def agg9_histogram(spark, d):
    return read(spark, d, "orders").groupBy(F.floor(F.col("o_totalprice") / 40000).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 6).alias("mean")).where("n >= 3")


@query("SELECT region, round(quantile_cont(f, 0.1), 6) AS p10, round(quantile_cont(f, 0.99), 6) AS p99, round(quantile_cont(f, 0.995), 6) AS p995 FROM panel GROUP BY region")
def agg2_percentiles(spark, d):
    p = lambda q, n: F.round(F.percentile("f", q), 6).alias(n)
    return panel(spark, d).groupBy("region").agg(p(0.1, "p10"), p(0.99, "p99"), p(0.995, "p995"))


@query("SELECT region, round(kurtosis_pop(f), 6) AS kurt, round(skewness(f), 6) AS skew_corrected FROM panel GROUP BY region")
def agg5_moments(spark, d):
    n = F.count("f")
    return panel(spark, d).groupBy("region").agg(F.round(F.kurtosis("f"), 6).alias("kurt"), F.round(F.skewness("f") * F.sqrt(n * (n - 1)) / (n - 2), 6).alias("skew_corrected"))


@query("SELECT round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd FROM (SELECT grp, avg(y) AS v FROM runs GROUP BY grp)")
def agg16_pooled(spark, d):
    return runs(spark, d).groupBy("grp").agg(F.avg("y").alias("v")).agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("sd"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS kinds FROM events GROUP BY user_id")
def agg17_collect(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ";").alias("kinds"))


@query("SELECT user_id, round(avg(value) FILTER (event_type = 'view'), 6) AS ref, round(avg(value) FILTER (event_type IN ('click', 'signup')), 6) AS branch, round(avg(value), 6) AS cell FROM events GROUP BY user_id")
def agg18_compartments(spark, d):
    k = F.col("event_type")
    m = lambda c, n: F.round(F.avg(F.when(c, F.col("value"))), 6).alias(n)
    return read(spark, d, "events").groupBy("user_id").agg(m(k == "view", "ref"), m(k.isin("click", "signup"), "branch"), F.round(F.avg("value"), 6).alias("cell"))


@query("SELECT grp, sub, count(*) AS n, round(avg(y), 6) AS mean FROM runs GROUP BY ROLLUP (grp, sub)")
def rollup_totals(spark, d):
    return runs(spark, d).rollup("grp", "sub").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("mean"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_values(spark, d):
    return read(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT run, round((rank() OVER (PARTITION BY sub ORDER BY x)) + (count(*) OVER (PARTITION BY sub, x) - 1) / 2.0, 6) AS place FROM runs")
def win6_average_rank(spark, d):
    return runs(spark, d).select("run", F.round(series.average_rank("x", ["sub"]), 6).alias("place"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders")
def win7_acquisition_order(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("i"))


@query("SELECT doc_id, source FROM (SELECT *, count(*) OVER (PARTITION BY md5(text)) AS n FROM documents) WHERE n >= 2")
def win11_group_size(spark, d):
    x = read(spark, d, "documents").withColumn("k", F.md5("text"))
    return x.join(x.groupBy("k").agg(F.count("*").alias("n")).where("n >= 2"), "k", "left_semi").select("doc_id", "source")


@query("SELECT doc_id, row_number() OVER (ORDER BY toxic NULLS LAST, quality DESC NULLS LAST, n_chars DESC, doc_id) AS place FROM documents LEFT JOIN labels USING (doc_id)")
def srt1_multi_key(spark, d):
    x = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    x = x.select("doc_id", "toxic", "quality", "n_chars")
    return place(x, F.asc_nulls_last("toxic"), F.desc_nulls_last("quality"), F.desc("n_chars"), "doc_id").select("doc_id", "place")


@query("SELECT user_id, arg_max(event_id, struct_pack(v := value, e := -event_id)) AS best FROM events GROUP BY user_id")
def srt4_argmax(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best"))


@query("SELECT DISTINCT user_id, s FROM points WHERE region IN ('click', 'signup')")
def set1_pooled_events(spark, d):
    from lamina.plans.fixtures import points

    p = points(spark, d)
    return p.where("region = 'click'").select("user_id", "s").unionByName(p.where("region = 'signup'").select("user_id", "s")).distinct()


@query("(SELECT user_id FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE value > 489) UNION ALL (SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE value > 489)")
def set2_difference(spark, d):
    e = read(spark, d, "events")
    ids = lambda c: e.where(c).select("user_id")
    high = ids("value > 489")
    return ids("event_type = 'view'").subtract(high).unionByName(ids("event_type = 'purchase'").intersect(high))


@query("""
WITH s AS (SELECT 'all' AS subset, * FROM runs UNION ALL SELECT 'positive', * FROM runs WHERE x > 0 UNION ALL SELECT 'busy', * FROM runs WHERE n_orders > 10)
SELECT subset, count(*) AS n, round(avg(y), 6) AS mean, round(corr(x, y), 6) AS r FROM s GROUP BY subset
""")
def set4_subsets(spark, d):
    x = runs(spark, d)
    p = {"all": F.lit(True), "positive": F.col("x") > 0, "busy": F.col("n_orders") > 10}
    return stats.subsets(x, p, [F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("mean"), F.round(F.corr("x", "y"), 6).alias("r")])


@query("SELECT o_orderkey, strftime(o_orderdate, '%m-%d-%Y') AS us, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS days, regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g') AS slug FROM orders")
def scalar_strings_dates(spark, d):
    day = F.col("o_orderdate")
    return read(spark, d, "orders").select("o_orderkey", F.date_format(day, "MM-dd-yyyy").alias("us"), F.datediff(day, F.lit("1995-01-01").cast("date")).cast("long").alias("days"), fc.slug(F.col("o_orderpriority")).alias("slug"))


@query("SELECT p_partkey, CASE WHEN starts_with(a, 'ab') THEN 'ab' WHEN starts_with(a, 'a') THEN 'a' ELSE '' END AS prefix FROM (SELECT p_partkey, (['abx', 'acz', 'q'])[1 + p_partkey % 3] AS a FROM part)")
def scalar_common_prefix(spark, d):
    a = F.get(F.array(F.lit("abx"), F.lit("acz"), F.lit("q")), (F.col("p_partkey") % 3).cast("int"))
    return read(spark, d, "part").select("p_partkey", fc.common_prefix(a, F.lit("abc")).alias("prefix"))


@query("SELECT user_id, len(l) AS n, l[1:2] AS head, list_sum(l) AS total FROM (SELECT user_id, list(event_id ORDER BY event_id) AS l FROM events GROUP BY user_id)")
def scalar_arrays(spark, d):
    x = read(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("l"))
    return x.select("user_id", F.size("l").cast("long").alias("n"), F.slice("l", 1, 2).alias("head"), F.aggregate("l", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


@query("SELECT l_orderkey, count(*) FILTER (l_quantity IS NULL) AS missing, count(*) FILTER (l_discount < 0 OR l_discount > 1) AS out_of_range, count(*) - count(DISTINCT l_linenumber) AS repeated FROM lineitem GROUP BY l_orderkey")
def x21_contract(spark, d):
    n = lambda c: F.sum(c.cast("int")).cast("long")
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(n(F.col("l_quantity").isNull()).alias("missing"), n((F.col("l_discount") < 0) | (F.col("l_discount") > 1)).alias("out_of_range"), (F.count("*") - F.count_distinct("l_linenumber")).alias("repeated"))


@query("SELECT o_custkey, max(o_orderdate) > min(o_orderdate) + INTERVAL 900 DAY AS stale FROM orders GROUP BY o_custkey")
def x26_staleness(spark, d):
    return read(spark, d, "orders").groupBy("o_custkey").agg((F.max("o_orderdate") > F.min("o_orderdate") + F.expr("INTERVAL 900 DAYS")).alias("stale"))
