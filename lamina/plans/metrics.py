"""Queries on catalogs, per-run metrics, fits and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.operators import catalog, series, shrinkage, stats
from lamina.operators import volume as vol
from lamina.plans.fixtures import mask, panel, query, r6, read, runs, voxels

YX = ["y", "x"]
BOX = {"y": (0, 7), "x": (0, 7)}
DELTA = "(SELECT a - 1 AS dy, b - 1 AS dx FROM (SELECT unnest(range(0, 3)) AS a), (SELECT unnest(range(0, 3)) AS b))"


@query("""
WITH k AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, l_partkey FROM lineitem WHERE l_returnflag IN ('R', 'A') OR l_quantity >= 20)
SELECT l_orderkey, l_linenumber, concat_ws('|', l_returnflag, CAST(l_partkey AS VARCHAR)) AS fingerprint FROM k QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1
""")
def x1_imaging_catalog(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_partkey")
    keep = F.col("l_returnflag").isin("R", "A") | (F.col("l_quantity") >= 20)
    return catalog.load_catalog(rows, keep, ["l_orderkey"], ["l_linenumber", "l_partkey"], ["l_returnflag", "l_partkey"]).select("l_orderkey", "l_linenumber", "fingerprint")


@query("""
WITH t AS (SELECT o_orderkey, o_custkey AS session, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 97 END AS run FROM orders)
SELECT session, o_orderkey, run, row_number() OVER (PARTITION BY session ORDER BY run NULLS LAST, o_orderkey) AS place, min(o_orderkey) OVER (PARTITION BY session, run) AS trigger_of_run FROM t
""")
def x2_trigger_catalog(spark, d):
    from pyspark.sql import Window

    t = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("session"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 97).alias("run"))
    place = F.row_number().over(Window.partitionBy("session").orderBy(F.col("run").asc_nulls_last(), "o_orderkey"))
    return t.select("session", "o_orderkey", "run", place.alias("place"), F.min("o_orderkey").over(Window.partitionBy("session", "run")).alias("trigger_of_run"))


@query("SELECT page_id, url FROM pages WHERE regexp_matches(split_part(url, '/', 4), '^[a-z]+$|[0-9]{2}') AND NOT contains(url, 'mirror')")
def x3_path_guard(spark, d):
    return read(spark, d, "pages").select("page_id", "url").where(F.split_part("url", F.lit("/"), F.lit(4)).rlike("^[a-z]+$|[0-9]{2}") & ~F.contains("url", F.lit("mirror")))


@query("""
WITH r AS (SELECT c_custkey AS run, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey END AS first_key, c_nationkey AS second_key FROM customer)
, m AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE s_suppkey END AS first_key, s_nationkey AS second_key, s_acctbal AS rate FROM supplier)
SELECT run, coalesce((SELECT min(rate) FROM m WHERE m.first_key = r.first_key), (SELECT min(rate) FROM m WHERE m.second_key = r.second_key)) AS rate FROM r
""")
def x6_metadata_lookup(spark, d):
    r = read(spark, d, "customer").select(F.col("c_custkey").alias("run"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey")).alias("first_key"), F.col("c_nationkey").alias("second_key"))
    m = read(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 2 != 0, F.col("s_suppkey")).alias("first_key"), F.col("s_nationkey").alias("second_key"), F.col("s_acctbal").alias("rate"))
    return catalog.two_key_lookup(r, m, "first_key", "second_key", "rate").select("run", "rate")


@query("""
SELECT c_custkey AS run, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') THEN 'curated' WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'other' ELSE 'screening' END AS run_set,
    CASE WHEN starts_with(c_mktsegment, 'A') THEN 'auto' ELSE 'manual' END AS source FROM customer
""")
def x7_run_sets(spark, d):
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    c = read(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    label = F.when(F.col("urgent"), "curated").when(F.col("urgent").isNotNull(), "other").otherwise("screening")
    return c.select(F.col("c_custkey").alias("run"), label.alias("run_set"), F.when(F.startswith("c_mktsegment", F.lit("A")), "auto").otherwise("manual").alias("source"))


@query("""
WITH s AS (SELECT run, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS balance, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS price, (z - avg(z) OVER ()) / stddev_pop(z) OVER () AS orders FROM runs)
, l AS (SELECT run, name, v FROM (SELECT run, unnest(['balance', 'price', 'orders']) AS name, unnest([balance, price, orders]) AS v FROM s) WHERE v > 1)
SELECT s.run, coalesce((SELECT string_agg(name, ', ' ORDER BY v DESC, name) FROM (SELECT * FROM l WHERE l.run = s.run ORDER BY v DESC, name LIMIT 3)), '') AS reasons,
    CASE WHEN run % 100 < 25 THEN 1 WHEN run % 100 < 50 THEN 2 WHEN run % 100 < 75 THEN 3 ELSE 4 END AS tier FROM s
""")
def x9_reason_phrases(spark, d):
    r = runs(spark, d)
    m = r.agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = {name: (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}") for name, c in (("balance", "x"), ("price", "y"), ("orders", "z"))}
    return catalog.reason_phrases(r.join(F.broadcast(m)), z, least=1.0).select("run", "reasons", catalog.tier(F.col("run") % 100 / 100).alias("tier"))


@query("""
WITH c AS (SELECT frame, label, sum(x * greatest(v, 0)) / nullif(sum(greatest(v, 0)), 0) AS cx FROM voxels GROUP BY ALL), s AS (SELECT label, avg(cx) AS soma FROM c GROUP BY label)
SELECT frame, label, round(abs(cx - soma), 6) AS distance, row_number() OVER (PARTITION BY label ORDER BY abs(cx - soma), frame) AS place FROM c JOIN s USING (label)
""")
def x10_proximal_order(spark, d):
    from pyspark.sql import Window

    up = F.greatest("v", F.lit(0.0))
    c = voxels(spark, d).groupBy("frame", "label").agg((F.sum(F.col("x") * up) / F.nullif(F.sum(up), F.lit(0.0))).alias("cx"))
    c = series.add_group(c, ["label"], soma=F.avg("cx")).withColumn("far", F.abs(F.col("cx") - F.col("soma")))
    return c.select("frame", "label", F.round("far", 6).alias("distance"), F.row_number().over(Window.partitionBy("label").orderBy("far", "frame")).alias("place"))


@query("SELECT c_custkey AS run, c_custkey NOT IN (SELECT o_custkey FROM orders) AS imaging_only, CASE WHEN c_custkey % 50 = 0 THEN 1e-300 ELSE (c_custkey % 50) / 50.0 END AS p FROM customer")
def x14_imaging_only(spark, d):
    seen = read(spark, d, "orders").select(F.col("o_custkey").alias("run")).distinct().withColumn("seen", F.lit(True))
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("run")).join(seen, "run", "left")
    return c.select("run", F.col("seen").isNull().alias("imaging_only"), catalog.floor_p(F.col("run") % 50 / F.lit(50.0)).alias("p"))


@query("SELECT sub, round(min(y), 6) AS coupled, round(avg(y), 6) AS observed, round(max(y), 6) AS independent, min(y) < avg(y) AND avg(y) < max(y) AS bracketed FROM runs GROUP BY sub")
def x17_surrogate_bracket(spark, d):
    g = runs(spark, d).groupBy("sub").agg(F.min("y").alias("coupled"), F.avg("y").alias("observed"), F.max("y").alias("independent"))
    return g.select("sub", *r6("coupled", "observed", "independent"), catalog.bracketed(F.col("coupled"), F.col("observed"), F.col("independent")).alias("bracketed"))


@query("""
WITH s AS (SELECT CAST(c AS DOUBLE) / 20 AS cut, count(*) FILTER (abs(v) > CAST(c AS DOUBLE) / 20) AS n FROM voxels, (SELECT unnest(range(1, 11)) AS c) GROUP BY ALL)
, b AS (SELECT *, lag(n) OVER (ORDER BY cut) - n AS drop_before, n - lead(n) OVER (ORDER BY cut) AS drop_after FROM s)
SELECT cut, n, drop_before - drop_after AS bend, coalesce(drop_before - drop_after = max(drop_before - drop_after) OVER (), false) AS elbow FROM b
""")
def x22_threshold_elbow(spark, d):
    from pyspark.sql import Window

    cuts = [c / 20 for c in range(1, 11)]
    one = voxels(spark, d).agg(*[F.count(F.when(F.abs("v") > c, 1)).alias(str(i)) for i, c in enumerate(cuts)])
    s = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("cut"), F.col(str(i)).alias("n")) for i, c in enumerate(cuts)])).alias("s")).select("s.*")
    w = Window.orderBy("cut")  # ten rows, one a cut
    s = s.withColumn("bend", (F.lag("n").over(w) - F.col("n")) - (F.col("n") - F.lead("n").over(w)))
    return s.withColumn("elbow", F.coalesce(F.col("bend") == F.max("bend").over(Window.partitionBy()), F.lit(False)))


@query("SELECT y, x, round(max(v), 6) AS top, round(avg(v), 6) AS mean FROM voxels GROUP BY ALL")
def x31_time_collapse(spark, d):
    return voxels(spark, d).groupBy(*YX).agg(F.round(F.max("v"), 6).alias("top"), F.round(F.avg("v"), 6).alias("mean"))


@query("""
WITH p AS (SELECT region, CAST(t % 24 AS DOUBLE) AS t, avg(f) AS f FROM panel GROUP BY ALL), e AS (SELECT region, CAST(k AS DOUBLE) / 2 AS tau, exp(-t / (CAST(k AS DOUBLE) / 2)) AS e, f FROM p, (SELECT unnest(range(2, 40)) AS k))
, g AS (SELECT region, tau, regr_r2(f, e) AS r2, regr_intercept(f, e) AS a, regr_slope(f, e) AS b FROM e GROUP BY ALL)
SELECT region, CASE WHEN r2 >= 0.05 THEN tau END AS tau, round(r2, 6) AS r2, round(a, 4) AS a, round(b, 4) AS b FROM g QUALIFY row_number() OVER (PARTITION BY region ORDER BY r2 DESC, tau) = 1
""")
def ts13_decay_fit(spark, d):
    p = panel(spark, d).groupBy("region", (F.col("t") % 24).cast("double").alias("t")).agg(F.avg("f").alias("f"))
    return catalog.decay_fit(p, ["region"], "t", "f", [k / 2 for k in range(2, 40)], 0.05).select("region", "tau", F.round("r2", 6).alias("r2"), F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@query("""
WITH m AS (SELECT region, t // 24 AS day, min(f) AS lo, max(f) AS hi, arg_min(t, (-f, t)) AS peak FROM panel GROUP BY ALL)
SELECT region, day, peak, t10, t90, t90 - t10 AS rise FROM (SELECT m.region, m.day, peak, max(t) FILTER (f < lo + 0.1 * (hi - lo)) AS t10, max(t) FILTER (f < lo + 0.9 * (hi - lo)) AS t90 FROM panel p JOIN m ON p.region = m.region AND p.t // 24 = m.day AND p.t < peak GROUP BY ALL)
""")
def ts14_rise_time(spark, d):
    x = panel(spark, d).withColumn("day", F.floor(F.col("t") / 24))
    return catalog.rise_time(x, ["region", "day"], "t", "f")


@query("""
WITH c AS (SELECT frame, label, sqrt(power(sum(x * greatest(v, 0)) / nullif(sum(greatest(v, 0)), 0) - 3.5, 2) + power(sum(y * greatest(v, 0)) / nullif(sum(greatest(v, 0)), 0) - 3.5, 2)) AS far, max(v) AS top FROM voxels GROUP BY ALL)
, m AS (SELECT label, frame, far, ln(top / median(top) OVER (PARTITION BY label)) / ln(2) AS ratio FROM c WHERE top > 0)
SELECT a.label, round(median((b.ratio - a.ratio) / (b.far - a.far)), 5) AS slope FROM m a JOIN m b ON a.label = b.label AND a.frame < b.frame AND a.far <> b.far GROUP BY a.label
""")
def ts22_amplitude_distance(spark, d):
    up = F.greatest("v", F.lit(0.0))
    at = lambda a: F.sum(F.col(a) * up) / F.nullif(F.sum(up), F.lit(0.0)) - 3.5
    c = voxels(spark, d).groupBy("frame", "label").agg(F.sqrt(at("x") ** 2 + at("y") ** 2).alias("far"), F.max("v").alias("top")).where("top > 0")
    m = series.add_group(c, ["label"], med=F.median("top")).withColumn("ratio", F.log2(F.col("top") / F.col("med")))
    return stats.theil_sen(m, ["label"], "far", "ratio").select("label", F.round("slope", 5).alias("slope"))


@query(f"""
WITH core AS (SELECT m.frame, m.y, m.x FROM mask m JOIN (SELECT frame, y + dy AS y, x + dx AS x, count(*) AS n FROM mask, {DELTA} WHERE dy = 0 OR dx = 0 GROUP BY ALL) s USING (frame, y, x) WHERE n = 5)
, w AS (SELECT m.frame, avg(v) AS full_mean, avg(v) FILTER (c.frame IS NOT NULL) AS core_mean, count(c.frame) AS n_core FROM mask m JOIN voxels u USING (frame, y, x) LEFT JOIN core c USING (frame, y, x) GROUP BY m.frame)
SELECT frame, round(full_mean, 6) AS full_mean, round(core_mean, 6) AS core_mean, n_core FROM w
""")
def ts24_core_against_full(spark, d):
    m = mask(spark, d)
    steps = [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)]
    core = vol.shifted(m, ["frame"], YX, steps).groupBy("frame", *YX).agg(F.count("*").alias("n")).where(f"n = {len(steps)}").select("frame", *YX).withColumn("core", F.lit(True))
    w = m.join(voxels(spark, d).select("frame", *YX, "v"), ["frame", *YX]).join(core, ["frame", *YX], "left")
    return w.groupBy("frame").agg(F.round(F.avg("v"), 6).alias("full_mean"), F.round(F.avg(F.when(F.col("core"), F.col("v"))), 6).alias("core_mean"), F.count("core").alias("n_core"))


@query("""
WITH h AS (SELECT region, t, f, f - avg(f) OVER (PARTITION BY region) AS c, lag(f) OVER (PARTITION BY region ORDER BY t) AS p FROM panel)
, r AS (SELECT a.region, avg(a.r) AS coupling FROM (SELECT a.region, b.region AS other, corr(a.f, b.f) AS r FROM panel a JOIN panel b ON a.t = b.t AND a.region <> b.region GROUP BY ALL) a GROUP BY a.region)
, e AS (SELECT event_type AS region, count(*) AS n_events, count(DISTINCT user_id) AS n_users FROM events GROUP BY ALL)
SELECT region, count(*) AS n_frames, round(avg(f), 6) AS mean, round(stddev_samp(f), 6) AS sd, round(quantile_cont(f, 0.1), 6) AS f0, round(regr_slope(f, t), 9) AS bleaching, round(corr(f, p), 6) AS lag1, round(any_value(coupling), 6) AS coupling, any_value(n_events) AS n_events, any_value(n_users) AS n_users, round(any_value(n_events) / (max(t) - min(t) + 1), 6) AS rate
FROM h JOIN r USING (region) JOIN e USING (region) GROUP BY region
""")
def ts25_metric_row(spark, d):
    from pyspark.sql import Window

    x = panel(spark, d)
    own = x.withColumn("p", F.lag("f").over(Window.partitionBy("region").orderBy("t"))).groupBy("region").agg(
        F.count("*").alias("n_frames"), F.avg("f").alias("mean"), F.stddev_samp("f").alias("sd"), F.percentile("f", 0.1).alias("f0"), F.regr_slope("f", "t").alias("bleaching"), F.corr("f", "p").alias("lag1"), (F.max("t") - F.min("t") + 1).alias("hours"))
    y = x.select(F.col("region").alias("other"), "t", F.col("f").alias("g"))
    coupling = x.join(y, "t").where("region <> other").groupBy("region", "other").agg(F.corr("f", "g").alias("r")).groupBy("region").agg(F.avg("r").alias("coupling"))
    events = read(spark, d, "events").groupBy(F.col("event_type").alias("region")).agg(F.count("*").alias("n_events"), F.count_distinct("user_id").alias("n_users"))
    row = own.join(coupling, "region").join(events, "region")
    return row.select("region", "n_frames", *r6("mean", "sd", "f0"), F.round("bleaching", 9).alias("bleaching"), *r6("lag1", "coupling"), "n_events", "n_users", F.round(F.col("n_events") / F.col("hours"), 6).alias("rate"))


@query("""
WITH d AS (SELECT sub, run, x - z AS d FROM runs), r AS (SELECT sub, d, rank() OVER (PARTITION BY sub ORDER BY abs(d)) + (count(*) OVER (PARTITION BY sub, abs(d)) - 1) / 2.0 AS r FROM d WHERE d <> 0)
, g AS (SELECT sub, count(*) AS n, CAST(coalesce(sum(r) FILTER (d > 0), 0) AS DOUBLE) AS w, (coalesce(sum(r) FILTER (d > 0), 0) - sum(r) / 2) / sqrt(sum(r * r) / 4) AS z FROM r GROUP BY sub)
, p AS (SELECT *, greatest(-8.3, least(8.3, z)) AS c FROM g)
SELECT sub, n, w, round(z, 6) AS z, round(least(1.0, greatest(0.0, 0.5 - c * exp(-c * c / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 201), lambda k: exp(k * ln(greatest(c * c, 1e-300)) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1))))))), 6) AS p FROM p
""")
def st3_paired_signed_rank(spark, d):
    x = runs(spark, d).withColumn("d", F.col("x") - F.col("z"))
    return stats.signed_rank_z(x, ["sub"], "d").select("sub", "n", "w", *r6("z", "p"))


@query("""
WITH t AS (SELECT grp AS fam, sub AS k, count(*) AS n, count(*) FILTER (y > 150000) AS s FROM runs GROUP BY ALL)
, p AS (SELECT fam, k, n, s, least(1.0, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5)))) AS p FROM (SELECT *, unnest(range(s, n + 1)) AS i FROM t) GROUP BY ALL)
, r AS (SELECT *, p * count(*) OVER (PARTITION BY fam) / row_number() OVER (PARTITION BY fam ORDER BY p, k) AS raw FROM p)
, q AS (SELECT *, least(1.0, min(raw) OVER (PARTITION BY fam ORDER BY p DESC, k DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r)
SELECT fam, k, round(p, 6) AS p, round(q, 6) AS q, CASE WHEN q < 0.05 THEN 'supported' WHEN p < 0.05 THEN 'nominal' ELSE 'open' END AS verdict, count(*) FILTER (q < 0.05) OVER (PARTITION BY fam) AS n_supported FROM q
""")
def st20_test_families(spark, d):
    from pyspark.sql import Window

    t = runs(spark, d).groupBy(F.col("grp").alias("fam"), F.col("sub").alias("k")).agg(F.count("*").alias("n"), F.count(F.when(F.col("y") > 150000, 1)).alias("s"))
    q = stats.benjamini_hochberg(t.withColumn("p", stats.binomial_tail(F.col("s"), F.col("n"))), "p", ["fam"], "k")
    verdict = F.when(F.col("q") < 0.05, "supported").when(F.col("p") < 0.05, "nominal").otherwise("open")
    return q.select("fam", "k", *r6("p", "q"), verdict.alias("verdict"), F.count(F.when(F.col("q") < 0.05, 1)).over(Window.partitionBy("fam")).alias("n_supported"))


@query("""
WITH RECURSIVE c AS (SELECT frame, y, x, row_number() OVER (PARTITION BY frame ORDER BY -v, y, x) AS i FROM voxels WHERE v > 0.1)
, s(frame, i, ys, xs) AS (
    SELECT frame, 1, [y], [x] FROM c WHERE i = 1
    UNION ALL
    SELECT s.frame, s.i + 1, CASE WHEN ok THEN list_append(ys, y) ELSE ys END, CASE WHEN ok THEN list_append(xs, x) ELSE xs END
    FROM (SELECT s.*, c.y, c.x, len(ys) < 8 AND len(list_filter(range(1, len(ys) + 1), lambda k: abs(ys[k] - c.y) <= 1 AND abs(xs[k] - c.x) <= 1)) = 0 AS ok FROM s JOIN c ON c.frame = s.frame AND c.i = s.i + 1) s
), l AS (SELECT frame, arg_max(ys, i) AS ys, arg_max(xs, i) AS xs FROM s GROUP BY frame)
SELECT frame, k AS place, ys[k] AS y, xs[k] AS x FROM (SELECT *, unnest(range(1, len(ys) + 1)) AS k FROM l)
""")
def srt3_greedy_suppression(spark, d):
    return catalog.greedy_suppression(voxels(spark, d).where("v > 0.1"), ["frame"], [-F.col("v")], YX, 1)


@query("""
WITH b AS (SELECT region, t, f < median(f) OVER (PARTITION BY region) AS low, row_number() OVER (PARTITION BY region ORDER BY t) AS i, count(*) OVER (PARTITION BY region) AS n FROM panel)
SELECT region, coalesce(min(i) FILTER (NOT low) - 1, any_value(n)) AS head, coalesce(any_value(n) - max(i) FILTER (NOT low), any_value(n)) AS tail FROM b GROUP BY region
""")
def win12_boundary_walk(spark, d):
    x = series.add_group(panel(spark, d), ["region"], med=F.median("f"))
    return catalog.boundary_runs(x, ["region"], "t", F.col("f") < F.col("med"))


@query(f"""
WITH s AS (SELECT v.frame, v.y, v.x, any_value(v.v) AS v, avg(u.v) AS smooth FROM voxels v JOIN {DELTA} ON true JOIN voxels u ON u.frame = v.frame AND u.y = v.y + dy AND u.x = v.x + dx GROUP BY ALL)
, q AS (SELECT frame, median(smooth) AS med, quantile_cont(smooth, 0.84) AS p84 FROM s GROUP BY frame)
SELECT frame, y, x, round(greatest((smooth - med) / greatest(p84 - med, 1e-9), v), 6) AS score FROM s JOIN q USING (frame)
""")
def vol3_score_map(spark, d):
    v = voxels(spark, d).select("frame", *YX, "v")
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in steps]))
    spread = v.withColumn("s", near).select("frame", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "v").groupBy("frame", *YX).agg(F.avg("v").alias("smooth"))
    s = series.add_group(v.join(spread, ["frame", *YX]), ["frame"], med=F.median("smooth"), p84=F.percentile("smooth", 0.84))
    z = (F.col("smooth") - F.col("med")) / F.greatest(F.col("p84") - F.col("med"), F.lit(1e-9))
    return s.select("frame", *YX, F.round(F.greatest(z, "v"), 6).alias("score"))


@query(f"""
WITH g AS (SELECT DISTINCT frame, y + dy AS y, x + dx AS x FROM mask, {DELTA})
SELECT frame, y, x FROM (SELECT frame, y + dy AS y, x + dx AS x, count(*) AS n FROM g, {DELTA} GROUP BY ALL) WHERE n = 9 AND y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7
""")
def vol4_close(spark, d):
    return vol.close(mask(spark, d), ["frame"], YX).where("y between 0 and 7 and x between 0 and 7")


@query("""
WITH RECURSIVE a AS (SELECT DISTINCT frame, y, x FROM voxels), b AS (SELECT a.* FROM a LEFT JOIN mask m ON a.frame = m.frame AND a.y = m.y AND a.x = m.x WHERE m.frame IS NULL)
, o AS (SELECT * FROM b WHERE y IN (0, 7) OR x IN (0, 7) UNION SELECT b.* FROM o JOIN b ON o.frame = b.frame AND abs(o.y - b.y) + abs(o.x - b.x) = 1)
SELECT a.frame, a.y, a.x FROM a LEFT JOIN o ON a.frame = o.frame AND a.y = o.y AND a.x = o.x WHERE o.frame IS NULL
""")
def vol4_fill_holes(spark, d):
    return vol.fill_holes(mask(spark, d), voxels(spark, d).select("frame", *YX), ["frame"], YX, BOX)


@query("SELECT frame, round(atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) / 2, 5) AS angle, round(((var_pop(x) + var_pop(y)) / 2 + sqrt(power((var_pop(x) - var_pop(y)) / 2, 2) + power(covar_pop(x, y), 2))) / nullif(var_pop(x) + var_pop(y), 0), 5) AS share FROM mask GROUP BY frame HAVING abs(covar_pop(x, y)) > 1e-9")
def ml11_principal_axis(spark, d):
    m = mask(spark, d).select("frame", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    slanted = m.groupBy("frame").agg(F.abs(F.covar_pop("x", "y")).alias("b")).where("b > 1e-9").select("frame")
    return catalog.principal_axis(m.join(slanted, "frame", "left_semi"), ["frame"], "x", "y").select("frame", F.round("angle", 5).alias("angle"), F.round("share", 5).alias("share"))


@query("""
WITH g AS (SELECT sub, avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, var_samp(y) AS c, covar_samp(x, y) AS b FROM runs GROUP BY sub)
SELECT run, round((c * (x - mx) * (x - mx) - 2 * b * (x - mx) * (y - my) + a * (y - my) * (y - my)) / nullif(a * c - b * b, 0), 5) AS d2 FROM runs JOIN g USING (sub)
""")
def ml8_mahalanobis(spark, d):
    return catalog.mahalanobis(runs(spark, d), ["sub"], "x", "y").select("run", F.round("d2", 5).alias("d2"))


@query("""
WITH r AS (SELECT sub, run, CASE WHEN run % 17 > 0 THEN x END AS x, y, CASE WHEN run % 23 > 0 THEN z END AS z, run % 3 < 2 AS good FROM runs)
, g AS (SELECT DISTINCT sub AS g FROM r), l AS (UNPIVOT r ON x, y, z INTO NAME f VALUE v)
, m AS (SELECT g, f, median(v) AS c, stddev_samp(v) AS sd FROM l JOIN g ON sub <> g WHERE good GROUP BY ALL)
, s AS (SELECT m.g, m.f, c, greatest(1.4826 * median(abs(v - c)), coalesce(0.5 * any_value(sd), 0)) + 1e-9 AS s FROM m JOIN l ON l.f = m.f AND l.sub <> m.g AND good GROUP BY ALL)
, w AS (SELECT g, max(c) FILTER (f = 'x') AS cx, max(s) FILTER (f = 'x') AS sx, max(c) FILTER (f = 'y') AS cy, max(s) FILTER (f = 'y') AS sy, max(c) FILTER (f = 'z') AS cz, max(s) FILTER (f = 'z') AS sz FROM s GROUP BY g HAVING count(*) = 3)
, t AS (SELECT w.g, sub, run, good, coalesce((x - cx) / sx, 0) AS a, coalesce((y - cy) / sy, 0) AS b, coalesce((z - cz) / sz, 0) AS c FROM r CROSS JOIN w)
, k AS (SELECT g, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, var_pop(a) AS aa, var_pop(b) AS bb, var_pop(c) AS cc, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, c) AS bc FROM t WHERE good AND sub <> g GROUP BY g)
, q AS (SELECT g, avg(power(power(a - ma, 2) + power(b - mb, 2) + power(c - mc, 2), 2)) AS q4 FROM t JOIN k USING (g) WHERE good AND sub <> g GROUP BY g)
, h AS (SELECT *, (aa + bb + cc) / 3 AS mu, aa * aa + bb * bb + cc * cc + 2 * (ab * ab + ac * ac + bc * bc) AS size FROM k JOIN q USING (g))
, b AS (SELECT *, least((q4 - size) / (3 * n), (size - 3 * mu * mu) / 3) / ((size - 3 * mu * mu) / 3) AS weight FROM h)
, e AS (SELECT g, weight, (1 - weight) * aa + weight * mu AS aa, (1 - weight) * bb + weight * mu AS bb, (1 - weight) * cc + weight * mu AS cc, (1 - weight) * ab AS ab, (1 - weight) * ac AS ac, (1 - weight) * bc AS bc FROM b)
, d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM e)
SELECT run, sub, round(sqrt((a * a * (bb * cc - bc * bc) + b * b * (aa * cc - ac * ac) + c * c * (aa * bb - ab * ab) + 2 * a * b * (ac * bc - ab * cc) + 2 * a * c * (ab * bc - ac * bb) + 2 * b * c * (ab * ac - aa * bc)) / det / 3), 5) AS distance, round(weight, 5) AS weight FROM t JOIN d USING (g) WHERE sub = g
""")
def ml8_shrunk_distance(spark, d):
    r = runs(spark, d).withColumn("x", F.when(F.col("run") % 17 > 0, F.col("x"))).withColumn("z", F.when(F.col("run") % 23 > 0, F.col("z")))
    found = shrinkage.mahalanobis_without_group(r, "run", "sub", ["x", "y", "z"], F.col("run") % 3 < 2)
    return found.select("run", "sub", F.round("distance", 5).alias("distance"), F.round("weight", 5).alias("weight"))


@query("SELECT frame // 16 AS chunk, y, x, round(avg(v), 6) AS v, count(*) AS n FROM voxels GROUP BY ALL")
def src17_chunked_scan(spark, d):
    return catalog.chunk_means(voxels(spark, d), "frame", YX, "v", 16).select("chunk", *YX, F.round("v", 6).alias("v"), "n")


@query("""
WITH c AS (SELECT frame, sum(y * greatest(v, 0)) / nullif(sum(greatest(v, 0)), 0) AS cy, sum(x * greatest(v, 0)) / nullif(sum(greatest(v, 0)), 0) AS cx FROM voxels GROUP BY frame)
SELECT a.frame, round(a.cy - b.cy, 6) AS d_y, round(a.cx - b.cx, 6) AS d_x, round(sqrt(power(a.cy - b.cy, 2) + power(a.cx - b.cx, 2)), 6) AS length FROM c a JOIN c b ON a.frame = b.frame + 1
""")
def ts20_centre_of_mass(spark, d):
    return catalog.drift(voxels(spark, d), "frame", YX, "v").select("frame", *r6("d_y", "d_x", "length"))


@query("SELECT o_custkey AS unit, count(*) AS n_frames, round(max(o_totalprice), 2) AS depth FROM orders GROUP BY ALL HAVING count(*) <= 10 OR bool_or(o_orderpriority = '1-URGENT')")
def src7_snapshots(spark, d):
    g = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("unit")).agg(F.count("*").alias("n_frames"), F.round(F.max("o_totalprice"), 2).alias("depth"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("stack"))
    return g.where("n_frames <= 10 or stack").drop("stack")
