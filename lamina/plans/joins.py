"""Queries on record matching and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.operators import relational as rel
from lamina.operators.nearest import two_nearest
from lamina.operators.ranking import place
from lamina.plans.fixtures import hours, panel, points, query, r6, read


def _units(spark, d):
    """Orders of two priority classes as units and runs of a customer's session; key: order's item count."""
    n = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("key"))
    o = read(spark, d, "orders").join(n, "o_orderkey").withColumn("session", F.col("o_custkey"))
    u = o.where("o_orderpriority in ('1-URGENT', '2-HIGH')").select("session", F.col("o_orderkey").alias("unit"), "key", (F.col("o_orderkey") % 3).alias("hint"))
    r = o.where("o_orderpriority = '5-LOW'").select("session", F.col("o_orderkey").alias("run"), "key", (F.col("o_orderkey") % 3).alias("number"))
    return u, r


@query("""
WITH o AS (SELECT o_orderkey, o_custkey AS session, o_orderpriority AS pr, count(*) AS key FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
, u AS (SELECT session, o_orderkey AS unit, key, o_orderkey % 3 AS hint, count(*) OVER (PARTITION BY session, key) AS nu FROM o WHERE pr IN ('1-URGENT', '2-HIGH'))
, r AS (SELECT session, o_orderkey AS run, key, o_orderkey % 3 AS number, count(*) OVER (PARTITION BY session, key) AS nr FROM o WHERE pr = '5-LOW')
, ex AS (SELECT session, unit, run, 'fingerprint_exact' AS confidence FROM u JOIN r USING (session, key) WHERE nu = 1 AND nr = 1)
, hi AS (SELECT session, min(unit) AS unit, min(run) AS run, 'fingerprint+comment_run' AS confidence FROM u JOIN r USING (session, key) WHERE (nu > 1 OR nr > 1) AND hint = number GROUP BY session, key, hint)
, a AS (SELECT * FROM ex UNION ALL SELECT * FROM hi)
, lu AS (SELECT *, row_number() OVER (PARTITION BY session, key ORDER BY unit) AS i FROM u ANTI JOIN a USING (session, unit)), lr AS (SELECT *, row_number() OVER (PARTITION BY session, key ORDER BY run) AS i FROM r ANTI JOIN a USING (session, run))
, b AS (SELECT * FROM a UNION ALL SELECT lu.session, unit, run, 'fingerprint+order' FROM lu JOIN lr USING (session, key, i))
SELECT * FROM b UNION ALL SELECT session, unit, NULL, 'no_run' FROM u ANTI JOIN b USING (session, unit) UNION ALL SELECT session, NULL, run, 'no_unit' FROM r ANTI JOIN b USING (session, run)
""")
def join1_fingerprint(spark, d):
    return rel.fingerprint_match(*_units(spark, d))


DUR = """
WITH o AS (SELECT o_custkey AS session, o_orderkey AS id, o_orderpriority AS pr, o_totalprice / 100000 AS duration FROM orders)
, a AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY id) AS i, count(*) OVER (PARTITION BY session) AS n FROM o WHERE pr = '1-URGENT')
, b AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY id) AS i, count(*) OVER (PARTITION BY session) AS n FROM o WHERE pr = '5-LOW')
"""


def _durations(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("session"), "o_orderkey", "o_orderpriority", (F.col("o_totalprice") / 100000).alias("duration"))
    return o.where("o_orderpriority = '1-URGENT'").withColumnRenamed("o_orderkey", "a_id"), o.where("o_orderpriority = '5-LOW'").withColumnRenamed("o_orderkey", "b_id")


@query(DUR + ", z AS (SELECT a.session, a.id AS a_id, b.id AS b_id, bool_and(abs(a.duration - b.duration) < 1.5) OVER (PARTITION BY a.session) AS ok FROM a JOIN b ON a.session = b.session AND a.i = b.i AND a.n = b.n) SELECT session, a_id, b_id FROM z WHERE ok")
def join2_duration_fallback(spark, d):
    return rel.order_fallback(*_durations(spark, d))


@query(DUR + "SELECT a.session, a.id AS a_id, b.id AS b_id FROM a JOIN b USING (session) WHERE a.n = 1 AND b.n = 1")
def join3_elimination(spark, d):
    return rel.sole_leftovers(*_durations(spark, d))


def _ab(spark, d):
    p = points(spark, d)
    pick = lambda r, c: p.where(F.col("region") == r).select("user_id", F.col("s").alias(c)).distinct()
    return pick("purchase", "x"), pick("view", "y")


AB = "WITH a AS (SELECT DISTINCT user_id, s AS x FROM points WHERE region = 'purchase'), b AS (SELECT DISTINCT user_id, s AS y FROM points WHERE region = 'view') "


@query(AB + ", p AS (SELECT a.user_id, x, y FROM a JOIN b ON a.user_id = b.user_id AND y - x BETWEEN 0 AND 21600) SELECT user_id, x, y FROM p WHERE y = (SELECT min(q.y) FROM p q WHERE q.user_id = p.user_id AND q.x = p.x) AND x = (SELECT max(q.x) FROM p q WHERE q.user_id = p.user_id AND q.y = p.y)")
def join4_mutual_nearest(spark, d):
    a, b = _ab(spark, d)
    return rel.mutual_nearest(a, b, ["user_id"], "x", "y", 0, 21600)


@query(AB.replace("WITH", "WITH RECURSIVE", 1) + """
, c AS (SELECT a.user_id, y, list(x ORDER BY x DESC) AS xs, row_number() OVER (PARTITION BY a.user_id ORDER BY y) AS i FROM a JOIN b ON a.user_id = b.user_id AND y - x BETWEEN 0 AND 864000 GROUP BY a.user_id, y)
, s AS (
    SELECT user_id, i, y, xs[1] AS x, xs[1:1] AS taken FROM c WHERE i = 1
    UNION ALL
    SELECT user_id, i, y, free, CASE WHEN free IS NULL THEN taken ELSE list_append(taken, free) END
    FROM (SELECT c.user_id, c.i, c.y, s.taken, list_filter(c.xs, lambda v: NOT list_contains(s.taken, v))[1] AS free FROM s JOIN c ON c.user_id = s.user_id AND c.i = s.i + 1)
) SELECT user_id, x, y FROM s WHERE x IS NOT NULL
""")
def join4_greedy_pairs(spark, d):
    a, b = _ab(spark, d)
    return rel.greedy_pairs(a, b, ["user_id"], "x", "y", 0, 864000)


@query("""
WITH a AS (SELECT DISTINCT user_id, s FROM points WHERE region = 'error'), b AS (SELECT user_id, s, max(event_id) AS v FROM points WHERE region = 'view' GROUP BY ALL)
SELECT user_id, a.s, arg_min(v, struct_pack(far := abs(a.s - b.s), s := b.s)) AS v FROM a LEFT JOIN b USING (user_id) GROUP BY ALL
""")
def join5_nearest_donor(spark, d):
    p = points(spark, d)
    a = p.where("region = 'error'").select("user_id", "s").distinct()
    b = p.where("region = 'view'").groupBy("user_id", "s").agg(F.max("event_id").alias("v"))
    return rel.nearest_donor(a, b, ["user_id"], "s", "v")


@query("""
WITH k AS (SELECT c_custkey AS run, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer), m AS (SELECT o_custkey AS run, count(*) AS n FROM orders GROUP BY ALL)
SELECT run, place, n, 'ranked' AS kind FROM k LEFT JOIN m USING (run) UNION ALL SELECT s_suppkey, (SELECT max(place) FROM k) + row_number() OVER (ORDER BY s_suppkey), NULL, 'imaging_only' FROM supplier
""")
def join6_rank_append(spark, d):
    k = place(read(spark, d, "customer").select(F.col("c_custkey").alias("run"), "c_acctbal"), F.desc("c_acctbal"), "run").drop("c_acctbal")
    m = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.count("*").alias("n"))
    extra = place(read(spark, d, "supplier").select(F.col("s_suppkey").alias("run")), "run", name="i").join(F.broadcast(k.agg(F.max("place").alias("top"))))
    extra = extra.select("run", (F.col("top") + F.col("i")).alias("place"), F.lit("imaging_only").alias("kind"))
    return k.join(m, "run", "left").withColumn("kind", F.lit("ranked")).unionByName(extra, allowMissingColumns=True)


@query("""
WITH a AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY ALL), b AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY ALL)
SELECT coalesce(a.k, b.k) AS k, customers, suppliers, CASE WHEN suppliers IS NULL THEN 'no_supplier' WHEN customers IS NULL THEN 'no_customer' ELSE 'matched' END AS status FROM a FULL JOIN b ON a.k = b.k
""")
def join7_retention(spark, d):
    a = read(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = read(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "k", "full_outer").withColumn("status", F.when(F.col("suppliers").isNull(), "no_supplier").when(F.col("customers").isNull(), "no_customer").otherwise("matched"))


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def join8_dimension(spark, d):
    c, n, r = (read(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("c_custkey", "n_name", "r_name")


@query(AB + ", p AS (SELECT a.user_id, x, y, row_number() OVER (PARTITION BY a.user_id, x ORDER BY abs(y - x), y) AS i FROM a JOIN b ON a.user_id = b.user_id AND abs(y - x) <= 7200) SELECT user_id, x, y, y - x AS dt FROM p WHERE i = 1 AND y <> x")
def join11_nearest_event(spark, d):
    a, b = _ab(spark, d)
    return rel.nearest_event(a, b, ["user_id"], "x", "y", 7200)


@query("""
WITH w AS (SELECT DISTINCT o_custkey AS owner, l_partkey AS thing FROM orders JOIN lineitem ON l_orderkey = o_orderkey), a AS (SELECT *, row_number() OVER (PARTITION BY thing ORDER BY owner) AS i FROM w)
, b AS (SELECT owner, thing, row_number() OVER (PARTITION BY owner ORDER BY thing) AS j FROM a WHERE i = 1), one AS (SELECT owner, thing, 1 AS phase FROM b WHERE j = 1)
, rest AS (SELECT * FROM w ANTI JOIN one USING (owner) ANTI JOIN (SELECT thing FROM one) q USING (thing)), c AS (SELECT *, row_number() OVER (PARTITION BY thing ORDER BY owner) AS i FROM rest), e AS (SELECT owner, thing, row_number() OVER (PARTITION BY owner ORDER BY thing) AS j FROM c WHERE i = 1)
SELECT * FROM one UNION ALL SELECT owner, thing, 2 FROM e WHERE j = 1
""")
def join12_claims(spark, d):
    o = read(spark, d, "orders").join(read(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    w = o.select(F.col("o_custkey").alias("owner"), F.col("l_partkey").alias("thing")).distinct().withColumn("place", F.lit(0))
    return rel.claim_once(w, "owner", "thing", "place")


@query("""
WITH p AS (SELECT unnest([0, 1, 2, 3]) AS i), s AS (SELECT a.vec_id AS key, b.vec_id AS candidate, avg(abs(CAST(a.embedding[1 + 16 * i] AS DOUBLE) - CAST(b.embedding[1 + 16 * i] AS DOUBLE))) AS score
 FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id JOIN p ON true GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, candidate) AS r FROM s)
SELECT key, max(candidate) FILTER (r = 1) AS candidate, round(max(score) FILTER (r = 1), 6) AS best, round(max(score) FILTER (r = 2), 6) AS runner_up, coalesce(max(score) FILTER (r = 2) < 5 * max(score) FILTER (r = 1), false) AS weak FROM k WHERE r <= 2 GROUP BY key
""")
def join13_shape_match(spark, d):
    probes = [F.get("embedding", F.lit(16 * i)).cast("double").alias(f"p{i}") for i in range(4)]
    s = two_nearest(read(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "label", *probes), "key", "label", [f"p{i}" for i in range(4)])
    out = rel.best_and_runner_up(s, "key", "candidate", "score")
    return out.select("key", "candidate", *r6("best", "runner_up"), "weak")


@query("SELECT l_partkey AS part, count(DISTINCT l_suppkey) AS owners FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey) > 1")
def join14_shared_owner(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.count_distinct("l_suppkey").alias("owners")).where("owners > 1")


@query("""
WITH s AS (SELECT t, f FROM panel WHERE region = 'error'), g AS (SELECT unnest(range(min(t), max(t) + 1)) + 0.5 AS t FROM panel), a AS (SELECT g.t, (SELECT max(t) FROM s WHERE s.t <= g.t) AS pt, (SELECT min(t) FROM s WHERE s.t >= g.t) AS nt FROM g)
SELECT CAST(a.t AS DOUBLE) AS t, round(CASE WHEN pt IS NULL THEN q.f WHEN nt IS NULL OR pt = nt THEN p.f ELSE p.f + (q.f - p.f) * (a.t - pt) / (nt - pt) END, 6) AS f FROM a LEFT JOIN s p ON p.t = pt LEFT JOIN s q ON q.t = nt
""")
def join15_interpolate(spark, d):
    s = panel(spark, d).where("region = 'error'").select("region", F.col("t").cast("double").alias("t"), "f")
    g = hours(spark, d).select(F.lit("error").alias("region"), (F.col("t") + 0.5).cast("double").alias("t"))
    return rel.interpolate_at(s, g, ["region"], "t", "f").select("t", F.round("f", 6).alias("f"))


@query("""
WITH s AS (SELECT s, value FROM points WHERE region = 'error'), g AS (SELECT unnest(range(min(t), max(t) + 1)) * 3600 + 1800 AS t FROM panel)
SELECT t, round(coalesce(sum(value), 0) / greatest(count(value), 1), 6) AS v FROM g LEFT JOIN s ON s >= t - 1800 AND s < t + 1800 GROUP BY t
""")
def join16_range_average(spark, d):
    s = points(spark, d).where("region = 'error'").select("region", F.col("s").alias("t"), F.col("value").alias("v"))
    g = hours(spark, d).select(F.lit("error").alias("region"), (F.col("t") * 3600 + 1800).alias("t"))
    return rel.range_average(s, g, ["region"], "t", "v", 1800).select("t", F.round("v", 6).alias("v"))


@query("""
WITH b AS (SELECT region, (min(f) + max(f)) / 2 AS level FROM panel GROUP BY region), l AS (SELECT *, lag(f) OVER (PARTITION BY region ORDER BY t) AS p FROM panel)
, e AS (SELECT region, t, (row_number() OVER (PARTITION BY region ORDER BY t) - 1) // 3 AS k FROM l JOIN b USING (region) WHERE f > level AND p <= level)
SELECT region, k, (min(t) + max(t)) / 2 AS mid FROM e GROUP BY ALL HAVING count(*) = 3
""")
def join17_pulses(spark, d):
    return rel.pulses_to_volumes(panel(spark, d), ["region"], "t", "f", 3)


@query("SELECT ps.l_orderkey AS run, ps.l_linenumber AS region, p_retailprice AS metric FROM lineitem ps JOIN part ON p_partkey = l_partkey WHERE l_quantity > 45")
def join18_lookup(spark, d):
    return read(spark, d, "lineitem").where("l_quantity > 45").join(read(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("region"), F.col("p_retailprice").alias("metric"))


@query("SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def prj12_set_aside(spark, d):
    x = read(spark, d, "labels")
    return x.join(x.where("toxic = 1").select("doc_id"), "doc_id", "left_anti").select("doc_id", "quality")


@query("SELECT event_id FROM events WHERE lower(event_type) NOT IN ('error', 'click')")
def prj11_ignore_list(spark, d):
    ignored = spark.createDataFrame([("Error",), ("Click",)], "name string").select(F.lower("name").alias("k"))
    return read(spark, d, "events").withColumn("k", F.lower("event_type")).join(F.broadcast(ignored), "k", "left_anti").select("event_id")


@query("SELECT user_id, event_type AS mark, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i = 1 AND event_type <> 'error'")
def x27_upsert(spark, d):
    last = rel.keep_latest(read(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return last.where("event_type <> 'error'").select("user_id", F.col("event_type").alias("mark"), "event_id")


@query("SELECT s_suppkey, coalesce(s.v, n.v, r.v) AS voxel FROM supplier LEFT JOIN (SELECT l_suppkey AS k, max(l_quantity) AS v FROM lineitem WHERE l_discount > 0.09 AND l_tax > 0.07 GROUP BY ALL) s ON s.k = s_suppkey LEFT JOIN (SELECT c_nationkey AS k, max(c_acctbal) AS v FROM customer GROUP BY ALL HAVING count(DISTINCT c_mktsegment) = 1) n ON n.k = s_nationkey LEFT JOIN (SELECT n_nationkey AS k, CAST(n_regionkey AS DOUBLE) AS v FROM nation) r ON r.k = s_nationkey")
def x5_fallback_chain(spark, d):
    s = read(spark, d, "lineitem").where("l_discount > 0.09 and l_tax > 0.07").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max("l_quantity").alias("a"))
    n = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.max("c_acctbal").alias("b"), F.count_distinct("c_mktsegment").alias("k")).where("k = 1").drop("k")
    r = read(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").cast("double").alias("c"))
    return read(spark, d, "supplier").join(s, "s_suppkey", "left").join(n, "s_nationkey", "left").join(r, "s_nationkey", "left").select("s_suppkey", F.coalesce("a", "b", "c").alias("voxel"))
