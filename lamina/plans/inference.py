"""Queries on inference over hierarchical data and on learned models."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.operators import learn, series, stats
from lamina.plans.fixtures import panel, points, query, r6, read, runs, voxels


def _rank(c: str, part: str) -> str:
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {part}, {c}) - 1) / 2.0)"


@query("""
WITH t AS (SELECT o_orderpriority AS fam, o_orderkey AS k, CAST((o_orderkey * 7919) % 10007 AS DOUBLE) / 10007 AS p FROM orders)
, r AS (SELECT *, p * count(*) OVER (PARTITION BY fam) / row_number() OVER (PARTITION BY fam ORDER BY p, k) AS raw FROM t)
SELECT k, round(least(1.0, min(raw) OVER (PARTITION BY fam ORDER BY p DESC, k DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r
""")
def st1_benjamini_hochberg(spark, d):
    t = read(spark, d, "orders").select(F.col("o_orderpriority").alias("fam"), F.col("o_orderkey").alias("k"), ((F.col("o_orderkey") * 7919) % 10007 / 10007).alias("p"))
    return stats.benjamini_hochberg(t, "p", ["fam"], "k").select("k", F.round("q", 6).alias("q"))


@query("""
WITH m AS (SELECT grp, sub, avg(y) - 150000 AS d FROM runs GROUP BY ALL)
, r AS (SELECT grp, d, rank() OVER (PARTITION BY grp ORDER BY abs(d)) AS r, CAST(row_number() OVER (PARTITION BY grp ORDER BY abs(d)) - 1 AS INT) AS i FROM m WHERE d <> 0)
, g AS (SELECT grp, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS w FROM r GROUP BY grp)
, s AS (SELECT grp, k, sum(CASE WHEN (k >> i) & 1 = 1 THEN r ELSE 0 END) AS v FROM r JOIN g USING (grp) JOIN (SELECT CAST(unnest(range(0, 32768)) AS INT) AS k) ON k < (1 << CAST(n AS INT)) GROUP BY ALL)
SELECT grp, n, CAST(w AS DOUBLE) AS w, round(avg(CAST(v >= w AS INT)), 6) AS p_greater, round(least(1.0, 2 * least(avg(CAST(v >= w AS INT)), avg(CAST(v <= w AS INT)))), 6) AS p_two FROM s JOIN g USING (grp) GROUP BY ALL
""")
def st2_signed_rank(spark, d):
    m = runs(spark, d).groupBy("grp", "sub").agg((F.avg("y") - 150000).alias("d"))
    return stats.signed_rank(m, ["grp"], "d").select("grp", "n", "w", *r6("p_greater", "p_two"))


@query(f"""
WITH c AS (SELECT grp, count(*) AS n, corr(a, b) AS rho FROM (SELECT grp, {_rank('x', 'grp')} AS a, {_rank('y', 'grp')} AS b FROM runs) GROUP BY grp)
, m AS (SELECT *, n % 2 = 1 AS odd, 1 - rho * rho AS c2, CAST(floor((CASE WHEN n % 2 = 1 THEN n - 3 ELSE n - 2 END) / 2) AS INT) AS m FROM c)
, s AS (SELECT *, coalesce(list_sum(list_transform(range(0, m), lambda k: CASE WHEN odd THEN exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5)) * pow(c2, k + 0.5) ELSE exp(lgamma(k + 0.5) - lgamma(k + 1) - lgamma(0.5)) * pow(c2, k) END)), 0) AS s FROM m)
SELECT grp, n, round(rho, 6) AS rho, CASE WHEN n >= 3 THEN round(greatest(0.0, 1 - CASE WHEN odd THEN 2 / pi() * (asin(abs(rho)) + abs(rho) * s) ELSE abs(rho) * s END), 6) END AS p FROM s
""")
def st4_spearman(spark, d):
    return stats.spearman(runs(spark, d), ["grp"], "x", "y").select("grp", "n", *r6("rho", "p"))


# The two-sided p of a correlation rho with m - 2 degrees of freedom, from rows c.
P_OF_RHO = """
, m AS (SELECT *, m % 2 = 1 AS odd, 1 - rho * rho AS c2, CAST(floor((CASE WHEN m % 2 = 1 THEN m - 3 ELSE m - 2 END) / 2) AS INT) AS terms FROM c)
, s AS (SELECT *, coalesce(list_sum(list_transform(range(0, terms), lambda k: CASE WHEN odd THEN exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5)) * pow(c2, k + 0.5) ELSE exp(lgamma(k + 0.5) - lgamma(k + 1) - lgamma(0.5)) * pow(c2, k) END)), 0) AS s FROM m)
, p AS (SELECT *, CASE WHEN m >= 3 THEN round(greatest(0.0, 1 - CASE WHEN odd THEN 2 / pi() * (asin(abs(rho)) + abs(rho) * s) ELSE abs(rho) * s END), 6) END AS p FROM s)
"""


@query(f"""
WITH r AS (SELECT grp, {_rank('x', 'grp')} AS x, {_rank('y', 'grp')} AS y, {_rank('z', 'grp')} AS z FROM runs), a AS (SELECT grp, count(*) AS n, corr(x, y) AS a, corr(x, z) AS b, corr(y, z) AS c FROM r GROUP BY grp)
, c AS (SELECT grp, n, n - 1 AS m, (a - b * c) / sqrt((1 - b * b) * (1 - c * c)) AS rho FROM a){P_OF_RHO}
SELECT grp, n, round(rho, 6) AS rho, p FROM p
""")
def st4_partial_spearman(spark, d):
    return stats.partial_spearman(runs(spark, d), ["grp"], "x", "y", "z").select("grp", "n", *r6("rho", "p"))


@query(f"""
WITH r AS (SELECT sub, {_rank('x', 'sub')} AS a, {_rank('y', 'sub')} AS b, count(*) OVER (PARTITION BY sub) AS n FROM runs), e AS (SELECT sub, a - avg(a) OVER (PARTITION BY sub) AS a, b - avg(b) OVER (PARTITION BY sub) AS b FROM r WHERE n >= 2)
, c AS (SELECT count(*) AS n, count(*) - count(DISTINCT sub) + 1 AS m, corr(a, b) AS rho FROM e){P_OF_RHO}
SELECT n, round(rho, 6) AS rho, p FROM p
""")
def st4_within_spearman(spark, d):
    return stats.within_group_spearman(runs(spark, d), "sub", "x", "y").select("n", *r6("rho", "p"))


@query()
def st13_stouffer(spark, d):
    p = runs(spark, d).select("sub", ((F.col("run") % 97 + 1) / 98).alias("p"), F.col("n_orders").alias("w"))
    return stats.stouffer_combined(p, ["sub"], "p", "w").select("sub", "k", *r6("z", "p"))


@query()
def st3_by_size(spark, d):
    """Small groups have an exact p, large or tied ones a normal one."""
    x = runs(spark, d).withColumn("d", F.when(F.col("grp") == 0, F.round(F.col("x") / 1000)).otherwise(F.col("x") - 4000))
    return stats.paired_signed_rank(x, ["sub"], "d").select("sub", "n", "w", F.round("p", 6).alias("p"), "method")


@query("""
WITH g AS (SELECT sub, count(*) AS n, count(*) FILTER (y > 150000) AS k FROM runs GROUP BY sub)
SELECT sub, n, k, round(least(1.0, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5)))), 6) AS p FROM (SELECT *, unnest(range(k, n + 1)) AS i FROM g) GROUP BY ALL
""")
def st5_sign_test(spark, d):
    g = runs(spark, d).groupBy("sub").agg(F.count("*").alias("n"), F.sum((F.col("y") > 150000).cast("int")).alias("k"))
    return g.select("sub", "n", "k", F.round(stats.binomial_tail(F.col("k"), F.col("n")), 6).alias("p"))


@query("SELECT grp, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 4) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM runs GROUP BY grp")
def st6_slope(spark, d):
    return runs(spark, d).groupBy("grp").agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 4).alias("intercept"), F.round(F.regr_r2("y", "x"), 6).alias("r2"))


@query("SELECT a.sub, round(median((b.y - a.y) / (b.x - a.x)), 6) AS slope, count(*) AS pairs FROM runs a JOIN runs b ON a.sub = b.sub AND b.x > a.x GROUP BY a.sub")
def st7_theil_sen(spark, d):
    return stats.theil_sen(runs(spark, d), ["sub"], "x", "y").select("sub", F.round("slope", 6).alias("slope"), "pairs")


@query()
def st8_cluster_bootstrap(spark, d):
    return stats.cluster_bootstrap(runs(spark, d), "sub", "y", 500)


@query()
def st9_bootstrap(spark, d):
    return stats.iid_bootstrap(runs(spark, d).groupBy("grp", "sub").agg(F.avg("y").alias("y")), ["grp"], "y", 500)


@query("""
WITH a AS (SELECT DISTINCT user_id, s // 21600 AS a FROM points WHERE region = 'purchase'), b AS (SELECT DISTINCT user_id, s // 21600 AS b FROM points WHERE region = 'view'), n AS (SELECT user_id, count(*) AS n FROM a GROUP BY ALL)
, o AS (SELECT user_id, count(DISTINCT a) AS h FROM a JOIN b USING (user_id) WHERE abs(a - b) <= 1 GROUP BY ALL), t AS (SELECT unnest(range(5, 115)) AS shift)
, z AS (SELECT user_id, shift, count(DISTINCT a) AS c FROM a JOIN b USING (user_id) JOIN t ON (a - b - shift + 241) % 120 <= 2 GROUP BY ALL)
, e AS (SELECT n.user_id, n, 1 - coalesce(h, 0) / n AS observed, 1 - coalesce(c, 0) / n AS frac FROM n CROSS JOIN t LEFT JOIN o ON o.user_id = n.user_id LEFT JOIN z ON z.user_id = n.user_id AND z.shift = t.shift)
SELECT user_id, n, round(observed, 6) AS observed, round(avg(frac), 6) AS null_mean, round((1 + count(*) FILTER (frac <= observed + 1e-12)) / 111, 6) AS p FROM e GROUP BY ALL
""")
def st10_shift_null(spark, d):
    p = points(spark, d).withColumn("t", F.floor(F.col("s") / 21600))
    out = stats.shift_null(p.where("region = 'purchase'"), p.where("region = 'view'"), ["user_id"], "t", 120, 1, 5)
    return out.select("user_id", "n", *r6("observed", "null_mean", "p"))


@query()
def st11_phase_null(spark, d):
    p = panel(spark, d).where("region in ('view', 'click')").groupBy("t").pivot("region", ["view", "click"]).agg(F.first("f")).where("view is not null and click is not null")
    return learn.phase_null(p.withColumn("run", F.lit(1)), ["run"], "t", "view", "click", 200).select("run", *r6("observed", "p"))


@query()
def st12_permutation(spark, d):
    return stats.permutation_test(runs(spark, d), "sub", "x", "y", 200)


@query("""
WITH g AS (SELECT sub, count(*) AS k, sum(-ln(CAST(run % 97 + 1 AS DOUBLE) / 98)) AS h FROM runs GROUP BY sub)
SELECT sub, CAST(k AS INT) AS k, round(2 * h, 6) AS chi2, round(least(1.0, sum(exp(i * ln(h) - h - lgamma(i + 1)))), 6) AS p FROM (SELECT *, unnest(range(0, k)) AS i FROM g) GROUP BY sub, k, h
""")
def st13_fisher(spark, d):
    p = runs(spark, d).select("sub", ((F.col("run") % 97 + 1) / 98).alias("p"))
    return stats.fisher_combined(p, ["sub"], "p").select("sub", "k", *r6("chi2", "p"))


@query("""
WITH s AS (SELECT sub, CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM (SELECT sub, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM runs) GROUP BY sub)
, k AS (SELECT CAST(0 AS DOUBLE) AS ratio UNION ALL SELECT pow(10, -4 + 7 * i / 140.0) FROM (SELECT unnest(range(141)) AS i))
, a AS (SELECT ratio, sum(n - k * n * n) AS a, sum(sx - k * n * sx) AS b, sum(xx - k * sx * sx) AS c, sum(sy - k * n * sy) AS u, sum(xy - k * sx * sy) AS v, sum(yy - k * sy * sy) AS q, sum(n) AS total, sum(ln(1 + n * ratio)) AS logdet
    FROM (SELECT *, ratio / (1 + n * ratio) AS k FROM s, k) GROUP BY ratio)
, f AS (SELECT *, (a * v - b * u) / (a * c - b * b) AS slope, (c * u - b * v) / (a * c - b * b) AS intercept FROM a)
, l AS (SELECT *, -0.5 * (total * ln(2 * pi() * (q - intercept * u - slope * v) / total) + total + logdet) AS ll, -0.5 * (total * ln(2 * pi() * (q - u * u / a) / total) + total + logdet) AS l0 FROM f)
SELECT round(arg_max(slope, ll), 6) AS slope, round(arg_max(intercept, ll), 4) AS intercept, round(arg_max(ratio, ll), 6) AS ratio, round(max(ll), 4) AS loglik, round(greatest(0.0, 2 * (max(ll) - max(l0))), 4) AS lr FROM l
""")
def st14_random_intercept(spark, d):
    out = stats.random_intercept(runs(spark, d), "sub", "x", "y")
    return out.select(*r6("slope", "ratio"), *[F.round(c, 4).alias(c) for c in ("intercept", "loglik", "lr")])


@query("""
WITH m AS (SELECT sub, run, y, median(y) OVER (PARTITION BY sub) AS med FROM runs), a AS (SELECT *, median(abs(y - med)) OVER (PARTITION BY sub) AS mad FROM m)
SELECT run, round(med, 6) AS med, round(mad, 6) AS mad, y > med + 4 * mad AS outlier FROM a
""")
def st16_mad_outliers(spark, d):
    return stats.mad_outliers(runs(spark, d), ["sub"], "y").select("run", *r6("med", "mad"), "outlier")


@query("WITH m AS (SELECT sub, avg(y) AS m FROM runs GROUP BY sub) SELECT sub, round((sum(m) OVER () - m) / nullif(count(*) OVER () - 1, 0), 6) AS without FROM m")
def st17_leave_one_out(spark, d):
    return stats.leave_one_out(runs(spark, d), "sub", "y").select("sub", F.round("without", 6).alias("without"))


@query("""
WITH g AS (SELECT sub, count(*) AS n, count(*) FILTER (y > 150000) / count(*) AS p FROM runs GROUP BY sub), h AS (SELECT *, 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n)) AS half FROM g)
SELECT sub, round((p + 1.9208 / n - half) / (1 + 3.8416 / n), 6) AS lo, round((p + 1.9208 / n + half) / (1 + 3.8416 / n), 6) AS hi FROM h
""")
def st18_wilson(spark, d):
    g = runs(spark, d).groupBy("sub").agg(F.count("*").alias("n"), F.sum((F.col("y") > 150000).cast("int")).alias("k"))
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return g.select("sub", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query("""
WITH v AS (SELECT y, x, avg(v) AS m, var_pop(v) AS s FROM voxels GROUP BY ALL)
SELECT round(regr_slope(s, m), 6) AS slope, round(regr_intercept(s, m), 6) AS intercept, round(regr_r2(s, m), 6) AS r2 FROM v
""")
def st19_noise_fit(spark, d):
    v = voxels(spark, d).groupBy("y", "x").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    return v.agg(F.round(F.regr_slope("s", "m"), 6).alias("slope"), F.round(F.regr_intercept("s", "m"), 6).alias("intercept"), F.round(F.regr_r2("s", "m"), 6).alias("r2"))


PAIRS = "WITH c AS (SELECT a.region AS a, b.region AS b, corr(a.f, b.f) AS r, count(*) AS n FROM panel a JOIN panel b ON a.t = b.t AND a.region < b.region GROUP BY ALL) "


def _pairs(spark, d):
    p = panel(spark, d)
    q = p.select(F.col("region").alias("b"), "t", F.col("f").alias("g"))
    return p.join(q, "t").where("region < b").groupBy(F.col("region").alias("a"), "b").agg(F.corr("f", "g").alias("r"), F.count("*").alias("n"))


@query(PAIRS + "SELECT a, b, round(r, 6) AS r, n FROM c")
def agg11_correlation_matrix(spark, d):
    return _pairs(spark, d).select("a", "b", F.round("r", 6).alias("r"), "n")


@query(PAIRS + "SELECT round(avg(r) FILTER (length(a) % 2 = length(b) % 2) - avg(r) FILTER (length(a) % 2 <> length(b) % 2), 6) AS separation FROM c")
def agg12_separation(spark, d):
    same = F.length("a") % 2 == F.length("b") % 2
    return _pairs(spark, d).agg(F.round(F.avg(F.when(same, F.col("r"))) - F.avg(F.when(~same, F.col("r"))), 6).alias("separation"))


def _labelled(spark, d):
    return read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id")


LABELLED = "WITH l AS (SELECT doc_id, quality, n_chars, lang FROM labels JOIN documents USING (doc_id)) "


@query(LABELLED + f", r AS (SELECT lang, quality, {_rank('n_chars', 'lang')} AS r FROM l), g AS (SELECT lang, sum(r) FILTER (quality = 1) AS s, count(*) FILTER (quality = 1) AS np, count(*) FILTER (quality <> 1) AS nn FROM r GROUP BY lang) SELECT lang, round((s - np * (np + 1) / 2) / nullif(np * nn, 0), 6) AS auc, np, nn FROM g")
def ml6_auc(spark, d):
    return learn.roc_auc(_labelled(spark, d), ["lang"], "n_chars", F.col("quality") == 1).select("lang", F.round("auc", 6).alias("auc"), "np", "nn")


@query(LABELLED + "SELECT CAST(cut AS DOUBLE) AS cut, count(*) FILTER (n_chars >= cut AND quality = 1) AS tp, count(*) FILTER (n_chars >= cut AND quality <> 1) AS fp, count(*) FILTER (n_chars < cut AND quality = 1) AS fn, count(*) FILTER (n_chars < cut AND quality <> 1) AS tn FROM l, (SELECT unnest([500, 1000, 2000]) AS cut) GROUP BY cut")
def ml7_confusion(spark, d):
    return learn.confusion(_labelled(spark, d), "n_chars", F.col("quality") == 1, [500, 1000, 2000])


@query("""
WITH c AS (SELECT label AS a, vec_id % 3 AS b, count(*) AS n FROM embeddings GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2) AS ij, sum(n) AS n FROM c)
, i AS (SELECT sum(m * (m - 1) / 2) AS i FROM (SELECT sum(n) AS m FROM c GROUP BY a)), j AS (SELECT sum(m * (m - 1) / 2) AS j FROM (SELECT sum(n) AS m FROM c GROUP BY b))
SELECT round((ij - i * j / (n * (n - 1) / 2)) / nullif((i + j) / 2 - i * j / (n * (n - 1) / 2), 0), 6) AS ari FROM s, i, j
""")
def ml2_adjusted_rand(spark, d):
    e = read(spark, d, "embeddings").select("label", (F.col("vec_id") % 3).alias("other"))
    return learn.adjusted_rand(e, "label", "other").select(F.round("ari", 6).alias("ari"))


@query()
def ml2_cofiring_groups(spark, d):
    return learn.correlation_groups(panel(spark, d).withColumn("run", F.lit(1)), ["run"], "region", "t", "f", 0.05)


@query()
def ml1_nmf(spark, d):
    e = read(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return learn.nmf_labels(e, ["label"], "vec_id", "v", k=3, steps=60)


@query()
def ml4_leave_group_out(spark, d):
    return learn.leave_group_out(_labelled(spark, d), "lang", "quality", ["n_chars"]).select("lang", "quality", F.round("score", 6).alias("score"))


@query(f"""
WITH f AS (SELECT toxic, unnest([{{'feature': 'n_chars', 'v': CAST(n_chars AS DOUBLE)}}, {{'feature': 'quality', 'v': CAST(quality AS DOUBLE)}}, {{'feature': 'doc_id', 'v': CAST(doc_id AS DOUBLE)}}], recursive := true) FROM labels JOIN documents USING (doc_id))
, r AS (SELECT feature, toxic, {_rank('v', 'feature')} AS r FROM f), g AS (SELECT feature, sum(r) FILTER (toxic = 1) AS s, count(*) FILTER (toxic = 1) AS np, count(*) FILTER (toxic <> 1) AS nn FROM r GROUP BY feature)
, a AS (SELECT feature, (s - np * (np + 1) / 2) / nullif(np * nn, 0) AS auc FROM g)
SELECT feature, round(auc, 6) AS auc FROM a ORDER BY greatest(auc, 1 - auc) DESC, feature LIMIT 2
""")
def ml5_top_features(spark, d):
    x = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return learn.top_features(x, "toxic", ["n_chars", "quality", "doc_id"], 2).select("feature", F.round("auc", 6).alias("auc"))


@query()
def ml8_badness(spark, d):
    x = runs(spark, d).groupBy("sub", "grp").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), F.stddev_pop("y").alias("sd"))
    return learn.badness(x, "sub", "grp", {"x": 1, "y": -1, "z": -1, "sd": 1}).select("sub", "grp", F.round("badness", 6).alias("badness"), "reasons")


@query("SELECT frame, y, x, round(percent_rank() OVER (PARTITION BY frame, x ORDER BY v), 6) AS rank01, round(v / nullif(max(v) OVER (PARTITION BY frame, x), 0), 6) AS of_max FROM voxels")
def ml10_column_rank(spark, d):
    return learn.column_rank(voxels(spark, d), ["frame", "x"], "v").select("frame", "y", "x", *r6("rank01", "of_max"))


@query("SELECT region, round(avg(f), 6) AS mean, round(stddev_samp(f), 6) AS sd, round(max(z), 6) AS top FROM (SELECT *, (f - avg(f) OVER (PARTITION BY region)) / nullif(stddev_samp(f) OVER (PARTITION BY region), 0) AS z FROM panel) GROUP BY region")
def x11_common_scale(spark, d):
    return series.centred(panel(spark, d), ["region"], "f", 1).groupBy("region").agg(*[F.round(v, 6).alias(k) for k, v in (("mean", F.avg("f")), ("sd", F.stddev_samp("f")), ("top", F.max("z")))])


@query("SELECT d.doc_id, CASE WHEN toxic = 1 THEN 1 WHEN toxic = 0 THEN 0 END AS weak, CASE WHEN l.doc_id IS NULL THEN 'other' WHEN quality = 1 THEN 'curated' ELSE 'screening' END AS kind FROM documents d LEFT JOIN labels l USING (doc_id)")
def x8_weak_labels(spark, d):
    l = read(spark, d, "labels").withColumn("known", F.lit(True))
    x = read(spark, d, "documents").select("doc_id").join(l, "doc_id", "left")
    return x.select("doc_id", F.when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 0).alias("weak"), F.when(F.col("known").isNull(), "other").when(F.col("quality") == 1, "curated").otherwise("screening").alias("kind"))
