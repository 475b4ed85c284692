"""Queries on traces and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.operators import catalog
from lamina.operators import events as ev
from lamina.operators import learn, series
from lamina.operators.relational import band_join
from lamina.plans.fixtures import hours, panel, points, query, r6, read

R = ["region"]


def _wide(spark, d):
    return panel(spark, d).groupBy("t").pivot("region", ["click", "error", "purchase", "signup", "view"]).agg(F.first("f"))


def _hours(spark, d) -> int:
    """Hours from the first event to the last: one number."""
    return hours(spark, d).count()


WIDE = "SELECT t, max(f) FILTER (region = 'click') AS click, max(f) FILTER (region = 'error') AS error, max(f) FILTER (region = 'purchase') AS purchase, max(f) FILTER (region = 'signup') AS signup, max(f) FILTER (region = 'view') AS view FROM panel GROUP BY t"


@query("""
WITH pairs AS (SELECT a.region AS a, b.region AS b, count(*) AS n, corr(a.dff, b.dff) AS r FROM dffs a JOIN dffs b ON a.t = b.t AND a.region < b.region GROUP BY ALL)
SELECT a, b, n, round(r, 6) AS r, row_number() OVER (ORDER BY r DESC, a, b) AS place FROM pairs
""")
def panel_correlation(spark, d):
    x = series.dff(panel(spark, d), R).select("region", "t", "dff")
    y = x.select(F.col("region").alias("b"), "t", F.col("dff").alias("other"))
    pairs = x.join(y, "t").where("region < b").groupBy(F.col("region").alias("a"), "b").agg(F.count("*").alias("n"), F.corr("dff", "other").alias("r"))
    return pairs.select("a", "b", "n", F.round("r", 6).alias("r"), F.row_number().over(Window.orderBy(F.desc("r"), "a", "b")).alias("place"))


@query("SELECT region, t, round(f0, 6) AS f0, round(dff, 6) AS dff, round((f - f0) / CASE WHEN f0 = 0 THEN 1 ELSE f0 END, 6) AS or_one, round((f - f0) / greatest(abs(f0), 1e-6), 6) AS abs_floor, round((f - f0) / (abs(f0) + 1e-6), 6) AS abs_plus FROM dffs")
def ts1_dff(spark, d):
    x = series.dff(panel(spark, d), R)
    den = lambda how: F.round((F.col("f") - F.col("f0")) / series.robust_denominator(F.col("f0"), how), 6).alias(how)
    return x.select("region", "t", *r6("f0", "dff"), den("or_one"), den("abs_floor"), den("abs_plus"))


@query("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY t) AS i FROM panel), a AS (SELECT region, list(f ORDER BY i) AS x FROM n GROUP BY region)
, c AS (SELECT region, x, i, x[i] AS v FROM (SELECT region, x, unnest(range(2, len(x))) AS i FROM a) WHERE x[i] > x[i - 1] AND x[i] > x[i + 1])
, e AS (SELECT *, coalesce(list_max(list_filter(range(1, i), lambda k: x[k] > v)), 0) AS l, coalesce(list_min(list_filter(range(i + 1, len(x) + 1), lambda k: x[k] > v)), len(x) + 1) AS r FROM c)
SELECT region, i, round(v, 6) AS f, round(v - greatest(list_min(x[l + 1 : i]), list_min(x[i : r - 1])), 6) AS prominence FROM e
""")
def ts2_prominence(spark, d):
    return ev.prominences(panel(spark, d), R).select("region", "i", F.round("f", 6).alias("f"), F.round("prominence", 6).alias("prominence"))


@query()
def ts2_peaks(spark, d):
    return ev.detect_peaks(panel(spark, d), R)


@query("""
WITH m AS (SELECT region, median(f) AS med FROM panel GROUP BY region), s AS (SELECT region, any_value(med) AS med, median(abs(f - med)) AS mad FROM panel JOIN m USING (region) GROUP BY region)
, n AS (SELECT *, lag(f) OVER w AS p, lead(f) OVER w AS q FROM panel WINDOW w AS (PARTITION BY region ORDER BY t))
SELECT region, t, round(f, 6) AS f FROM n JOIN s USING (region) WHERE f > p AND f > q AND f >= med + 1.5 * 1.4826 * mad
""")
def ts3_threshold_peaks(spark, d):
    x = series.add_group(panel(spark, d), R, med=F.median("f")).withColumn("dev", F.abs(F.col("f") - F.col("med")))
    cut = series.add_group(x, R, mad=F.median("dev")).select("region", "t", (F.col("med") + 1.5 * 1.4826 * F.col("mad")).alias("cut"))
    return ev.peak_candidates(panel(spark, d), R).join(cut, ["region", "t"]).where("f >= cut").select("region", "t", F.round("f", 6).alias("f"))


@query()
def ts4_noise_gated_peaks(spark, d):
    x = panel(spark, d)
    noise = series.robust_noise(x, R).withColumn("need", 3 * F.col("noise"))
    return ev.detect_peaks(x.join(noise, "region"), R, share=None, prominence="need")




@query("""
WITH g AS (SELECT user_id, region, s, 1 + sum(CASE WHEN gap > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s RANGE UNBOUNDED PRECEDING) AS net
    FROM (SELECT *, s - lag(s) OVER (PARTITION BY user_id ORDER BY s) AS gap FROM points))
, p AS (SELECT user_id, net, region, min(s) AS first FROM g GROUP BY ALL), k AS (SELECT user_id, count(DISTINCT region) AS k FROM points GROUP BY user_id)
, e AS (SELECT user_id, net, min(first) AS onset, max(first) - min(first) AS spread, count(*) AS n_participants, (list(region ORDER BY first, region))[1] AS leader, string_agg(region, ';' ORDER BY region) AS participants FROM p GROUP BY ALL)
SELECT user_id, CAST(net AS BIGINT) AS net, onset, spread, n_participants, leader, participants, CASE WHEN n_participants = 1 THEN 'isolated' WHEN n_participants >= greatest(2, ceil(0.8 * k)) THEN 'global' ELSE 'partial' END AS kind FROM e JOIN k USING (user_id)
""")
def ts5_network_events(spark, d):
    return ev.network_events(points(spark, d), ["user_id"], "region", "s", 3600)


@query("""
WITH g AS (SELECT user_id, region, s, 1 + sum(CASE WHEN gap > 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s RANGE UNBOUNDED PRECEDING) AS net
    FROM (SELECT *, s - lag(s) OVER (PARTITION BY user_id ORDER BY s) AS gap FROM points))
, p AS (SELECT user_id, net, min(s) FILTER (region = 'view') AS a, min(s) FILTER (region = 'purchase') AS b FROM g GROUP BY ALL HAVING a IS NOT NULL AND b IS NOT NULL)
SELECT user_id, CAST(net AS BIGINT) AS net, b - a AS delta, CASE WHEN b > a THEN 'a_first' WHEN b < a THEN 'b_first' ELSE 'tie' END AS "order" FROM p
""")
def ts6_onset_delta(spark, d):
    return ev.onset_delta(points(spark, d), ["user_id"], "region", "s", 7200, "view", "purchase")


XC = """
WITH j AS (SELECT a.t - b.t AS lag, a.f AS x, b.f AS y FROM panel a JOIN panel b ON a.region = 'view' AND b.region = 'purchase' AND a.t - b.t BETWEEN -30 AND 30)
, c AS (SELECT lag, count(*) AS n, sum(x * y) AS product, corr(x, y) AS pearson FROM j GROUP BY lag)
"""


@query(XC + "SELECT CAST(lag AS INT) AS lag, n, round(product, 4) AS product, round(pearson, 6) AS pearson FROM c")
def ts7_cross_correlation(spark, d):
    x = _wide(spark, d).select("t", "view", "purchase")
    a = series.cross_correlation(x, [], "view", "purchase", 30)
    b = series.cross_correlation(x, [], "view", "purchase", 30, "pearson")
    return a.select("lag", "n", F.round("c", 4).alias("product")).join(b.select("lag", F.round("c", 6).alias("pearson")), "lag")


@query(XC + "SELECT CAST(arg_max(lag, pearson) AS INT) AS lag, round(max(pearson), 6) AS c FROM c")
def ts7_best_lag(spark, d):
    x = _wide(spark, d).select(F.lit(1).alias("one"), "t", "view", "purchase")
    return series.best_lag(series.cross_correlation(x, ["one"], "view", "purchase", 30, "pearson"), ["one"]).select("lag", F.round("c", 6).alias("c"))


@query()
def ts8_coherence(spark, d):
    x = series.fill_gaps(panel(spark, d), R).where("region in ('view', 'purchase')").groupBy("t").pivot("region", ["view", "purchase"]).agg(F.first("f")).dropna()
    return learn.coherence(x.withColumn("one", F.lit(1)), ["one"], "t", "view", "purchase", 1.0, {"slow": (0.01, 0.1), "mid": (0.1, 0.25), "fast": (0.25, 0.51)})


@query()
def ts9_spectrum(spark, d):
    return learn.spectrum(series.fill_gaps(panel(spark, d), R), R, "t", "f", 1.0, {"low": (0.001, 0.1), "high": (0.25, 0.51)})


@query("""
WITH c AS (SELECT region, t, f - avg(f) OVER (PARTITION BY region) AS d FROM panel), k AS (SELECT unnest([1, 2, 24]) AS lag)
, s AS (SELECT region, sum(d * d) AS ss FROM c GROUP BY region)
SELECT a.region, lag, round(sum(a.d * b.d) / any_value(ss), 6) AS r FROM c a JOIN k ON true JOIN c b ON a.region = b.region AND a.t = b.t + lag JOIN s ON s.region = a.region GROUP BY ALL
""")
def ts10_autocorrelation(spark, d):
    return series.autocorrelation(panel(spark, d), R, "f", [1, 2, 24]).select("region", "lag", F.round("r", 6).alias("r"))


@query("""
WITH c AS (SELECT region, t, f - avg(f) OVER (PARTITION BY region) AS d FROM panel), k AS (SELECT unnest(range(10, 60)) AS lag)
, r AS (SELECT a.region, lag, sum(a.d * b.d) AS s FROM c a JOIN k ON true JOIN c b ON a.region = b.region AND a.t = b.t + lag GROUP BY ALL)
SELECT region, CAST(arg_max(lag, s) AS INT) AS period FROM r GROUP BY region
""")
def ts11_period(spark, d):
    a = series.autocorrelation(panel(spark, d), R, "f", list(range(10, 60)))
    return series.best_lag(a.withColumnRenamed("r", "c"), R).select("region", F.col("lag").alias("period"))


@query("""
WITH n AS (SELECT *, lag(f) OVER w AS p, lead(f) OVER w AS q FROM panel WINDOW w AS (PARTITION BY region ORDER BY t)), e AS (SELECT region, t FROM n WHERE f > p AND f > q AND f > 320)
, j AS (SELECT e.region, e.t, b.t AS s, b.f AS y FROM e JOIN panel b ON b.region = e.region AND b.t - e.t BETWEEN -6 AND 12)
, b AS (SELECT region, t, min(y) FILTER (s < t) AS base, max(y) FILTER (s = t) AS peak FROM j GROUP BY ALL HAVING base < peak)
, u AS (SELECT j.*, base, peak, (y - base) / (peak - base) AS u, s - j.t AS k FROM j JOIN b ON b.region = j.region AND b.t = j.t)
, g AS (SELECT region, t, any_value(peak) - any_value(base) AS amplitude, max(k) FILTER (k < 0 AND u <= 0.9) - max(k) FILTER (k < 0 AND u <= 0.1) AS rise, min(k) FILTER (k > 0 AND u <= 0.5) AS half_decay,
    regr_slope(ln(u), k) FILTER (k >= 0 AND u > 0.1) AS sl, sum(CASE WHEN k >= 0 THEN y - base ELSE 0 END) AS area, count(*) < 19 AS truncated FROM u GROUP BY ALL)
SELECT region, t, round(amplitude, 6) AS amplitude, rise, half_decay, CASE WHEN sl < 0 THEN round(-1 / sl, 6) END AS tau, round(area, 6) AS area, truncated FROM g
""")
def ts12_event_shape(spark, d):
    x = panel(spark, d)
    e = ev.peak_candidates(x, R).where("f > 320").select("region", "t")
    return ev.event_shapes(e, x, R, "f", 6, 12).select("region", "t", F.round("amplitude", 6).alias("amplitude"), "rise", "half_decay", F.round("tau", 6).alias("tau"), F.round("area", 6).alias("area"), "truncated")


@query("""
WITH e AS (SELECT region, t FROM panel WHERE f > 350), m AS (SELECT region, median(f) AS m FROM panel GROUP BY region)
, h AS (SELECT p.region, t, f, max(CASE WHEN f > m + 60 THEN 1 ELSE 0 END) OVER (PARTITION BY p.region ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS hot FROM panel p JOIN m USING (region))
SELECT region, t, round(f, 6) AS f, hot OR EXISTS (SELECT 1 FROM e WHERE e.region = h.region AND h.t BETWEEN e.t - 1 AND e.t + 4) AS masked FROM h
""")
def ts15_event_mask(spark, d):
    x = panel(spark, d)
    return ev.event_mask(x, x.where("f > 350").select("region", "t"), R, "f", 1, 4, 20.0).withColumn("f", F.round("f", 6))


@query("""
WITH j AS (SELECT a.region, a.t, b.t - a.t AS k, b.f AS y FROM panel a JOIN panel b ON a.region = b.region AND b.t - a.t BETWEEN -16 AND 8)
, m AS (SELECT region, t, max(y) FILTER (k >= -2) - median(y) FILTER (k <= -2) AS response FROM j GROUP BY ALL), c AS (SELECT region, quantile_cont(response, 0.95) AS cut FROM m WHERE response IS NOT NULL GROUP BY region)
SELECT region, t, round(response, 6) AS response, response > cut AS responds FROM m JOIN c USING (region) JOIN panel USING (region, t) WHERE f > 330
""")
def ts16_responses(spark, d):
    x = panel(spark, d)
    return ev.responses(x, x.where("f > 330"), R, "f").withColumn("response", F.round("response", 6))


STATE = f"WITH w AS ({WIDE}), m AS (SELECT median(error) AS a, median(signup) AS b FROM w), s AS (SELECT w.*, coalesce(error > a, false) OR coalesce(signup > b, false) AS active FROM w, m) "


@query(STATE + "SELECT active, count(*) AS n, round(corr(view, purchase), 6) AS r FROM s GROUP BY active HAVING count(*) > 0")
def ts17_state_coupling(spark, d):
    s = series.active_state(_wide(spark, d), ["error", "signup"])
    return s.groupBy("active").agg(F.count("*").alias("n"), F.round(F.corr("view", "purchase"), 6).alias("r"))


@query(STATE + "SELECT round(log2(((count(*) FILTER (active AND view > 300)) + 0.5) / (count(*) FILTER (active) + 0.5) / (((count(*) FILTER (NOT active AND view > 300)) + 0.5) / (count(*) FILTER (NOT active) + 0.5))), 6) AS log2_ratio FROM s")
def ts18_state_rate(spark, d):
    s = series.active_state(_wide(spark, d), ["error", "signup"])
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int")) + 0.5
    a, e = F.col("active"), F.col("view") > 300
    return s.agg(F.round(F.log2(n(a & e) / n(a) / (n(~a & e) / n(~a))), 6).alias("log2_ratio"))


@query("""
WITH b AS (SELECT region, t // 30 AS block, quantile_cont(f, 0.1) AS v FROM panel GROUP BY ALL)
SELECT region, round(regr_slope(v, block) / arg_min(v, block), 8) AS trend, count(*) AS blocks FROM b GROUP BY region
""")
def ts19_bleaching(spark, d):
    return series.block_trend(panel(spark, d), R, "f", 30).select("region", F.round("trend", 8).alias("trend"), "blocks")


@query("""
WITH c AS (SELECT region, t, f FROM panel WHERE t >= 100 AND t < 500), m AS (SELECT region, max(f) FILTER (t < 300) AS top FROM c GROUP BY region)
SELECT region, t, round(f / top, 6) AS scaled FROM c JOIN m USING (region)
""")
def ts21_crop_scale(spark, d):
    return series.crop_and_scale(panel(spark, d), R, "f", 100, 500).select("region", "t", F.round("scaled", 6).alias("scaled"))


@query("""
WITH w AS (SELECT region, t, lag(f) OVER o AS a, f, lead(f) OVER o AS b FROM panel WINDOW o AS (PARTITION BY region ORDER BY t))
SELECT region, t, round((coalesce(0.25 * a, 0) + 0.5 * f + coalesce(0.25 * b, 0)) / (CASE WHEN a IS NULL THEN 0 ELSE 0.25 END + 0.5 + CASE WHEN b IS NULL THEN 0 ELSE 0.25 END), 6) AS smooth FROM w
""")
def ts21_kernel_smooth(spark, d):
    return series.smooth_kernel(panel(spark, d), R, "f", [0.25, 0.5, 0.25]).select("region", "t", F.round("smooth", 6).alias("smooth"))


@query("""
WITH h AS (SELECT event_type AS region, date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) AS t, avg(value) FILTER (event_id % 2 = 0) AS a, avg(value) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY ALL)
, r AS (SELECT region, corr(a, b) AS r FROM h GROUP BY region)
SELECT region, round(r, 6) AS half_r, round(2 * r / (1 + r), 6) AS reliability FROM r
""")
def ts23_reliability(spark, d):
    p = read(spark, d, "events").withColumn("t", F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)"))
    h = p.groupBy(F.col("event_type").alias("region"), "t").agg(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("a"), F.avg(F.when(F.col("event_id") % 2 == 1, F.col("value"))).alias("b"))
    r = h.groupBy("region").agg(F.corr("a", "b").alias("r"))
    return r.select("region", F.round("r", 6).alias("half_r"), F.round(2 * F.col("r") / (1 + F.col("r")), 6).alias("reliability"))


PAD = """
WITH n AS (SELECT region, t, f, row_number() OVER (PARTITION BY region ORDER BY t) AS i, count(*) OVER (PARTITION BY region) AS n FROM panel)
, p AS (SELECT region, t, f, i, true AS real FROM n UNION ALL SELECT region, t, f, 1 - i, false FROM n WHERE i <= 7 UNION ALL SELECT region, t, f, 2 * n + 1 - i, false FROM n WHERE i > n - 7)
, s AS (SELECT *, avg(f) OVER (PARTITION BY region ORDER BY i ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS smooth FROM p)
"""


@query(PAD + "SELECT region, t, round(smooth, 6) AS smooth FROM s WHERE real")
def win1_rolling_mean(spark, d):
    return series.rolling_mean(panel(spark, d), R).select("region", "t", F.round("smooth", 6).alias("smooth"))


@query(PAD + ", r AS (SELECT region, f - smooth AS r FROM s WHERE real), m AS (SELECT region, median(r) AS m FROM r GROUP BY region) SELECT region, round(1.4826 * median(abs(r - m)), 6) AS noise FROM r JOIN m USING (region) GROUP BY region")
def agg3_robust_noise(spark, d):
    return series.robust_noise(panel(spark, d), R).select("region", F.round("noise", 6).alias("noise"))


@query("SELECT region, t, round(quantile_cont(f, 0.1) OVER (PARTITION BY region ORDER BY t ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING), 6) AS base FROM panel")
def win2_rolling_percentile(spark, d):
    return series.rolling_percentile(panel(spark, d), R).select("region", "t", F.round("base", 6).alias("base"))


@query("""
WITH b AS (SELECT region, min(f) + 0.5 * (max(f) - min(f)) AS level FROM panel GROUP BY region), l AS (SELECT *, lag(f) OVER (PARTITION BY region ORDER BY t) AS p FROM panel)
SELECT region, t, round(f, 6) AS f FROM l JOIN b USING (region) WHERE f > level AND p <= level
""")
def win3_rising_edges(spark, d):
    return series.rising_edges(panel(spark, d), R).select("region", "t", F.round("f", 6).alias("f"))


@query("""
WITH g AS (SELECT user_id, s, 1 + sum(CASE WHEN gap > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s RANGE UNBOUNDED PRECEDING) AS k FROM (SELECT *, s - lag(s) OVER (PARTITION BY user_id ORDER BY s) AS gap FROM points))
SELECT user_id, CAST(k AS BIGINT) AS session, count(*) AS n, min(s) AS start, max(s) AS stop FROM g GROUP BY ALL
""")
def win4_sessions(spark, d):
    x = series.sessions(points(spark, d), ["user_id"], "s", 3600)
    return x.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("s").alias("start"), F.max("s").alias("stop"))


@query("""
WITH h AS (SELECT region, t FROM panel WHERE f > 22), g AS (SELECT *, sum(CASE WHEN gap > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY region ORDER BY t) AS k FROM (SELECT *, t - lag(t) OVER (PARTITION BY region ORDER BY t) AS gap FROM h))
SELECT region, min(t) AS start, max(t) AS stop, count(*) AS length FROM g GROUP BY region, k HAVING count(*) >= 3
""")
def win5_runs(spark, d):
    return series.runs_of(panel(spark, d), R, F.col("f") > 22, gap=2, least=3).select("region", "start", "stop", "length")


@query("SELECT region, t, round(f - avg(f) OVER w, 6) AS centred, round((f - avg(f) OVER w) / stddev_pop(f) OVER w, 6) AS z FROM panel WINDOW w AS (PARTITION BY region)")
def win8_centring(spark, d):
    return series.centred(panel(spark, d), R, "f").select("region", "t", *r6("centred", "z"))


@query("SELECT region, t, round(sum(f) OVER (PARTITION BY region ORDER BY t), 4) AS total FROM panel")
def win9_prefix_sum(spark, d):
    return series.prefix_sum(panel(spark, d), R, "f").select("region", "t", F.round("total", 4).alias("total"))


@query("""
WITH g AS (SELECT region, unnest(range(min(t), max(t) + 1)) AS t FROM panel GROUP BY region), j AS (SELECT g.region, g.t, f FROM g LEFT JOIN panel p ON p.region = g.region AND p.t = g.t)
, k AS (SELECT *, last_value(CASE WHEN f IS NOT NULL THEN t END IGNORE NULLS) OVER b AS pt, last_value(f IGNORE NULLS) OVER b AS pf, first_value(CASE WHEN f IS NOT NULL THEN t END IGNORE NULLS) OVER n AS nt, first_value(f IGNORE NULLS) OVER n AS nf
  FROM j WINDOW b AS (PARTITION BY region ORDER BY t ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY region ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT region, t, round(coalesce(f, pf + (nf - pf) * (t - pt) / (nt - pt)), 6) AS f, f IS NULL AS filled FROM k
""")
def win10_gap_fill(spark, d):
    return series.fill_gaps(panel(spark, d), R).withColumn("f", F.round("f", 6))


@query("WITH n AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY t) - 1 AS i FROM panel) SELECT region, min(t) AS t, round(avg(f), 6) AS f FROM n GROUP BY region, i // 2 HAVING count(*) = 2")
def win13_decimate(spark, d):
    return series.decimate(panel(spark, d), R, how="mean").withColumn("f", F.round("f", 6))


@query("""
WITH RECURSIVE n AS (SELECT region, t, f, row_number() OVER w AS i, lag(f) OVER w AS p, lead(f) OVER w AS q FROM panel WINDOW w AS (PARTITION BY region ORDER BY t))
, c AS (SELECT region, i AS ix, row_number() OVER (PARTITION BY region ORDER BY f DESC, i) AS i FROM n WHERE f > p AND f > q)
, s AS (
    SELECT region, i, [ix] AS ys FROM c WHERE i = 1
    UNION ALL
    SELECT s.region, s.i + 1, CASE WHEN ok THEN list_append(ys, ix) ELSE ys END
    FROM (SELECT s.*, c.ix, len(ys) < 5 AND len(list_filter(ys, lambda y: abs(y - c.ix) <= 4)) = 0 AS ok FROM s JOIN c ON c.region = s.region AND c.i = s.i + 1) s
), e AS (SELECT region, ys, unnest(range(1, len(ys) + 1)) AS place FROM (SELECT region, arg_max(ys, i) AS ys FROM s GROUP BY region))
SELECT e.region, t, place, round(f, 6) AS f FROM e JOIN n ON n.region = e.region AND n.i = ys[place]
""")
def srt2_top_peaks(spark, d):
    w = Window.partitionBy("region").orderBy("t")
    x = panel(spark, d).withColumn("i", F.row_number().over(w)).withColumn("up", (F.col("f") > F.lag("f").over(w)) & (F.col("f") > F.lead("f").over(w)))
    top = catalog.greedy_suppression(x.where("up"), R, [-F.col("f")], ["i"], 4, most=5)
    return x.join(F.broadcast(top), ["region", "i"]).select("region", "t", F.col("place").cast("long").alias("place"), F.round("f", 6).alias("f"))


@query("SELECT region, count(*) AS n, round(count(*) / (SELECT max(t) - min(t) + 1.0 FROM panel), 6) AS rate FROM points GROUP BY region")
def agg14_event_rate(spark, d):
    return ev.event_rate(points(spark, d), R, _hours(spark, d)).withColumn("rate", F.round("rate", 6))


@query("SELECT user_id, round(count(DISTINCT s // 3600) / (SELECT max(t) - min(t) + 1.0 FROM panel), 6) AS share FROM points GROUP BY user_id")
def agg15_block_activity(spark, d):
    return ev.block_activity(points(spark, d), ["user_id"], "s", 3600, _hours(spark, d)).withColumn("share", F.round("share", 6))


@query("""
WITH a AS (SELECT DISTINCT user_id, s FROM points WHERE region = 'purchase'), b AS (SELECT DISTINCT user_id, s FROM points WHERE region = 'view')
SELECT user_id, count(*) AS n, round(avg(CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.user_id = a.user_id AND abs(a.s - b.s) <= 7200) THEN 0 ELSE 1 END), 6) AS independent FROM a GROUP BY user_id
""")
def join10_independent_fraction(spark, d):
    p = points(spark, d)
    out = ev.independent_fraction(p.where("region = 'purchase'").select("user_id", "s").distinct(), p.where("region = 'view'").select("user_id", "s"), ["user_id"], "s", 7200)
    return out.withColumn("independent", F.round("independent", 6))


@query("SELECT event_id FROM points a WHERE region = 'purchase' AND EXISTS (SELECT 1 FROM points b WHERE b.region = 'view' AND b.user_id = a.user_id AND abs(a.s - b.s) <= 7200)")
def join9_coincidence(spark, d):
    p = points(spark, d)
    a, b = p.where("region = 'purchase'").select("event_id", "user_id", "s"), p.where("region = 'view'").select("user_id", F.col("s").alias("u"))
    return band_join(a, b, ["user_id"], "s", "u", -7200, 7200, "left_semi").select("event_id")
