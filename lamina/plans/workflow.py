"""Queries on extracted files, workflow steps, mask quality and feature tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.plans.fixtures import mask, query, r6, read, runs, voxels

YX = ["y", "x"]


@query("""
WITH u AS (SELECT l_orderkey AS unit, count(*) AS t, count(DISTINCT l_suppkey) AS z FROM lineitem GROUP BY ALL)
, f AS (SELECT l_orderkey AS unit, l_linenumber AS file, l_partkey, l_partkey % 6 + 1 AS t, l_suppkey % 4 + 1 AS z, l_returnflag = 'N' AS clean, l_quantity AS length FROM lineitem)
SELECT unit, file, CASE WHEN u.t = f.t AND u.z = f.z THEN 'exact' ELSE 'suspect' END AS state FROM u JOIN f USING (unit) WHERE u.t * u.z = f.t * f.z
QUALIFY row_number() OVER (PARTITION BY unit ORDER BY u.t <> f.t OR u.z <> f.z, NOT clean, length DESC, file, l_partkey) = 1
""")
def x4_resolved_files(spark, d):
    """The file of a unit: one of its shape, else one of as many elements, split in another way."""
    rows = read(spark, d, "lineitem")
    u = rows.groupBy(F.col("l_orderkey").alias("unit")).agg(F.count("*").alias("t"), F.count_distinct("l_suppkey").alias("z"))
    f = rows.select(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("file"), "l_partkey", (F.col("l_partkey") % 6 + 1).alias("ft"), (F.col("l_suppkey") % 4 + 1).alias("fz"), (F.col("l_returnflag") == "N").alias("clean"), F.col("l_quantity").alias("length"))
    same = u.join(f, "unit").where("t * z = ft * fz").withColumn("exact", F.expr("t = ft and z = fz"))
    best = F.min_by(F.struct("file", "exact"), F.struct(~F.col("exact"), ~F.col("clean"), -F.col("length"), "file", "l_partkey"))
    return same.groupBy("unit").agg(best.alias("b")).select("unit", "b.file", F.when(F.col("b.exact"), "exact").otherwise("suspect").alias("state"))


@query("""
SELECT frame, CASE WHEN sqrt((y - 3.5) * (y - 3.5) + (x - 3.5) * (x - 3.5)) < 2 THEN 'core' ELSE 'rim' END AS band, count(*) AS n, round(avg(v), 6) AS mean FROM voxels WHERE x BETWEEN 2 AND 5 GROUP BY ALL
""")
def x23_slab_slices(spark, d):
    far = F.sqrt((F.col("y") - 3.5) ** 2 + (F.col("x") - 3.5) ** 2)
    slab = voxels(spark, d).where("x between 2 and 5")
    return slab.groupBy("frame", F.when(far < 2, "core").otherwise("rim").alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"))


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'none' WHEN 'O' THEN 'segment' ELSE 'review' END AS next_step
, CASE WHEN manual AND automatic THEN 'both' WHEN manual THEN 'human' WHEN automatic THEN 'program' ELSE 'none' END AS made_by
FROM orders JOIN (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS manual, bool_or(l_returnflag = 'A') AS automatic FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey
""")
def x25_next_step(spark, d):
    flag = F.col("l_returnflag")
    made = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(flag == "R").alias("manual"), F.bool_or(flag == "A").alias("automatic"))
    status = F.col("o_orderstatus")
    step = F.when(status == "F", "none").when(status == "O", "segment").otherwise("review")
    by = F.when(F.col("manual") & F.col("automatic"), "both").when(F.col("manual"), "human").when(F.col("automatic"), "program").otherwise("none")
    return read(spark, d, "orders").join(made, "o_orderkey").select("o_orderkey", step.alias("next_step"), by.alias("made_by"))


@query("""
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'restore' WHEN md5(d.text) = md5(trim(d.text, ' ')) THEN 'remove' ELSE 'changed' END AS action
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) WHERE d.text IS NOT NULL
""")
def x28_restore_verify(spark, d):
    """A copy that is missing is restored; the source of one with the recorded checksum may go."""
    docs = read(spark, d, "documents").where("text is not null").select("doc_id", F.md5("text").alias("recorded"), F.md5(F.trim("text")).alias("found"))
    here = read(spark, d, "labels").select("doc_id").distinct().withColumn("here", F.lit(True))
    action = F.when(F.col("here").isNull(), "restore").when(F.col("recorded") == F.col("found"), "remove").otherwise("changed")
    return docs.join(here, "doc_id", "left").select("doc_id", action.alias("action"))


@query("""
SELECT sub, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(regr_slope(y, x), 5) END AS slope, concat(sub, ': ', count(*), ' runs') AS text
, coalesce(max(run) FILTER (x > 9000), min(run)) AS source, CASE WHEN count(*) FILTER (x > 9000) > 0 THEN 'curated' ELSE 'automatic' END AS source_kind FROM runs GROUP BY sub
""")
def x29_atlas_row(spark, d):
    curated = F.max(F.when(F.col("x") > 9000, F.col("run")))
    return runs(spark, d).groupBy("sub").agg(
        F.count("*").alias("n"), F.when(F.count("*") >= 3, F.round(F.regr_slope("y", "x"), 5)).alias("slope"), F.format_string("%s: %s runs", F.first("sub"), F.count("*")).alias("text"),
        F.coalesce(curated, F.min("run")).alias("source"), F.when(curated.isNotNull(), "curated").otherwise("automatic").alias("source_kind"),
    )


@query("""
WITH c AS (SELECT frame, x, count(*) AS n FROM mask GROUP BY ALL), w AS (SELECT *, median(n) OVER (PARTITION BY frame) AS med FROM c)
SELECT frame, x, n, n >= 2 * med AS wide FROM w
""")
def vol11_column_rules(spark, d):
    """Columns at least twice as wide as the frame's median column count as cell body."""
    c = mask(spark, d).groupBy("frame", "x").agg(F.count("*").alias("n"))
    return c.select("frame", "x", "n", (F.col("n") >= 2 * F.median("n").over(Window.partitionBy("frame"))).alias("wide"))


@query("""
WITH k AS (SELECT unnest([1, 2, 3]) AS click, unnest([1, 4, 6]) AS cy, unnest([1, 6, 2]) AS cx)
SELECT frame, y, x, arg_min(click, (y - cy) * (y - cy) + (x - cx) * (x - cx) + click / 10.0) AS nearest, CAST(sign((y - 1) * 5 + (x - 1)) AS INT) AS side FROM mask, k GROUP BY ALL
""")
def vol13_nearest_click(spark, d):
    """The nearest of three clicks, the lower number on ties, and the side of the plane at the first."""
    clicks = [(1, 1, 1), (2, 4, 6), (3, 6, 2)]
    far = F.array(*[F.struct(((F.col("y") - cy) ** 2 + (F.col("x") - cx) ** 2).alias("d"), F.lit(i).alias("click")) for i, cy, cx in clicks])
    side = F.signum((F.col("y") - 1) * 5 + (F.col("x") - 1)).cast("int")
    return mask(spark, d).select("frame", *YX, F.array_min(far)["click"].alias("nearest"), side.alias("side"))


@query("""
WITH p AS (SELECT frame, x, median(v) AS m FROM voxels GROUP BY ALL), n AS (SELECT *, (lag(m) OVER w + lead(m) OVER w) / 2 AS beside FROM p WINDOW w AS (PARTITION BY frame ORDER BY x))
, g AS (SELECT frame, x, beside - m > 0.1 AS dip FROM n)
, t AS (SELECT v.frame, v.y, v.x, v.v, coalesce(g.dip, false) AS dip, (lag(v.v) OVER w + lead(v.v) OVER w) / 2 AS fill FROM voxels v JOIN g USING (frame, x) WINDOW w AS (PARTITION BY v.frame, v.y ORDER BY v.x))
SELECT frame, y, x, dip, round(CASE WHEN dip THEN fill ELSE v END, 6) AS v FROM t
""")
def vol14_grid_inpaint(spark, d):
    """Columns whose median dips below both neighbours' mean are drawn anew between them."""
    v = voxels(spark, d).select("frame", *YX, "v")
    row, line = Window.partitionBy("frame").orderBy("x"), Window.partitionBy("frame", "y").orderBy("x")
    beside = lambda c, w: (F.lag(c).over(w) + F.lead(c).over(w)) / 2
    dips = v.groupBy("frame", "x").agg(F.median("v").alias("m")).select("frame", "x", F.coalesce(beside("m", row) - F.col("m") > 0.1, F.lit(False)).alias("dip"))
    t = v.join(dips, ["frame", "x"]).withColumn("fill", beside("v", line))
    return t.select("frame", *YX, "dip", F.round(F.when(F.col("dip"), F.col("fill")).otherwise(F.col("v")), 6).alias("v"))


@query("""
SELECT v.y, v.x, round(corr(v.v, s.v), 6) AS r, round(avg(v.v), 6) AS mean, corr(v.v, s.v) > 0.05 AND avg(v.v) > 0 AS grown FROM voxels v JOIN voxels s ON s.frame = v.frame AND s.y = 3 AND s.x = 3 GROUP BY v.y, v.x
""")
def vol17_seed_correlation(spark, d):
    """Voxels that follow the seed's trace and pass the gate of intensity."""
    v = voxels(spark, d)
    seed = v.where("y = 3 and x = 3").select("frame", F.col("v").alias("s"))
    r = v.join(seed, "frame").groupBy(*YX).agg(F.corr("v", "s").alias("r"), F.avg("v").alias("mean"))
    return r.select(*YX, *r6("r", "mean"), ((F.col("r") > 0.05) & (F.col("mean") > 0)).alias("grown"))


@query("""
SELECT frame, count(*) AS n, round(count(*) FILTER (y IN (0, 7) OR x IN (0, 7)) / count(*), 6) AS boundary_share, max(x) - min(x) + 1 - count(DISTINCT x) AS gaps FROM mask GROUP BY frame
""")
def vol20_mask_quality(spark, d):
    edge = F.count(F.when(F.col("y").isin(0, 7) | F.col("x").isin(0, 7), 1))
    return mask(spark, d).groupBy("frame").agg(F.count("*").alias("n"), F.round(edge / F.count("*"), 6).alias("boundary_share"), (F.max("x") - F.min("x") + 1 - F.count_distinct("x")).alias("gaps"))


@query("""
WITH r AS (SELECT label, y, x, median(v) AS m FROM voxels GROUP BY ALL), g AS (SELECT label, m - lag(m) OVER (PARTITION BY label, y ORDER BY x) AS gx, m - lag(m) OVER (PARTITION BY label, x ORDER BY y) AS gy FROM r)
SELECT label, round(avg(gx * gx), 6) AS sharp_x, round(avg(gy * gy), 6) AS sharp_y FROM g GROUP BY label
""")
def x18_reference_sharpness(spark, d):
    """Median plane of each label and the mean square of its steps along both axes."""
    r = voxels(spark, d).groupBy("label", *YX).agg(F.median("v").alias("m"))
    step = lambda along, across: F.col("m") - F.lag("m").over(Window.partitionBy("label", across).orderBy(along))
    g = r.select("label", step("x", "y").alias("gx"), step("y", "x").alias("gy"))
    return g.groupBy("label").agg(F.round(F.avg(F.col("gx") ** 2), 6).alias("sharp_x"), F.round(F.avg(F.col("gy") ** 2), 6).alias("sharp_y"))


@query("""
WITH s AS (SELECT grp, 'x-y' AS spec, x AS a, y AS b FROM runs UNION ALL SELECT grp, 'x-z', x, z FROM runs UNION ALL SELECT grp, 'y-z', y, z FROM runs)
, r AS (SELECT grp, spec, rank() OVER (PARTITION BY grp, spec ORDER BY a) + (count(*) OVER (PARTITION BY grp, spec, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY grp, spec ORDER BY b) + (count(*) OVER (PARTITION BY grp, spec, b) - 1) / 2 AS rb FROM s)
, t AS (SELECT grp, spec, count(*) AS n, corr(ra, rb) AS rho FROM r GROUP BY ALL)
SELECT grp, spec, n, round(rho, 6) AS rho, round(tanh(atanh(rho) - 1.96 * sqrt(1.06 / (n - 3))), 6) AS low, round(tanh(atanh(rho) + 1.96 * sqrt(1.06 / (n - 3))), 6) AS high FROM t
""")
def x13_feature_battery(spark, d):
    """Rank correlation of each pair of features in each set, with its interval on Fisher's scale."""
    pairs = [("x", "y"), ("x", "z"), ("y", "z")]
    spec = F.explode(F.array(*[F.struct(F.lit(f"{a}-{b}").alias("spec"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs]))
    s = runs(spark, d).select("grp", spec.alias("s")).select("grp", "s.*")
    own = Window.partitionBy("grp", "spec")
    place = lambda c: F.rank().over(own.orderBy(c)) + (F.count("*").over(Window.partitionBy("grp", "spec", c)) - 1) / 2
    t = s.select("grp", "spec", place("a").alias("ra"), place("b").alias("rb")).groupBy("grp", "spec").agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("rho"))
    half = 1.96 * F.sqrt(1.06 / (F.col("n") - 3))
    bound = lambda sign: F.round(F.tanh(F.atanh("rho") + sign * half), 6)
    return t.select("grp", "spec", "n", F.round("rho", 6).alias("rho"), bound(-1).alias("low"), bound(1).alias("high"))
