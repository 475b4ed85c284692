"""Placement of regions along a cell: the window of each zone whose two halves agree best."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.sources.readers import staged

#: Lengths of windows that are tried, as shares of the target.
SHARES = (0.8, 1.0, 1.2)


def candidate_windows(zones: DataFrame, target: float = 20.0, least: float = 5.0, step: float = 2.0) -> DataFrame:
    """Windows of each zone: ``cell, zone, start, end``.

    ``zones``: ``cell, zone, lo, hi`` along the cell.  A zone shorter than ``least`` has none; one of at most 1.3 times the target is its own window.  Else windows of 0.8, 1 and
    1.2 times the target, of 0.6 times (``least`` at least) and 1.5 times (the zone at most) begin every ``step``.
    """
    size = F.col("hi") - F.col("lo")
    whole = zones.where((size >= least) & (size <= 1.3 * target)).select("cell", "zone", F.col("lo").cast("double").alias("start"), F.col("hi").cast("double").alias("end"))
    lengths = F.array_distinct(F.array(*[F.lit(float(target * s)) for s in SHARES], F.lit(float(max(least, 0.6 * target))), F.least(size.cast("double"), F.lit(1.5 * target))))
    some = zones.where(size > 1.3 * target).select("cell", "zone", "lo", "hi", F.explode(lengths).alias("_n")).where((F.col("_n") >= least) & (F.col("_n") <= F.col("hi") - F.col("lo")))
    many = F.floor((F.col("hi") - F.col("lo") - F.col("_n") + 0.01) / step).cast("int")
    at = some.select("cell", "zone", "hi", "_n", "lo", F.explode(F.sequence(F.lit(0), many)).alias("_i")).withColumn("start", F.col("lo") + F.col("_i") * step)
    return whole.unionByName(at.select("cell", "zone", F.col("start").cast("double").alias("start"), F.least(F.col("start") + F.col("_n"), F.col("hi").cast("double")).alias("end")).distinct())


def window_reliability(vox: DataFrame, windows: DataFrame, voxels: int = 25) -> DataFrame:
    """The split-half reliability of windows: ``cell, zone, start, end, n_voxels, reliability``.

    ``vox``: ``cell, voxel, at`` (its distance along the cell), ``t, v``.  Voxels are dealt to halves in turns along the cell (ties by a hash), so both halves of any window are of like size.  The ends of a zone's windows cut it into
    pieces; each frame's sums of the pieces are added up along the zone once, and a window's trace is the difference at its ends.  The reliability is 2 r / (1 + r), r the
    correlation of the halves' traces, null if r <= -0.99 or undefined.  Windows [start, end) of fewer than ``voxels`` voxels, or with an empty half, are left out.
    """
    ends = windows.select("cell", "zone", F.explode(F.array("start", "end")).alias("cut")).distinct()
    span = ends.groupBy("cell", "zone").agg(F.sort_array(F.collect_set("cut")).alias("_cuts"))
    places = vox.select("cell", "voxel", "at").distinct()
    dealt = places.withColumn("_a", F.row_number().over(Window.partitionBy("cell").orderBy("at", F.xxhash64("voxel"), "voxel")) % 2 == 1)
    # The piece of a voxel: how many cuts lie at or below it, the first cut excepted.
    inside = dealt.join(span, "cell").where((F.col("at") >= F.element_at("_cuts", 1)) & (F.col("at") < F.element_at("_cuts", -1)))
    inside = inside.select("cell", "zone", "voxel", "_a", F.size(F.filter("_cuts", lambda c: c <= F.col("at"))).alias("_piece"))
    sums = inside.join(vox.select("cell", "voxel", "t", "v"), ["cell", "voxel"]).groupBy("cell", "zone", "_piece", "t").agg(
        F.coalesce(F.sum(F.when(F.col("_a"), F.col("v"))), F.lit(0.0)).alias("_sa"), F.coalesce(F.sum(F.when(~F.col("_a"), F.col("v"))), F.lit(0.0)).alias("_sb"),
        F.count(F.when(F.col("_a"), 1)).alias("_na"), F.count(F.when(~F.col("_a"), 1)).alias("_nb"))
    order = Window.partitionBy("cell", "zone", "t").orderBy("_piece")
    held = ("_sa", "_sb", "_na", "_nb")
    along = sums.join(span.select("cell", "zone", F.size("_cuts").alias("_last")), ["cell", "zone"])
    summed = along.select("cell", "zone", "t", "_piece", *[F.sum(c).over(order).alias(c) for c in held], F.coalesce(F.lead("_piece").over(order), F.col("_last")).alias("_next"))
    # The sums of all pieces before each cut, for each frame.
    total = staged(summed.select("cell", "zone", "t", *held, F.explode(F.sequence(F.col("_piece") + 1, F.col("_next"))).alias("_cut")), "prefix-sums")
    edge = lambda name, sign: F.struct(F.array_position("_cuts", F.col(name)).cast("int").alias("_cut"), F.lit(sign).alias("_sign"))
    edges = windows.join(span, ["cell", "zone"]).select("cell", "zone", "start", "end", F.explode(F.array(edge("end", 1), edge("start", -1))).alias("_e")).select("cell", "zone", "start", "end", "_e.*")
    traces = edges.join(total, ["cell", "zone", "_cut"]).groupBy("cell", "zone", "start", "end", "t").agg(*[F.sum(F.col(c) * F.col("_sign")).alias(c) for c in held])
    full = traces.where("_na > 0 and _nb > 0").select("cell", "zone", "start", "end", (F.col("_na") + F.col("_nb")).alias("_n"), (F.col("_sa") / F.col("_na")).alias("a"), (F.col("_sb") / F.col("_nb")).alias("b"))
    g = full.groupBy("cell", "zone", "start", "end").agg(F.max("_n").alias("n_voxels"), F.corr("a", "b").alias("_r")).where(F.col("n_voxels") >= voxels)
    return g.select("cell", "zone", "start", "end", "n_voxels", F.when(F.col("_r") > -0.99, 2 * F.col("_r") / (1 + F.col("_r"))).alias("reliability"))


def place_regions(vox: DataFrame, zones: DataFrame, target: float = 20.0, least: float = 5.0, step: float = 2.0, voxels: int = 25) -> DataFrame:
    """The window of each zone with the largest reliability: ``cell, zone, start, end, n_voxels, reliability``.

    Of equal ones (to 9 digits) the shorter, then the first.  Zones without a window of a known reliability are left out.
    """
    scored = window_reliability(vox, candidate_windows(zones, target, least, step), voxels).where("reliability is not null and not isnan(reliability)")
    best = F.min(F.struct((-F.round("reliability", 9)).alias("r"), F.round(F.col("end") - F.col("start"), 9).alias("n"), "start", "end", "n_voxels", "reliability"))
    return scored.groupBy("cell", "zone").agg(best.alias("_b")).select("cell", "zone", "_b.start", "_b.end", "_b.n_voxels", "_b.reliability")
