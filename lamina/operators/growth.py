"""Smoothing, high-pass, seeded growth by co-fluctuation, and redundancy of planes."""

from __future__ import annotations

from functools import reduce
from math import exp

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators.series import add_group, rolling_mean
from lamina.operators.tiles import pieces
from lamina.operators.volume import components, neighbour_edges
from lamina.sources.readers import staged

Box = dict[str, tuple[int, int]]


def gaussian(vox: DataFrame, on: list[str], box: Box, sigma: dict[str, float], v: str) -> DataFrame:
    """Gaussian smoothing of full boxes, one axis at a time: ``on``, axes and ``v``.

    Weights reach 4 sigma; beyond the box cells are mirrored.  Each cell is spread to the places it counts for, and these add up, so an
    axis is one aggregate.  Axes without a positive ``sigma`` stay.
    """
    axes = list(box)
    now = vox.select(*on, *axes, F.col(v).cast("double").alias(v))
    for a, (lo, hi) in box.items():
        s = sigma.get(a, 0.0)
        if s <= 0:
            continue
        reach, n = int(4 * s + 0.5), hi - lo + 1
        weight = [exp(-k * k / (2 * s * s)) for k in range(reach + 1)]
        total = weight[0] + 2 * sum(weight[1:])
        turns = range(-(reach // (2 * n)) - 1, reach // (2 * n) + 2)
        own, mirrored = F.col(a), 2 * lo - 1 - F.col(a)
        images = F.explode(F.array(*[x + 2 * n * t for t in turns for x in (own, mirrored)]))
        spread = now.select(*on, *[b for b in axes if b != a], v, images.alias("_p")).where(F.col("_p").between(lo - reach, hi + reach))
        to = F.explode(F.sequence(F.greatest(F.lit(lo), F.col("_p") - reach), F.least(F.lit(hi), F.col("_p") + reach)))
        spread = spread.withColumn("_q", to)
        w = F.element_at(F.array(*[F.lit(x / total) for x in weight]), F.abs(F.col("_q") - F.col("_p")).cast("int") + 1)
        now = spread.groupBy(*on, *[b for b in axes if b != a], F.col("_q").cast(vox.schema[a].dataType).alias(a)).agg(F.sum(w * F.col(v)).alias(v)).select(*on, *axes, v)
    return now


def high_pass(vox: DataFrame, on: list[str], box: Box, small: dict[str, float], large: dict[str, float], v: str) -> DataFrame:
    """The difference of two smoothings, at least 0: what stands out of a broad background."""
    one, two = gaussian(vox, on, box, small, v), gaussian(vox, on, box, large, v).withColumnRenamed(v, "_large")
    return one.join(two, [*on, *box]).select(*on, *box, F.greatest(F.lit(0.0), F.col(v) - F.col("_large")).alias(v))


def normalised(vox: DataFrame, on: list[str], v: str, share: float = 0.999) -> DataFrame:
    """``v`` over its percentile in each volume, where that is positive."""
    x = add_group(vox, on, _top=F.percentile(v, share)) if on else vox.join(F.broadcast(vox.agg(F.percentile(v, share).alias("_top"))))
    return x.withColumn(v, F.when(F.col("_top") > 0, F.col(v) / F.col("_top")).otherwise(F.col(v))).drop("_top")


def _pieces(cells: DataFrame, on: list[str], axes: list[str]) -> DataFrame:
    """Cells with the ``root`` of their connected piece."""
    named = staged(cells.select(*on, *axes).distinct().withColumn("id", F.xxhash64(*on, *axes)), "cells")
    return named.join(components(named.select("id"), neighbour_edges(named, on, axes, "id")), "id").select(*on, *axes, "root")


def keep_touching(candidates: DataFrame, seeds: DataFrame, on: list[str], axes: list[str]) -> DataFrame:
    """The candidate cells whose connected piece holds a seed."""
    known = candidates.select(*on, *axes, F.lit(True).alias("_own"), F.lit(False).alias("_seed")).unionByName(seeds.select(*on, *axes, F.lit(False).alias("_own"), F.lit(True).alias("_seed"))).dropna(subset=[*on, *axes])
    cells = known.groupBy(*on, *axes).agg(F.bool_or("_own").alias("_own"), F.bool_or("_seed").alias("_seed")).where("_own")
    return pieces(cells, on, axes, "_seed").where("marked").select(*on, *axes)


def seed_correlation(vox: DataFrame, seeds: DataFrame, on: list[str], t: str, axes: list[str], v: str, window: int = 0) -> DataFrame:
    """``on``, axes, ``r`` (correlation over time with the mean trace of the seeds) and ``mean`` of each cell.

    With a ``window`` each trace loses its running mean first, ends repeated.  The seeds' trace comes from partial sums and meets the cells by time.
    """
    x = vox.select(*on, *axes, F.col(t).alias("t"), F.col(v).cast("double").alias("v"))
    mean = x.groupBy(*on, *axes).agg(F.avg("v").alias("mean"))
    if window > 1:
        x = rolling_mean(x, [*on, *axes], "v", window, "nearest").withColumn("v", F.col("v") - F.col("smooth")).drop("smooth")
    x = staged(x.select(*on, *axes, "t", "v"), "traces")
    trace = x.join(seeds.select(*on, *axes).distinct(), [*on, *axes], "left_semi").groupBy(*on, "t").agg(F.avg("v").alias("_s"))
    return x.join(trace, [*on, "t"]).groupBy(*on, *axes).agg(F.corr("v", "_s").alias("r")).join(mean, [*on, *axes])


def grow_by_seed(scored: DataFrame, seeds: DataFrame, on: list[str], axes: list[str], least: float, keep: float, share: float = 0.0, close: str | None = None, width: int = 1, apart: float | None = None, cells: int = 1) -> DataFrame:
    """The connected growth of seeds over cells that follow them: ``on`` and axes.

    Args: ``scored``: ``seed_correlation``'s rows.  Cells with r over ``least`` count; with a ``share`` only those brighter than that percentile of the volume, or with r of
    ``keep`` or more.  Along ``close`` gaps of up to ``width`` - 1 (an odd width) cells are filled.  Pieces that hold a seed stay, and so do pieces of at least ``cells`` cells whose mean r is ``apart`` or
    more.  Smaller pieces go.  Where no piece stays, no cell comes out.
    """
    x = add_group(scored, on, _cut=F.percentile("mean", share)) if on else scored.join(F.broadcast(scored.agg(F.percentile("mean", share).alias("_cut"))))
    gate = (F.col("mean") > F.col("_cut")) | (F.col("r") >= keep) if share > 0 else F.lit(True)
    region = x.where((F.col("r") > least) & gate).select(*on, *axes)
    if close and width > 1:
        half = F.explode(F.sequence(F.lit(-(width // 2)), F.lit(width // 2)))
        moved = lambda df: df.withColumn("_k", half).select(*on, *[(F.col(a) + F.col("_k")).cast(scored.schema[a].dataType).alias(a) if a == close else F.col(a) for a in axes])
        wide = moved(region).distinct()
        filled = moved(wide).groupBy(*on, *axes).agg(F.count("*").alias("_n")).where(F.col("_n") == width)
        region = filled.select(*on, *axes).join(scored.select(*on, *axes), [*on, *axes], "left_semi").unionByName(region).distinct()
    found = staged(_pieces(region, on, axes), "pieces").join(scored.select(*on, *axes, "r"), [*on, *axes], "left")
    marked = seeds.select(*on, *axes).distinct().withColumn("_seed", F.lit(True))
    told = found.join(marked, [*on, *axes], "left").groupBy("root").agg(F.count("*").alias("_n"), F.avg("r").alias("_r"), F.bool_or(F.coalesce("_seed", F.lit(False))).alias("_has"))
    far = F.col("_r") >= apart if apart is not None else F.lit(False)
    return found.join(told.where((F.col("_has") | far) & (F.col("_n") >= cells)), "root", "left_semi").select(*on, *axes)


def plane_redundancy(vox: DataFrame, on: list[str], t: str, plane: str, axes: list[str], v: str) -> DataFrame:
    """How alike the planes of a stack are: ``on, n_frames, n_planes, pc1_share, n_comp_95, neighbour_r, first_last_r, equal_planes, mean_range``.

    On the mean over time: the first principal component's share of the squares about the grand mean and the components that make 95 % of it, the mean correlation
    of neighbouring planes, that of the first and last, and the range of plane means; on the first frame: neighbouring planes with equal cells.  Products of planes are summed by
    cell as they come, and only a matrix of planes by planes comes together.  Every plane must have the same cells.
    """
    x = vox.select(*on, F.col(t).alias("_t"), F.col(plane).alias("_p"), *axes, F.col(v).cast("double").alias("_v"))
    mean = staged(x.groupBy(*on, "_p", *axes).agg(F.avg("_v").alias("_m"), F.min_by("_v", "_t").alias("_first")), "planes")
    frames = x.groupBy(*on).agg(F.count_distinct("_t").alias("n_frames"))
    grand = mean.groupBy(*on).agg(F.avg("_m").alias("_g"))
    one = mean.join(grand, on).select(*on, "_p", *axes, (F.col("_m") - F.col("_g")).alias("_c"), "_first")
    two = one.withColumnsRenamed({"_p": "_q", "_c": "_d", "_first": "_other"})
    pairs = one.join(two, [*on, *axes]).where("_p <= _q").groupBy(*on, "_p", "_q").agg(F.sum(F.col("_c") * F.col("_d")).alias("_s"), F.corr("_c", "_d").alias("_r"), F.bool_and(F.col("_first").eqNullSafe(F.col("_other"))).alias("_same"))
    level = mean.groupBy(*on, "_p").agg(F.avg("_m").alias("_m")).groupBy(*on).agg((F.max("_m") - F.min("_m")).alias("mean_range"))
    kinds = ", ".join(f"{n} {k}" for n, k in pairs.select(*on).dtypes)

    def spectrum(pdf: pd.DataFrame) -> pd.DataFrame:
        places = np.unique(pdf["_p"])
        i, j = np.searchsorted(places, pdf["_p"]), np.searchsorted(places, pdf["_q"])
        gram, r = np.zeros((len(places),) * 2), np.full((len(places),) * 2, np.nan)
        gram[i, j] = gram[j, i] = pdf["_s"]
        r[i, j] = pdf["_r"]
        same = np.zeros(gram.shape, bool)
        same[i, j] = pdf["_same"]
        share = np.sort(np.clip(np.linalg.eigvalsh(gram), 0, None))[::-1]
        share = share / share.sum() if share.sum() > 0 else np.full(len(share), np.nan)
        near = np.arange(len(places) - 1)
        out = {"n_planes": len(places), "pc1_share": share[0], "n_comp_95": int(np.searchsorted(np.cumsum(share), 0.95) + 1), "neighbour_r": r[near, near + 1].mean() if len(near) else np.nan, "first_last_r": r[0, -1] if len(near) else np.nan, "equal_planes": int(same[near, near + 1].sum())}
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in on}, **out}])

    found = pairs.groupBy(*on).applyInPandas(spectrum, f"{kinds}, n_planes long, pc1_share double, n_comp_95 long, neighbour_r double, first_last_r double, equal_planes long")
    number = [F.when(~F.isnan(k), F.col(k)).alias(k) if k in ("pc1_share", "neighbour_r", "first_last_r") else F.col(k) for k in ("n_planes", "pc1_share", "n_comp_95", "neighbour_r", "first_last_r", "equal_planes")]
    return reduce(lambda a, b: a.join(b, on), [found.select(*on, *number), frames, level])
