"""Voxel and graph operators on sparse tables of integer coordinates."""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.ranking import place
from lamina.sources.readers import shared_path, staged


def offsets(axes: list[str], reach: dict[str, int] | None = None, faces: bool = False):
    """Neighbour steps along axes, without the zero step; ``faces``: one axis at a time."""
    steps = itertools.product(*[range(-(reach or {}).get(a, 1), (reach or {}).get(a, 1) + 1) for a in axes])
    return [s for s in steps if any(s) and (not faces or sum(map(abs, s)) == 1)]


def shifted(vox: DataFrame, on: list[str], axes: list[str], steps) -> DataFrame:
    """Each voxel moved by each step."""
    step = F.explode(F.array(*[F.struct(*[F.lit(int(v)).alias(a) for a, v in zip(axes, s, strict=True)]) for s in steps]))
    return vox.select(*on, *axes, step.alias("_s")).select(*on, *[(F.col(a) + F.col(f"_s.{a}")).alias(a) for a in axes])


def dilate(vox: DataFrame, on: list[str], axes: list[str], box: dict[str, tuple[int, int]]) -> DataFrame:
    """Voxels within one step of a voxel, inside the box."""
    out = vox.select(*on, *axes).unionByName(shifted(vox, on, axes, offsets(axes))).distinct()
    for a, (lo, hi) in box.items():
        out = out.where(F.col(a).between(lo, hi))
    return out


def erode(vox: DataFrame, on: list[str], axes: list[str]) -> DataFrame:
    """Voxels whose whole neighbourhood is set; beyond the edge counts as unset."""
    steps = offsets(axes)
    n = shifted(vox, on, axes, steps).groupBy(*on, *axes).agg(F.count("*").alias("_n")).where(F.col("_n") == len(steps)).drop("_n")
    return vox.select(*on, *axes).join(n, [*on, *axes], "left_semi")


def close(vox: DataFrame, on: list[str], axes: list[str]) -> DataFrame:
    """Closing: spread to all neighbours, then keep the cells all of whose neighbourhood is covered."""
    steps = [tuple([0] * len(axes)), *[s for s in offsets(axes) if any(s)]]
    grown = shifted(vox, on, axes, steps).select(*on, *axes).distinct()
    return shifted(grown, on, axes, steps).groupBy(*on, *axes).agg(F.count("*").alias("_n")).where(F.col("_n") == len(steps)).drop("_n")


def fill_holes(vox: DataFrame, space: DataFrame, on: list[str], axes: list[str], box: dict[str, tuple[int, int]]) -> DataFrame:
    """The mask and the cells of ``space`` that no path of faces through the rest joins to the box's edge."""
    from lamina.operators.tiles import pieces

    cells = space.select(*on, *axes, F.lit(False).alias("_set"), F.lit(True).alias("_own")).unionByName(vox.select(*on, *axes, F.lit(True).alias("_set"), F.lit(False).alias("_own")))
    cells = staged(cells.groupBy(*on, *axes).agg(F.bool_or("_set").alias("_set"), F.bool_or("_own").alias("_own")).where("_own").drop("_own"), "space")
    edge = F.lit(False)
    for a, (lo, hi) in box.items():
        edge = edge | (F.col(a) == lo) | (F.col(a) == hi)
    edge = F.coalesce(edge, F.lit(False))
    known = reduce(lambda c, a: c & F.col(a).isNotNull(), [*on, *axes], F.lit(True))
    # A cell without a place meets no other.
    kept = cells.where((known & F.col("_set")) | (~known & ~edge)).select(*on, *axes)
    rest = cells.where(known & ~F.col("_set")).select(*on, *axes, edge.alias("_edge"))
    return kept.unionByName(pieces(rest, on, axes, "_edge", faces=True).where("not marked").select(*on, *axes))


def neighbour_edges(vox: DataFrame, on: list[str], axes: list[str], key: str, faces: bool = False) -> DataFrame:
    """Pairs ``src < dst`` of keys of neighbouring voxels."""
    half = [s for s in offsets(axes, faces=faces) if s > tuple([0] * len(axes))]
    step = F.explode(F.array(*[F.struct(*[F.lit(int(v)).alias(a) for a, v in zip(axes, s, strict=True)]) for s in half]))
    moved = vox.select(*on, F.col(key).alias("_k"), *axes, step.alias("_s")).select(*on, "_k", *[(F.col(a) + F.col(f"_s.{a}")).alias(a) for a in axes])
    return moved.join(vox.select(*on, *axes, key), [*on, *axes]).select(*on, F.least("_k", key).alias("src"), F.greatest("_k", key).alias("dst"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, root`` with root the least id reachable, by min-label spreading with pointer jumps."""
    shared_path(nodes.sparkSession, "")  # makes sure that there is a folder for checkpoints
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().checkpoint()
    labels = nodes.select("id", F.col("id").alias("root")).checkpoint()
    while True:  # labels only fall, so this ends
        near = both.join(labels.select(F.col("id").alias("dst"), "root"), "dst").groupBy("src").agg(F.min("root").alias("_n"))
        new = labels.join(near, labels.id == near.src, "left").select("id", F.least("root", F.coalesce("_n", "root")).alias("root"), F.col("root").alias("_old"))
        jump = new.select(F.col("id").alias("_i"), F.col("root").alias("_r"))
        new = new.join(jump, new.root == jump["_i"]).select("id", F.least("root", "_r").alias("root"), "_old").checkpoint()
        done = new.where("root <> _old").isEmpty()
        labels = new.drop("_old")
        if done:
            return labels


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``id, dist`` from the nearest source over ``src, dst, w``, relaxed a frontier at a time; no w may be negative."""
    if not edges.where("w < 0").isEmpty():
        raise ValueError("a negative weight")
    shared_path(edges.sparkSession, "")
    both = edges.select("src", "dst", "w").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).checkpoint()
    dist = sources.select("id", F.lit(0.0).alias("dist")).checkpoint()
    front = dist
    while True:  # distances only fall, so this ends
        step = front.join(both, front.id == both.src).groupBy("dst").agg(F.min(F.col("dist") + F.col("w")).alias("_d"))
        new = dist.join(step, dist.id == step.dst, "full_outer").select(F.coalesce("id", "dst").alias("id"), F.least("dist", "_d").alias("dist"), (F.col("dist").isNull() | (F.col("_d") < F.col("dist"))).alias("_better")).checkpoint()
        front = new.where("_better").select("id", "dist")
        dist = new.select("id", "dist")
        if front.isEmpty():
            return dist


def nearest_set_distance(vox: DataFrame, targets: DataFrame, axes: list[str], spacing: list[float], reach: int) -> DataFrame:
    """The least anisotropic distance to a target within ``reach`` steps of each axis, else null."""
    near = shifted_with(targets, axes, reach)
    d = F.sqrt(sum((((F.col(a) - F.col(f"_t_{a}")) * s) ** 2 for a, s in zip(axes, spacing, strict=True)), F.lit(0.0)))
    got = vox.select(*axes).join(near, axes).groupBy(*axes).agg(F.min(d).alias("dist"))
    return vox.select(*axes).join(got, axes, "left")


def shifted_with(vox: DataFrame, axes: list[str], reach: int) -> DataFrame:
    """Targets spread over the cells within reach, each with the target's own place."""
    out = vox.select(*[F.col(a).alias(f"_t_{a}") for a in axes])
    for a in axes:
        out = out.withColumn(a, F.explode(F.sequence(F.col(f"_t_{a}") - reach, F.col(f"_t_{a}") + reach)))
    return out


def overlap_scores(a: DataFrame, b: DataFrame, on: list[str], axes: list[str]) -> DataFrame:
    """Dice, IoU, precision and recall of set b against the reference set a."""
    j = a.select(*on, *axes, F.lit(1).alias("_a")).join(b.select(*on, *axes, F.lit(1).alias("_b")), [*on, *axes], "full_outer")
    g = j.groupBy(*on).agg(F.sum(F.coalesce("_a", F.lit(0))).alias("na"), F.sum(F.coalesce("_b", F.lit(0))).alias("nb"), F.sum(F.coalesce(F.col("_a") * F.col("_b"), F.lit(0))).alias("tp"))
    z = lambda n, d: n / F.nullif(d, F.lit(0))
    return g.select(*on, "tp", (F.col("nb") - F.col("tp")).alias("fp"), (F.col("na") - F.col("tp")).alias("fn"), z(2 * F.col("tp"), F.col("na") + F.col("nb")).alias("dice"), z(F.col("tp"), F.col("na") + F.col("nb") - F.col("tp")).alias("iou"), z(F.col("tp"), F.col("nb")).alias("precision"), z(F.col("tp"), F.col("na")).alias("recall"))


def overlay(layers: DataFrame, key: list[str], order: str, label: str) -> DataFrame:
    """The label painted last on each voxel."""
    return layers.groupBy(*key).agg(F.max_by(label, order).alias(label))


def relabel(df: DataFrame, label: str, part: list[str]) -> DataFrame:
    """Labels renumbered from 1 without gaps, inside each ``part`` or over the whole table; 0 stays background."""
    lab = df.where(F.col(label) > 0).select(*part, label).distinct()
    lab = lab.withColumn("new_label", F.row_number().over(Window.partitionBy(*part).orderBy(label))) if part else place(lab, label, name="new_label")
    return df.join(lab, [*part, label], "left").withColumn("new_label", F.coalesce("new_label", F.lit(0)))


def dp_path(df: DataFrame, on: list[str], x: str, y: str, cost: str, move: int = 2, penalty: float = 1.0) -> DataFrame:
    """The cheapest path with one y for each x, moves of at most ``move`` and a cost of ``penalty`` a
    step; one image of one key a task."""
    schema = ", ".join(f"{n} {t}" for n, t in df.select(*on, x, y).dtypes) + ", total double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index=y, columns=x, values=cost, aggfunc="min").fillna(np.inf)
        ys, c = m.index.to_numpy(), m.to_numpy()
        best, back = c[:, 0].copy(), []
        for j in range(1, c.shape[1]):
            far = np.abs(ys[:, None] - ys[None, :])
            step = np.where(far <= move, best[None, :] + penalty * far, np.inf)
            back.append(step.argmin(1))
            best = step.min(1) + c[:, j]
        k = int(best.argmin())
        path = [k]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        out = pd.DataFrame({x: m.columns, y: ys[path[::-1]], "total": float(best.min())})
        for o in on:
            out[o] = pdf[o].iloc[0]
        return out[[*on, x, y, "total"]]

    return df.select(*on, x, y, cost).groupBy(*on).applyInPandas(run, schema)


def neighbour_correlation(vox: DataFrame, t: str, axes: list[str], v: str) -> DataFrame:
    """The largest correlation over time of a voxel with a face neighbour, at least 0.

    Voxels are spread to their neighbours' places and meet them by place and time.
    """
    step = F.explode(F.array(*[F.struct(*[F.lit(s).alias(a) for a, s in zip(axes, st, strict=True)]) for st in offsets(axes, faces=True)]))
    moved = vox.select(t, *axes, F.col(v).alias("_w"), step.alias("_s")).select(t, "_w", "_s", *[(F.col(a) + F.col(f"_s.{a}")).alias(a) for a in axes])
    r = vox.join(moved, [t, *axes]).groupBy(*axes, "_s").agg(F.corr(v, "_w").alias("r"))
    return r.groupBy(*axes).agg(F.greatest(F.lit(0.0), F.max("r")).alias("r"))
