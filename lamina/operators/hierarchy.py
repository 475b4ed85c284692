"""Ward clustering by rounds of mutual nearest neighbours, and the number of clusters by silhouettes."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators.ranking import place
from lamina.operators.volume import components
from lamina.sources.readers import staged

#: Rows of one block; tasks compare two blocks at a time.
BLOCK = 512


def standardised(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """``id, x``: complete rows, each feature less its mean over its standard deviation (of the sample, plus 1e-9)."""
    whole = reduce(lambda c, f: c & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")), features, F.col(key).isNotNull())
    rows = df.where(whole).select(F.col(key).alias("id"), *[F.col(f).cast("double").alias(f) for f in features])
    scale = rows.agg(*[g for f in features for g in (F.avg(f).alias(f"_m_{f}"), F.stddev_samp(f).alias(f"_s_{f}"))])
    x = F.array(*[(F.col(f) - F.col(f"_m_{f}")) / (F.coalesce(f"_s_{f}", F.lit(0.0)) + 1e-9) for f in features])
    return rows.join(F.broadcast(scale)).select("id", x.alias("x"))


def _block_pairs(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Each block of the left rows with each block of the right ones, as lists of structs ``a`` and ``b``."""
    n = max(1, -(-right.count() // BLOCK))
    m = max(1, -(-left.count() // BLOCK))
    packed = lambda df, k, name: df.groupBy(F.pmod(F.xxhash64("id"), F.lit(k)).alias(f"_{name}")).agg(F.collect_list(F.struct(*columns)).alias(name))
    spread = packed(left, m, "a").withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return spread.join(packed(right, n, "b"), "_b").select("a", "b")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances as sums of squared differences, the same both ways round."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += (a[:, j][:, None] - b[:, j][None]) ** 2
    return out


def ward_merges(points: DataFrame) -> DataFrame:
    """All merges of Ward's clustering: ``a, b, height``; a < b are the least ids of the clusters, and a names the new one.

    Args: ``points`` with a unique long ``id`` and an array ``x`` of one length.
    Each round finds every cluster's nearest by the growth of the sum of squares, nA nB / (nA + nB) |cA - cB|^2, and merges the pairs that are nearest to
    each other; as merging brings no cluster nearer to others, these are merges of the one-at-a-time order too.  Pairs are ordered by distance
    and ids, so ties can't go in a circle.  Clusters meet in blocks.  ``height`` is the square root of twice the growth.
    """
    live = staged(points.select(F.col("id").cast("long").alias("id"), F.lit(1.0).alias("n"), "x"), "clusters")
    merges = None

    def nearest(batches):
        for batch in batches:
            ids, dists, others = [], [], []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                (i, n, x), (j, m, y) = ((v.field("id").to_numpy(), v.field("n").to_numpy(), _matrix(v.field("x"))) for v in (a.values, b.values))
                d = n[:, None] * m[None] / (n[:, None] + m[None]) * _squares(x, y)
                d[i[:, None] == j[None]] = np.inf
                least = d.min(1)
                for r in np.flatnonzero(np.isfinite(least)):
                    tied = j[d[r] == least[r]]
                    # Of equal pairs the one with the least ids.
                    o = min(tied.tolist(), key=lambda t, own=int(i[r]): (min(t, own), max(t, own)))
                    ids.append(int(i[r]))
                    dists.append(float(least[r]))
                    others.append(o)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dists, pa.float64()), pa.array(others, pa.int64())], ["id", "d", "other"])

    while live.count() > 1:
        found = _block_pairs(live, live, ["id", "n", "x"]).mapInArrow(nearest, "id long, d double, other long")
        pair = F.struct("d", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
        best = found.groupBy("id").agg(F.min(pair).alias("p")).select("id", "p.*")
        both = staged(best.groupBy("a", "b").agg(F.count("*").alias("c"), F.first("d").alias("d")).where("c = 2").select("a", "b", F.sqrt(2 * F.col("d")).alias("height")), "merges")
        merges = both if merges is None else merges.unionByName(both)
        one, two = live.withColumnsRenamed({"id": "a", "n": "_n", "x": "_x"}), live.withColumnsRenamed({"id": "b", "n": "_m", "x": "_y"})
        joined = both.join(one, "a").join(two, "b").select(F.col("a").alias("id"), (F.col("_n") + F.col("_m")).alias("n"), F.zip_with("_x", "_y", lambda p, q: (p * F.col("_n") + q * F.col("_m")) / (F.col("_n") + F.col("_m"))).alias("x"))
        gone = both.select(F.explode(F.array("a", "b")).alias("id"))
        live = staged(live.join(gone, "id", "left_anti").unionByName(joined), "clusters")
    return merges if merges is not None else points.sparkSession.createDataFrame([], "a long, b long, height double")


def cut_tree(points: DataFrame, merges: DataFrame, counts: list[int]) -> DataFrame:
    """Clusters of each number: ``k, id, cluster``, clusters from 1 in the order of their least id."""
    n = points.count()
    ordered = staged(place(merges, "height", "a", "b"), "ordered-merges")
    ids = points.select(F.col("id").cast("long").alias("id"))
    out = None
    for k in counts:
        found = components(ids, ordered.where(F.col("place") <= n - k).select(F.col("a").alias("src"), F.col("b").alias("dst")))
        # A root is the least id of its cluster; there are k.
        names = place(found.select("root").distinct(), "root", name="cluster")
        part = found.join(names, "root").select(F.lit(k).alias("k"), "id", F.col("cluster").cast("int").alias("cluster"))
        out = part if out is None else out.unionByName(part)
    return out


def silhouettes(points: DataFrame, labels: DataFrame) -> DataFrame:
    """The mean silhouette of each clustering: ``k, silhouette``; points alone in their cluster count 0.

    ``labels``: ``k, id, cluster``.  Sums of distances from each point to each cluster come from blocks of points, for all clusterings at once.
    """
    held = labels.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("k").cast("string").alias("k"), "cluster"))).alias("_l"))
    keys = sorted(r["k"] for r in labels.select("k").distinct().collect())
    rows = staged(points.join(held, "id").select("id", "x", *[F.col("_l")[str(k)].alias(f"k{k}") for k in keys]), "labelled")

    def sums(batches):
        for batch in batches:
            cols = [[], [], [], []]
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                i, x, y = a.values.field("id").to_numpy(), _matrix(a.values.field("x")), _matrix(b.values.field("x"))
                d = np.sqrt(_squares(x, y))
                for k in keys:
                    c = b.values.field(f"k{k}").to_numpy()
                    for own in np.unique(c):
                        for col, v in zip(cols, (np.full(len(i), k), i, np.full(len(i), own), d[:, c == own].sum(1)), strict=True):
                            col.append(v)
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(cols, kinds, strict=True)], ["k", "id", "other", "d"])

    total = _block_pairs(rows, rows, ["id", "x", *[f"k{k}" for k in keys]]).mapInArrow(sums, "k int, id long, other int, d double").groupBy("k", "id", "other").agg(F.sum("d").alias("d"))
    size = labels.groupBy("k", F.col("cluster").alias("other")).agg(F.count("*").alias("n"))
    x = total.join(size, ["k", "other"]).join(labels, ["k", "id"])
    inside = F.max(F.when(F.col("other") == F.col("cluster"), F.col("d") / F.nullif(F.col("n") - 1, F.lit(0))))
    g = x.groupBy("k", "id").agg(inside.alias("_a"), F.min(F.when(F.col("other") != F.col("cluster"), F.col("d") / F.col("n"))).alias("_b"))
    s = F.when(F.col("_a").isNull(), 0.0).otherwise(F.coalesce((F.col("_b") - F.col("_a")) / F.nullif(F.greatest("_a", "_b"), F.lit(0.0)), F.lit(0.0)))
    return g.groupBy("k").agg(F.avg(s).alias("silhouette"))


def cell_types(df: DataFrame, key: str, features: list[str], most: int = 4, least: int = 6) -> DataFrame:
    """Types of cells by Ward clustering of standardised profiles: ``id, cell_type, k, silhouette``.

    ``k`` is the number from 2 to ``most`` (and below the cells) with the largest mean silhouette, the least of equal ones.  Rows with a null feature or key are left out;
    of fewer than ``least`` cells none is typed and no row comes out.  ``key`` is a unique long.
    """
    points = staged(standardised(df, key, features), "profiles")
    n = points.count()
    if n < least:
        return df.sparkSession.createDataFrame([], "id long, cell_type int, k int, silhouette double")
    labels = staged(cut_tree(points, staged(ward_merges(points), "merges"), list(range(2, min(most, n - 1) + 1))), "labels")
    best = silhouettes(points, labels).agg(F.max(F.struct(F.round("silhouette", 12).alias("s"), (-F.col("k")).alias("k"))).alias("_b")).select((-F.col("_b.k")).alias("k"), F.col("_b.s").alias("silhouette"))
    return labels.join(F.broadcast(best), "k").select("id", F.col("cluster").alias("cell_type"), "k", "silhouette")
