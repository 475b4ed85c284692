"""Centroid clustering of integer vectors by dual-tree Lloyd rounds.

Each task reads blocks of vectors and keeps a cover tree of each block: points under a node lie within
its radius, its children within half of it.  A round makes a tree over the centroids and walks
pairs of a vector node and a centroid node.  A pair goes when the least distance between its members
exceeds the greatest one to a centroid that is known; a vector node with one centroid left goes to it whole;
pairs of leaves are compared exactly, in integers.  Bounds only skip work, so results are Lloyd's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.shared import packed, stage, unpacked

#: Vectors of one block and of one leaf.
BLOCK, LEAF = 2048, 24
#: Components below this keep squared distances of up to 64 components in 64 bits.
LARGEST = 1 << 27
#: All tasks get the centroids: at most so many numbers.
MOST_NUMBERS = 1 << 22
#: Pairs of a vector and a centroid that are compared at a time.
PAIRS = 1 << 14


class CoverTree:
    """A cover tree of a few thousand integer points, as arrays by node.

    ``order`` are the points, those under a node next to each other at ``start:end``; ``centre`` is one of
    them, ``radius`` the greatest distance from it; children are ``first:last``, leaves have none.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF, arrays=None):
        if arrays is not None:
            self.order, self.centre, self.radius, self.start, self.end, self.first, self.last = arrays
            return
        n, real = len(x), x.astype(np.float64)
        far = np.sqrt(((real - real[0]) ** 2).sum(1)) if n else np.zeros(0)
        order, nodes, todo = np.arange(n), [], [(0, n, far, float(far.max(initial=0)))] if n else []
        if n:
            nodes.append([0, float(far.max()), 0, n, 0, 0])
        at = 0
        while at < len(todo):
            a, b, dist, radius = todo[at]
            if b - a > leaf and radius > 0:
                # Children: each next centre is the first point that no earlier child covers within half the radius.
                left, spans = order[a:b], []
                far, cover = dist, radius / 2
                while len(left):
                    near = far <= cover
                    spans.append((left[near], far[near]))
                    left = left[~near]
                    if len(left):
                        far = np.sqrt(((real[left] - real[left[0]]) ** 2).sum(1))
                nodes[at][4:] = len(nodes), len(nodes) + len(spans)
                for members, d in spans:
                    order[a : a + len(members)] = members
                    nodes.append([members[0], float(d.max()), a, a + len(members), 0, 0])
                    todo.append((a, a + len(members), d, float(d.max())))
                    a += len(members)
            at += 1
        self.order = order
        columns = list(zip(*nodes, strict=True)) or [()] * 6
        self.centre, self.start, self.end, self.first, self.last = (np.array(columns[i], np.int64) for i in (0, 2, 3, 4, 5))
        self.radius = np.array(columns[1], np.float64)


def _distances(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of x[a[i]] and y[b[i]]."""
    out = np.zeros(len(a), np.int64)
    for i in range(0, len(a), PAIRS):
        d = x[a[i : i + PAIRS]] - y[b[i : i + PAIRS]]
        out[i : i + PAIRS] = np.einsum("ij,ij->i", d, d)
    return out


def _children(first: np.ndarray, last: np.ndarray):
    """Row and child of every child of the rows."""
    n = last - first
    row = np.repeat(np.arange(len(first)), n)
    return row, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def nearest_centroids(x: np.ndarray, tree: CoverTree, c: np.ndarray, over: CoverTree) -> tuple[np.ndarray, int]:
    """The nearest centroid of every point, ties to the smaller number, and how many pairs were compared exactly."""
    out, compared = np.zeros(len(x), np.int64), 0
    if not len(x):
        return out, 0
    known = np.full(len(tree.centre), np.inf)
    v, w = np.zeros(1, np.int64), np.zeros(1, np.int64)
    at, to = [], []
    while len(v):
        apart = np.sqrt(_distances(x, tree.centre[v], c, over.centre[w]).astype(np.float64))
        slack = 1e-9 * apart + 1e-6
        np.minimum.at(known, v, apart + tree.radius[v] + slack)
        stays = apart - tree.radius[v] - over.radius[w] - slack <= known[v]
        v, w = v[stays], w[stays]
        single, whole = over.end[w] - over.start[w] == 1, np.bincount(v, minlength=len(known)) == 1
        done = single & whole[v]
        for i, j in zip(v[done], w[done], strict=True):
            out[tree.order[tree.start[i] : tree.end[i]]] = over.centre[j]
        v, w = v[~done], w[~done]
        # A vector node moves with all its pairs: down, into the centroid tree, or to be compared.
        v_leaf, w_leaf = tree.first[v] == tree.last[v], over.first[w] == over.last[w]
        widest, inner = np.zeros(len(known)), np.zeros(len(known), bool)
        np.maximum.at(widest, v, over.radius[w])
        inner[v[~w_leaf]] = True
        exact, down = v_leaf & ~inner[v], ~v_leaf & (~inner[v] | (tree.radius[v] >= widest[v]))
        at.append(v[exact])
        to.append(w[exact])
        row, child = _children(tree.first[v[down]], tree.last[v[down]])
        np.minimum.at(known, child, known[v[down]][row])
        waits, across = ~exact & ~down & w_leaf, ~exact & ~down & ~w_leaf
        row2, child2 = _children(over.first[w[across]], over.last[w[across]])
        v, w = np.r_[child, v[waits], v[across][row2]], np.r_[w[down][row], w[waits], child2]
    v, w = np.concatenate(at), np.concatenate(to)
    row, place = _children(over.start[w], over.end[w])
    v, cents = v[row], over.order[place]
    row, place = _children(tree.start[v], tree.end[v])
    points, cents = tree.order[place], cents[row]
    if len(points):
        d = _distances(x, points, c, cents)
        best = np.lexsort((cents, d, points))
        points, cents, compared = points[best], cents[best], len(d)
        new = np.r_[True, points[1:] != points[:-1]]
        out[points[new]] = cents[new]
    return out, compared


BLOCKS = "n long, width int, ids binary, vectors binary, nodes long, tree binary, radius binary"


def _blocks(width: int):
    def run(batches: Iterator[pa.RecordBatch]):
        ids, rows, held = [], [], 0

        def block():
            i, x = np.concatenate(ids), np.concatenate(rows)
            for a in range(0, len(i), BLOCK):
                part = np.ascontiguousarray(x[a : a + BLOCK])
                tree = CoverTree(part)
                shape = np.concatenate([tree.order, tree.centre, tree.start, tree.end, tree.first, tree.last])
                yield {"n": len(part), "width": width, "ids": packed(i[a : a + BLOCK]), "vectors": packed(part.ravel()), "nodes": len(tree.centre), "tree": packed(shape), "radius": packed(tree.radius)}

        schema = pa.schema([("n", pa.int64()), ("width", pa.int32()), *((k, pa.binary()) for k in ("ids", "vectors")), ("nodes", pa.int64()), ("tree", pa.binary()), ("radius", pa.binary())])
        for batch in batches:
            ids.append(batch.column(0).to_numpy(zero_copy_only=False))
            rows.append(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
            held += len(batch)
            if held >= BLOCK:
                yield pa.RecordBatch.from_pylist(list(block()), schema)
                ids, rows, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_pylist(list(block()), schema)

    return run


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, CoverTree]:
    n, width, m = row["n"], row["width"], row["nodes"]
    shape = unpacked(row["tree"], n + 5 * m, np.int64)
    order, (centre, start, end, first, last) = shape[:n], shape[n:].reshape(5, m)
    return unpacked(row["ids"], n, np.int64), unpacked(row["vectors"], n * width, np.int64).reshape(n, width), CoverTree(None, arrays=(order, centre, unpacked(row["radius"], m, np.float64), start, end, first, last))


def _sums(centroids: np.ndarray):
    """A task's count and sums of each cluster."""

    def run(batches):
        total, count = np.zeros(centroids.shape, object), np.zeros(len(centroids), np.int64)
        over = CoverTree(centroids, leaf=1)
        for batch in batches:
            for row in batch.to_pylist():
                _, x, tree = _opened(row)
                got, _ = nearest_centroids(x, tree, centroids, over)
                part = np.zeros(centroids.shape, np.int64)
                np.add.at(part, got, x)
                total += part
                count += np.bincount(got, minlength=len(centroids))
        has = np.flatnonzero(count)
        cols = [pa.array(has, pa.int32()), pa.array(count[has], pa.int64()), pa.array([[int(z) for z in total[i]] for i in has], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, ["cluster", "n", "sums"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches):
        over = CoverTree(centroids, leaf=1)
        for batch in batches:
            for row in batch.to_pylist():
                ids, x, tree = _opened(row)
                got, _ = nearest_centroids(x, tree, centroids, over)
                d = _distances(x, np.arange(len(x)), centroids, got)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(got, pa.int32()), pa.array(d)], ["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, k: int, rounds: int, width: int, scale: int, seed_order: Column) -> DataFrame:
    """Lloyd's rounds over floored integer vectors, then one more assignment.

    Args: ``vectors`` with long ``vec_id`` and array ``embedding``; other columns are ignored.  Kept are those of
    ``width`` components, none null or not finite, as integers floor(scale * x).  The ``k`` with the least
    ``seed_order`` (ties: the lesser components) are the first centroids.  Every round assigns each vector to the nearest centroid (squared
    Euclidean distance; ties: smaller number) and moves non-empty centroids to floor(sum / count).
    Returns ``vec_id, cluster, distance, cluster_inertia, inertia`` and the final ``centroid`` of the cluster.

    Null and repeated vec_ids are kept as rows of their own.  With fewer than ``k`` kept vectors there are as many
    centroids; with none, no row comes out.  Equal centroids tie to the smaller number.  Raises if an
    integer is 2**27 or more, as squared distances might not fit 64 bits, or if k * width is over 2**22.
    """
    if k * width > MOST_NUMBERS or width > 128:
        raise ValueError(f"at most {MOST_NUMBERS} numbers of centroids and 128 components")
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v: v)
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.where(F.size("embedding") == width).where(good).withColumn("_order", seed_order)
    fits = F.forall(x, lambda v: F.abs(v) * scale < LARGEST)
    whole = F.when(fits, F.transform(x, lambda v: F.floor(v * scale))).otherwise(F.raise_error(F.lit(f"a component is {LARGEST} or more after scaling")))
    named = kept.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"), "_order")
    # k rows of a bounded number of components.
    first = named.orderBy("_order", "x").limit(k).select("x").collect()
    centroids = np.array([r["x"] for r in first], np.int64).reshape(-1, width)
    filled = F.coalesce(F.col("vec_id"), F.lit(0))
    blocks = stage(named.select(F.struct(F.col("vec_id").isNull().alias("unnamed"), filled.alias("id")).alias("_id"), "x").select("_id.id", "x", "_id.unnamed").where("not unnamed").select("id", "x").mapInArrow(_blocks(width), BLOCKS), "vector-blocks")
    unnamed = stage(named.where("vec_id is null").select(F.lit(0).cast("long").alias("id"), "x").mapInArrow(_blocks(width), BLOCKS), "unnamed-blocks")
    both = blocks.withColumn("named", F.lit(True)).unionByName(unnamed.withColumn("named", F.lit(False)))
    if len(centroids):
        for _ in range(rounds):
            parts = both.drop("named").mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>")
            sums = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
            for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():
                centroids[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    assign = lambda b: b.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long")
    rows = stage(assign(blocks).unionByName(assign(unnamed).withColumn("vec_id", F.lit(None).cast("long"))), "assigned")
    inertia = {r["cluster"]: int(r["d"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    total = sum(inertia.values())
    last = vectors.sparkSession.createDataFrame([(i, inertia.get(i, 0), total, c.tolist()) for i, c in enumerate(centroids)], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return rows.join(F.broadcast(last), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
