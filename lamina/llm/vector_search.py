"""Approximate nearest neighbours by multiprobe p-stable hashing.

The largest inner product becomes the least Euclidean distance when vectors are scaled to at
most unit length and given one more coordinate that fills them up to it.  Vectors are grouped
into bands of norms, each within a factor of sqrt(2) and scaled by its own longest, as short
vectors under one scale all look alike.  Each table hashes a vector to FUNCTIONS integers
floor((a x + b) / WIDTH) with Gaussian a.  In every band a query visits its own bucket and
those perturbed by -1, 0 or 1 in each function, in order of estimated success (the squared
distances to the crossed bounds); bands of at most WHOLE rows are scanned whole.  Buckets come
in packed blocks, so a full bucket is scanned by many tasks; each returns its best candidates
with exact scores, and the tables' candidates are merged.  Queries with fewer than k rows then
are scanned against all blocks.
"""

from __future__ import annotations

import itertools
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.shared import stage
from lamina.llm.vectors import matrix, usable

TABLES, FUNCTIONS, WIDTH, PROBES = 4, 3, 1.5, 9
BLOCK, QUERIES = 2048, 512
#: Rows that one task packs, about.
PACK = 16_384
#: Bands of one width; norms below the last but one share the last.
BANDS = 32


class Hashes:
    """The hash functions, the same for a seed and dimension wherever they are made."""

    def __init__(self, dim: int, tables: int, functions: int, w: float, seed: int):
        rng = np.random.default_rng([seed, dim, tables, functions])
        self.a = rng.normal(size=(tables, dim + 1, functions))
        self.b = rng.uniform(0, w, (tables, functions))
        self.w, self.tables = w, tables
        self.moves = np.array(list(itertools.product((-1, 0, 1), repeat=functions)))

    def places(self, x: np.ndarray, t: int) -> np.ndarray:
        return (x @ self.a[t] + self.b[t]) / self.w

    @staticmethod
    def name(cells: np.ndarray) -> np.ndarray:
        out = np.zeros(cells.shape[:-1], np.int64)
        for j in range(cells.shape[-1]):
            out = out * 1_000_003 + cells[..., j]
        return out

    def probes(self, f: np.ndarray, count: int) -> np.ndarray:
        """Bucket names of each row's ``count`` likeliest buckets."""
        cell = np.floor(f).astype(np.int64)
        part = f - cell
        score = np.zeros((len(f), len(self.moves)))
        for j in range(f.shape[1]):
            far = np.stack([part[:, j], np.zeros(len(f)), 1 - part[:, j]], 1)
            score += far[:, self.moves[:, j] + 1] ** 2
        best = np.argsort(score, axis=1, kind="stable")[:, :count]
        return self.name(cell[:, None, :] + self.moves[best])


def _packed(rows: DataFrame, h: Hashes, bands: dict[int, tuple[int, float, bool]], dtype, probes: int, most: int, copies: int) -> DataFrame:
    """Blocks ``t, band, bucket, ids, vecs`` of at most ``most`` rows; probes 0: index, else queries.

    ``bands``: from the bands of ``rows`` to one that they share, the log2 of its longest norm
    and whether it is scanned whole.  Such a band is table -1; its index rows come ``copies``
    times as so many buckets, of which all queries of a task take one.
    """
    shared = {(b, whole): top for b, top, whole in bands.values()}

    def run(batches):
        ids, xs, lgs, bs = [], [], [], []
        for batch in batches:
            ids.append(batch.column(0).to_numpy())
            xs.append(matrix(batch.column(1)))
            lgs.append(batch.column(2).to_numpy())
            bs.append(batch.column(3).to_numpy())
        if not ids:
            return
        ids, x, lg, band = (np.concatenate(c) for c in (ids, xs, lgs, bs))
        # Unit vectors, also of components whose squares overflow or vanish.
        u = x / np.abs(x).max(axis=1)[:, None]
        u /= np.linalg.norm(u, axis=1)[:, None]

        def blocks(t, b, row, flat):
            order = np.argsort(flat, kind="stable")
            row, flat = row[order], flat[order]
            heads = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
            cuts = np.concatenate([np.arange(i, j, most) for i, j in zip(heads, np.r_[heads[1:], len(flat)], strict=True)])
            ends = np.r_[cuts[1:], len(flat)]
            for part in range(0, len(cuts), 64):
                own = list(zip(cuts[part : part + 64], ends[part : part + 64], strict=True))
                yield pa.RecordBatch.from_arrays([
                    pa.array([t] * len(own), pa.int32()), pa.array([b] * len(own), pa.int32()), pa.array([int(flat[i]) for i, _ in own], pa.int64()),
                    pa.array([ids[row[i:j]].tobytes() for i, j in own], pa.binary()), pa.array([x[row[i:j]].astype(dtype).tobytes() for i, j in own], pa.binary()),
                ], ["t", "band", "bucket", "ids", "vecs"])

        everyone = np.arange(len(x))
        if probes:
            unit = np.c_[u, np.zeros(len(x))]
            salt = TaskContext.get().partitionId() % copies
            names = [h.probes(h.places(unit, t), probes) for t in range(h.tables)] if not all(w for _, w in shared) else []
            for b, whole in shared:
                if whole:
                    yield from blocks(-1, b, everyone, np.full(len(x), salt))
                else:
                    for t, name in enumerate(names):
                        yield from blocks(t, b, np.repeat(everyone, name.shape[1]), name.ravel())
            return
        to = np.array([bands[int(b)][0] for b in band])
        for (b, whole), top in shared.items():
            row = np.flatnonzero(to == b)
            if not len(row):
                continue
            if whole:
                for c in range(copies):
                    yield from blocks(-1, b, row, np.full(len(row), c))
                continue
            y = u[row] * np.exp2(lg[row] - top)[:, None]
            unit = np.c_[y, np.sqrt(np.maximum(0, 1 - np.sum(y * y, axis=1)))]
            for t in range(h.tables):
                yield from blocks(t, b, row, h.name(np.floor(h.places(unit, t)).astype(np.int64)))

    return rows.select("vec_id", "v", "lg", "band").mapInArrow(run, "t int, band int, bucket long, ids binary, vecs binary")


def _scan(pairs: DataFrame, dtype, k: int) -> DataFrame:
    """Each query's best candidates of a block: ``query, ids, scores``."""

    def run(batches):
        for batch in batches:
            for q_ids, q_vecs, ids, vecs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                qi, ci = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                q = np.frombuffer(q_vecs, dtype).reshape(len(qi), -1).astype(np.float64)
                c = np.frombuffer(vecs, dtype).reshape(len(ci), -1).astype(np.float64)
                s = q @ c.T
                s[qi[:, None] == ci[None, :]] = -np.inf
                # Rows that repeat a vec_id are one of the k.
                by = np.argsort(ci, kind="stable")
                head = np.flatnonzero(np.r_[True, np.diff(ci[by]) != 0])
                if len(head) > k:
                    one = s if len(head) == len(ci) else np.maximum.reduceat(s[:, by], head, axis=1)
                    cut = np.partition(one, len(head) - k, axis=1)[:, len(head) - k]
                    rows, cols = np.nonzero(s >= (cut - 1e-9 * np.maximum(1, np.abs(cut)))[:, None])
                else:
                    rows, cols = np.nonzero(s > -np.inf)
                own = s[rows, cols] > -np.inf
                rows, cols = rows[own], cols[own]
                # The same products summed in the same way for equal vectors, so ties are ties.
                exact = np.sum(q[rows] * c[cols], axis=1)
                order = np.lexsort((ci[cols], -exact, rows))
                rows, cols, exact = rows[order], cols[order], exact[order]
                if len(head) < len(ci):
                    first = np.sort(np.unique(np.stack([rows, ci[cols]], 1), axis=0, return_index=True)[1])
                    rows, cols, exact = rows[first], cols[first], exact[first]
                count = np.bincount(rows, minlength=len(qi))
                rank = np.arange(len(rows)) - np.r_[0, np.cumsum(count)][rows]
                keep = rank < k
                rows, cols, exact = rows[keep], cols[keep], exact[keep]
                offs = pa.array(np.r_[0, np.cumsum(np.bincount(rows, minlength=len(qi)))].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(qi), pa.ListArray.from_arrays(offs, pa.array(ci[cols])), pa.ListArray.from_arrays(offs, pa.array(exact))], ["query", "ids", "scores"])

    return pairs.mapInArrow(run, "query long, ids array<long>, scores array<double>")


def _merge(found: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for query, parts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                flat = parts.values
                ids, scores = (flat.field(i).flatten().to_numpy() for i in (0, 1))
                order = np.lexsort((ids, -scores))
                ids, scores = ids[order], scores[order]
                _, first = np.unique(ids, return_index=True)
                first = np.sort(first)[:k]
                for c, v in zip(out, ([query] * len(first), range(1, len(first) + 1), ids[first].tolist(), scores[first].tolist()), strict=True):
                    c.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], ["query_id", "rank", "vec_id", "score"])

    parts = found.groupBy("query").agg(F.collect_list(F.struct("ids", "scores")).alias("parts"))
    return parts.mapInArrow(run, "query_id long, rank int, vec_id long, score double")


def _bands(counts: list[tuple[int, int, float]], whole: int) -> dict[int, tuple[int, float, bool]]:
    """For each band its shared one, the log2 of that one's longest norm and whether it is scanned whole."""
    counts = sorted(counts)
    out = {}
    for i, (band, _, _) in enumerate(counts):
        first = min(i, BANDS - 1)
        own = counts[first:] if first == BANDS - 1 else counts[first : first + 1]
        out[band] = own[0][0], own[0][2], sum(n for _, n, _ in own) <= whole
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = TABLES, functions: int = FUNCTIONS, bucket_width: float = WIDTH, probes: int = PROBES, seed: int = 5, whole: int = 0) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner product found for each query, or all rows if fewer.

    Args: both with ``vec_id`` long and ``embedding`` array; other columns are ignored.  A query
    doesn't find rows of its own vec_id.  Every row is indexed in each table; ``tables`` and
    ``probes`` trade work for recall.  All rows are searched for a query that finds fewer than ``k`` by its
    buckets, and bands of norms of at most ``whole`` rows always; by default there are none.
    Returns ``query_id, rank`` from 1, ``vec_id, score``: doubles of the original components,
    largest first, ties to the smaller vec_id.

    Null, empty or zero vectors, those with null or non-finite components and those with a null vec_id
    take no part.  Vectors meet those of their own width only, each width by itself.  Rows that repeat a vec_id are one
    row, the nearest.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    pick = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    index = pick(vectors)
    dtype = np.float32 if dict(index.dtypes)["v"] == "array<float>" else np.float64
    found = [
        _of_width(index.where(F.size("v") == d), pick(queries).where(F.size("v") == d), d, dtype, k, Hashes(d, tables, functions, bucket_width, seed), probes, whole)
        for d in sorted(r["d"] for r in index.select(F.size("v").alias("d")).distinct().collect())
    ]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _of_width(index: DataFrame, asked: DataFrame, d: int, dtype, k: int, h: Hashes, probes: int, whole: int) -> DataFrame:
    """``nearest`` for usable vectors of one width."""
    wide = F.col("v").cast("array<double>")
    most = F.aggregate(wide, F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    norm = F.log2("most") + F.log2(F.aggregate(wide, F.lit(0.0), lambda s, x: s + (x / F.col("most")) * (x / F.col("most")))) / 2
    index, asked = (df.withColumn("most", most).select("vec_id", "v", norm.alias("lg")) for df in (index, asked))
    n, ids, longest = index.agg(F.count("*"), F.count_distinct("vec_id"), F.max("lg")).first()
    # Norms that differ by rounding alone stay in one band.
    index = index.withColumn("band", F.greatest(F.lit(0), F.floor(2 * (F.lit(longest) - F.col("lg")) - 1e-6)).cast("int"))
    bands = _bands([tuple(r) for r in index.groupBy("band").agg(F.count("*"), F.max("lg")).collect()], whole)
    asked = asked.withColumn("band", F.lit(0))
    m = max(1, asked.count())
    parts = ceil(m / (PACK // 4))
    blocks = _packed(index.repartition(ceil(n / PACK)), h, bands, dtype, 0, BLOCK, parts)
    asks = _packed(asked.repartition(parts), h, bands, dtype, probes, QUERIES, parts)
    pairs = asks.withColumnsRenamed({"ids": "q_ids", "vecs": "q_vecs"}).join(blocks, ["t", "band", "bucket"]).select("q_ids", "q_vecs", "ids", "vecs")
    found = stage(_merge(_scan(pairs, dtype, k), k), "nearest")
    if all(w for _, _, w in bands.values()):
        return found
    # Where a query's own vec_id leaves k - 1 candidates, it is scanned once more.
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, ids)).select(F.col("query_id").alias("vec_id"))
    short = stage(asked.join(full, "vec_id", "left_anti"), "short")
    left = short.count()
    if not left:
        return found
    # Every block meets every block of short queries.
    one = {b: (0, 0.0, True) for b in {0, *bands}}
    every = stage(_packed(index.repartition(ceil(n / PACK)), h, one, dtype, 0, BLOCK, 1), "every").select("ids", "vecs")
    rest = stage(_packed(short.repartition(ceil(left / (PACK // 4))), h, one, dtype, probes, QUERIES, 1), "rest").select(F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))
    exact = _merge(_scan(rest.hint("shuffle_replicate_nl").crossJoin(every), dtype, k), k)
    known = found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").select(*found.columns)
    return known.unionByName(exact)
