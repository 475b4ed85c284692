"""The nearest rows of each row inside its group, block against block."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.sources.readers import staged

#: Rows of a block, and rows of one that meet another at once.
BLOCK = 1024
AT_ONCE = 256
#: Bits of each probe in the order that makes blocks compact.
BITS = 10


def _two(own: np.ndarray, a: np.ndarray, ids: np.ndarray, b: np.ndarray):
    """For each row of ``a`` the two least mean distances to rows of ``b`` with another id, and their ids; ``ids`` ascend."""
    near, score = np.zeros((len(a), 2), np.int64), np.full((len(a), 2), np.inf)
    for i in range(0, len(a), AT_ONCE):
        part = slice(i, min(i + AT_ONCE, len(a)))
        s = reduce(np.add, [np.abs(a[part, k, None] - b[None, :, k]) for k in range(a.shape[1])]) / a.shape[1]
        s[own[part, None] == ids[None]] = np.inf
        row = np.arange(len(s))
        for j in range(2):
            at = s.argmin(1)  # of equal scores the least id
            near[part, j], score[part, j] = ids[at], s[row, at]
            s[row, at] = np.inf
    return near, score


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows)))


def _blocks(rows: DataFrame, group: str, probes: list[str]) -> DataFrame:
    """Blocks of rows of one group that lie together, each row with the two nearest of its own block, and the block's box."""
    kind = rows.schema[group].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not len(batch):
                continue
            of = batch.column(group)
            turns = np.flatnonzero(of.dictionary_encode().indices.to_numpy()[1:] != of.dictionary_encode().indices.to_numpy()[:-1]) + 1
            for lo, hi in zip([0, *turns], [*turns, len(batch)], strict=True):
                for at in range(lo, hi, BLOCK):
                    cut = batch.slice(at, min(BLOCK, hi - at))
                    ids, p = cut.column("_id").to_numpy(), np.stack([cut.column(k).to_numpy() for k in probes], 1)
                    by = np.argsort(ids, kind="stable")
                    ids, p = ids[by], p[by]
                    near, score = _two(ids, p, ids, p)
                    yield pa.RecordBatch.from_arrays([pa.array([n]), cut.column(group)[:1], *[_lists([x.ravel()]) for x in (ids, p, near, score, p.min(0), p.max(0))], pa.array([score[:, 1].max()])], ["block", group, "ids", "p", "near", "score", "lo", "hi", "most"])
                    n += 1

    return staged(rows.mapInArrow(run, f"block long, `{group}` {kind}, ids array<long>, p array<double>, near array<long>, score array<double>, lo array<double>, hi array<double>, most double"), "blocks")


def _gap(lo: np.ndarray, hi: np.ndarray, p: np.ndarray) -> np.ndarray:
    """A lower bound of the mean distance of rows to a box, below it by more than sums are rounded."""
    return np.maximum(0, np.maximum(lo - p, p - hi)).mean(1) * (1 - 1e-12)


def two_nearest(rows: DataFrame, key: str, group: str, probes: list[str]) -> DataFrame:
    """``key, candidate, score`` with, for each row, the two rows of its group of least mean |difference| of ``probes`` among its few.

    Ties go to the lesser key.  A score with a null is null, the last, behind NaN.  Rows of a group are cut into blocks that lie
    together; a row asks only blocks whose box is no farther than the second nearest of its own.  Rows with null or
    non-finite probes meet by their kind: all of one kind have equal scores, so three of each group and kind stand for it.
    """
    rows = rows.where(F.col(group).isNotNull()).select(F.col(key).cast("long").alias("_id"), group, *[F.col(p).cast("double").alias(p) for p in probes])
    odd = lambda p: F.col(p).isNull() | F.isnan(p) | (F.abs(p) == float("inf"))
    any_odd = reduce(lambda c, p: c | odd(p), probes, F.lit(False))
    rows = staged(rows.withColumn("_kind", F.concat_ws(",", *[F.when(F.col(p).isNull(), "null").when(odd(p), F.col(p).cast("string")).otherwise("") for p in probes])).withColumn("_odd", any_odd), "probes")
    even = rows.where("not _odd")
    ends = even.groupBy(group).agg(*[f(p).alias(f"_{n}_{p}") for p in probes for n, f in (("lo", F.min), ("hi", F.max))])
    place = lambda p: F.floor((F.col(p) / 2 - F.col(f"_lo_{p}") / 2) / F.nullif(F.col(f"_hi_{p}") / 2 - F.col(f"_lo_{p}") / 2, F.lit(0.0)) * ((1 << BITS) - 1)).cast("long")
    bits = [F.shiftleft(F.coalesce(place(p), F.lit(0)).bitwiseAND(F.lit(1 << i)), (len(probes) - 1) * i + j) for j, p in enumerate(probes) for i in range(BITS)]
    dealt = even.join(ends, group).select("_id", group, *probes, reduce(lambda a, b: a + b, bits).alias("_z"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartitionByRange(parts, group, "_z", "_id").sortWithinPartitions(group, "_z", "_id").select("_id", group, *probes)
    blocks, width = _blocks(dealt, group, probes), len(probes)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to, ids, p, most, lo, hi = [], [], [], [], [], []
            for i in range(len(batch)):
                own, at, score, lo, hi = (batch.column(c)[i].values.to_numpy() for c in ("ids", "p", "score", "lo", "hi"))
                at, second = at.reshape(-1, width), score[1::2]
                use = _gap(lo, hi, at) <= second
                if use.any():
                    to.append(batch.column("to")[i].as_py())
                    ids.append(own[use])
                    p.append(at[use].ravel())
                    most.append(second[use])
            if to:
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), _lists(ids), _lists(p), _lists(most)], ["to", "ids", "p", "most"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                own, a, most, ids, b = (batch.column(c)[i].values.to_numpy() for c in ("ids", "p", "most", "its_ids", "its_p"))
                near, score = _two(own, a.reshape(-1, width), ids, b.reshape(-1, width))
                use = np.isfinite(score) & (score <= most[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, 2)[use.ravel()]), pa.array(near[use]), pa.array(score[use])], ["key", "candidate", "score"])

    boxes = blocks.select(F.col("block").alias("to"), group, F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    gap = sum(F.greatest(F.lit(0.0), F.get("_lo", F.lit(k)) - F.get("hi", F.lit(k)), F.get("lo", F.lit(k)) - F.get("_hi", F.lit(k))) for k in range(width)) / width * (1 - 1e-12)
    met = blocks.join(F.broadcast(boxes), group).where((F.col("block") != F.col("to")) & (gap <= F.col("most"))).select("to", "ids", "p", "score", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))
    asked = met.mapInArrow(ask, "to long, ids array<long>, p array<double>, most array<double>")
    found = asked.join(blocks.select(F.col("block").alias("to"), F.col("ids").alias("its_ids"), F.col("p").alias("its_p")).hint("merge"), "to").mapInArrow(answer, "key long, candidate long, score double")
    pair = F.explode(F.arrays_zip(F.flatten(F.transform("ids", lambda x: F.array(x, x))).alias("k"), F.col("near").alias("c"), F.col("score").alias("s"))).alias("_x")
    local = blocks.select(pair).select(F.col("_x.k").alias("key"), F.col("_x.c").alias("candidate"), F.col("_x.s").alias("score")).where(F.col("score") < float("inf"))
    # Rows that have no distance in the plain sense, and the rows that meet them.
    three = Window.partitionBy(group, "_kind").orderBy("_id")
    stand = staged(rows.withColumn("_i", F.row_number().over(three)).where("_i <= 3").select(F.col("_id").alias("candidate"), group, F.col("_odd").alias("_its_odd"), *[F.col(p).alias(f"_its_{p}") for p in probes]), "kinds")
    score = sum(F.abs(F.col(p) - F.col(f"_its_{p}")) for p in probes) / width
    strange = rows.join(stand, group).where((F.col("_odd") | F.col("_its_odd")) & (F.col("_id") != F.col("candidate"))).select(F.col("_id").alias("key"), "candidate", score.alias("score"))
    return local.unionByName(found).unionByName(strange).select(F.col("key").alias(key), "candidate", "score")
