"""Embedding near-dedup by an epsilon grid order join.

Unit vectors with cosine c or more lie within eps = sqrt(2 - 2c).  They are sorted by label
and by their cells, eps wide, on the leading principal directions; the sequence is cut into
blocks.  Pairs of sequence intervals are joined recursively, from runs of partitions down to
blocks, and a pair whose bounding boxes are more than eps apart goes no deeper.  Pairs of
blocks are compared by matrix products inside one task, which returns link counts and a
spanning forest, never pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.shared import connected_components, partitions, stage
from lamina.llm.vectors import basis, matrix, usable, width

BLOCK = 256
FAN = 16
DIMS = 6


def _blocks(sorted_rows: DataFrame, dims: int) -> DataFrame:
    """Packed blocks of a partition's rows in order, none across labels."""

    def run(batches):
        seq, rest = 0, None

        def pack(t):
            x = matrix(t["v"])
            x /= np.linalg.norm(x, axis=1)[:, None]
            p = matrix(t["p"])
            return [t["pid"][0].as_py(), seq, t["label"][0].as_py(), t["rep"].to_numpy().astype(np.int64).tobytes(), t["copies"].to_numpy().astype(np.int64).tobytes(), x.tobytes(), p.min(0).tolist(), p.max(0).tolist()]

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            t, out, i = t.combine_chunks(), [], 0
            label = t["label"].to_numpy()
            while i < len(t):
                j = min(i + BLOCK, i + int(np.argmax(np.r_[label[i:] != label[i], True])))
                if j == len(t) and j - i < BLOCK:
                    break
                out.append(pack(t.slice(i, j - i)))
                seq += 1
                i = j
            rest = t.slice(i)
            if out:
                yield made(out)
        if rest is not None and len(rest):
            yield made([pack(rest)])

    def made(rows):
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["pid", "seq", "label", "reps", "copies", "vecs", "lo", "hi"])

    return sorted_rows.mapInArrow(run, "pid int, seq long, label long, reps binary, copies binary, vecs binary, lo array<double>, hi array<double>")


def _apart(eps: float):
    gap = F.zip_with(F.zip_with("a.lo", "b.hi", lambda x, y: x - y), F.zip_with("b.lo", "a.hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) > eps * eps * (1 + 1e-9)


def _corner(name: str, f, dims: int):
    return F.array(*[f(F.get(F.col(name), F.lit(i))) for i in range(dims)])


def _compare(pairs: DataFrame, least: float) -> DataFrame:
    """Counts (``dst`` null: ``weight`` more linked vectors of ``src``) and forest edges."""

    def run(batches):
        for batch in batches:
            out = [[], [], []]
            for a_reps, a_copies, a_vecs, b_reps, b_copies, b_vecs in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                a, b = np.frombuffer(a_reps, np.int64), np.frombuffer(b_reps, np.int64)
                x, y = np.frombuffer(a_vecs).reshape(len(a), -1), np.frombuffer(b_vecs).reshape(len(b), -1)
                same = a_reps == b_reps
                cos = x @ y.T
                link = cos >= least
                for i, j in np.argwhere(np.abs(cos - least) < 1e-9):  # decide as two vectors alone would
                    link[i, j] = float(np.dot(x[i], y[j])) >= least
                if same:
                    np.fill_diagonal(link, False)
                for ids, total in ((a, link @ np.frombuffer(b_copies, np.int64)), *(() if same else ((b, link.T @ np.frombuffer(a_copies, np.int64)),))):
                    k = np.flatnonzero(total)
                    out[0] += ids[k].tolist()
                    out[1] += [None] * len(k)
                    out[2] += total[k].tolist()
                up = {}

                def top(z, up=up):
                    while up.setdefault(z, z) != z:
                        up[z] = up[up[z]]
                        z = up[z]
                    return z

                for i, j in np.argwhere(link):
                    p, q = top(int(a[i])), top(int(b[j]))
                    if p != q:
                        up[max(p, q)] = min(p, q)
                        out[0].append(int(a[i]))
                        out[1].append(int(b[j]))
                        out[2].append(0)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["src", "dst", "weight"])

    return pairs.mapInArrow(run, "src long, dst long, weight long")


def near_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """Link vectors of one label whose cosine, in doubles, is ``least`` or more.

    Args: ``vectors`` with ``vec_id`` long, ``embedding`` array and ``label`` int; other columns
    are ignored.
    Returns ``vec_id, n_links, component_id, kept`` for every row: the other rows linked to it,
    the least vec_id that links reach, and whether it is that row.

    Null labels, null, empty or zero vectors and those with null or non-finite components
    link with nothing.  Vectors of different widths don't link; each width is joined by itself,
    the commonest along its principal directions, others along their first components.  Equal vectors are compared once and count
    as often as they occur; rows that repeat a vec_id count each.  A row with a null vec_id
    is kept, links with nothing and has a null component.  An empty table gives none.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), F.col("label").cast("int").alias("label"))
    fit = vectors.where(usable(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    d = width(fit, "v")
    # -0.0 and 0.0 are equal as numbers but not as keys.
    v = F.transform("v", lambda x: x + F.lit(0.0)).cast("array<double>")
    # Blocks are of one label and one width: both make one number.
    group = (F.col("label").cast("long") * (1 << 24) + F.size("v")).alias("label")
    groups = stage(fit.groupBy(group, v.alias("v")).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vectors")
    dims = min(DIMS, d)
    axes = basis(groups.where(F.size("v") == d), "v", dims)
    eps = float(np.sqrt(max(0.0, 2 - 2 * least)))
    if dims:
        unit = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        dot = lambda i: F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in axes[:, i]]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) / F.col("unit")
        placed = groups.withColumn("unit", unit).select("*", F.array(*[F.when(F.size("v") == d, dot(i)).otherwise(F.coalesce(F.get("v", F.lit(i)) / F.col("unit"), F.lit(0.0))) for i in range(dims)]).alias("p"))
        cells = [F.floor(F.get("p", F.lit(i)) / eps).alias(f"c{i}") for i in range(dims)]
        placed = placed.select("label", "v", "rep", "copies", "p", *cells)
        order = ["label", *[f"c{i}" for i in range(dims)], "rep"]
        ranged = placed.repartitionByRange(partitions(vectors.sparkSession), *order).sortWithinPartitions(*order)
        blocks = stage(_blocks(ranged.select(F.spark_partition_id().alias("pid"), "label", "rep", "copies", "v", "p"), dims), "blocks")
        low, high = _corner("lo", F.min, dims).alias("lo"), _corner("hi", F.max, dims).alias("hi")
        level = blocks.select("label", "pid", "seq", "lo", "hi")
        # Interval keys from fine to coarse; each level's boxes hold those of the next finer.
        keys = [["label", "pid", "seq"], ["label", "pid", "run"], ["label", "pid"], ["label", "far"]]
        level = level.withColumn("run", F.floor(F.col("seq") / FAN)).withColumn("far", F.floor(F.col("pid") / FAN))
        boxes = [level] + [level.groupBy(*k).agg(low, high) for k in keys[1:]]
        boxes[2] = boxes[2].withColumn("far", F.floor(F.col("pid") / FAN))
        first = boxes[3]
        pairs = first.alias("a").join(first.alias("b"), (F.col("a.label") == F.col("b.label")) & (F.col("a.far") <= F.col("b.far"))).where(~_apart(eps))
        pairs = pairs.select("a.label", F.col("a.far").alias("ka0"), F.col("b.far").alias("kb0"))
        up = ["far"]
        for depth, own in ((2, ["pid"]), (1, ["pid", "run"]), (0, ["pid", "seq"])):
            box = boxes[depth]
            pre = lambda side: [F.col(f"{side}.{c}") for c in up]
            on_a = [F.col("p.label") == F.col("a.label"), *[F.col(f"p.ka{i}") == c for i, c in enumerate(pre("a"))]]
            on_b = [F.col("p.label") == F.col("b.label"), *[F.col(f"p.kb{i}") == c for i, c in enumerate(pre("b"))]]
            ordered = F.struct(*[F.col(f"a.{c}") for c in own]) <= F.struct(*[F.col(f"b.{c}") for c in own])
            pairs = pairs.alias("p").join(box.alias("a"), on_a).join(box.alias("b"), on_b).where(ordered & ~_apart(eps))
            pairs = pairs.select("p.label", *[F.col(f"a.{c}").alias(f"ka{i}") for i, c in enumerate(own)], *[F.col(f"b.{c}").alias(f"kb{i}") for i, c in enumerate(own)])
            up = own
        half = lambda s: blocks.select(F.col("pid").alias(f"k{s}0"), F.col("seq").alias(f"k{s}1"), *[F.col(c).alias(f"{s}_{c}") for c in ("reps", "copies", "vecs")])
        meet = pairs.join(half("a"), ["ka0", "ka1"]).join(half("b"), ["kb0", "kb1"]).select("a_reps", "a_copies", "a_vecs", "b_reps", "b_copies", "b_vecs")
        links = stage(_compare(meet, least), "links")
    else:
        links = vectors.sparkSession.createDataFrame([], "src long, dst long, weight long")
    # A vec_id may stand for several groups only if it repeats; components are of reps.
    root = connected_components(links.where("dst is not null").select("src", "dst")).withColumnsRenamed({"node": "rep"})
    named = groups.join(root, "rep", "left").select("label", "v", "rep", "copies", F.coalesce("root", "rep").alias("root"))
    least_id = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    degree = links.where("dst is null").groupBy(F.col("src").alias("rep")).agg(F.sum("weight").alias("linked"))
    named = named.join(least_id, "root").join(degree, "rep", "left").select("label", F.col("v").alias("w"), "component_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    key = F.when(usable(F.col("v")) & F.col("vec_id").isNotNull(), v)
    out = vectors.withColumn("w", key).withColumn("label", F.when(F.col("label").isNotNull() & F.col("w").isNotNull(), group)).join(named.hint("shuffle_hash"), ["label", "w"], "left")
    alone = F.col("component_id").isNull()
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
