"""Rigid registration of stacks of frames: shifts by phase correlation, resampling and drift.

A frame is the cells of one time, of any number of axes, and is packed into one row; stacks are any number of
frames.  References are means by cell, so they come from partial sums, and meet the frames of their stack by a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.ranking import place
from lamina.sources.readers import staged

Box = dict[str, tuple[int, int]]


def _shape(box: Box) -> tuple[int, ...]:
    return tuple(hi - lo + 1 for lo, hi in box.values())


def pack_frames(vox: DataFrame, on: list[str], v: str, box: Box, name: str = "cells") -> DataFrame:
    """``on`` and the frame as ``name``: structs of a cell's place in row-major order of the box, and its value.

    Cells outside the box and null values are left out; of repeated cells any one counts.
    """
    inside, at = F.lit(True), F.lit(0)
    for a, (lo, hi) in box.items():
        inside, at = inside & F.col(a).between(lo, hi), at * (hi - lo + 1) + F.col(a) - lo
    cells = vox.where(inside & F.col(v).isNotNull()).select(*on, F.struct(at.cast("int").alias("at"), F.col(v).cast("double").alias("v")).alias("_c"))
    return cells.groupBy(*on).agg(F.collect_list("_c").alias(name))


def _frame(cells: pa.Scalar, shape: tuple[int, ...]) -> np.ndarray:
    """The array of a packed frame; cells without a value are 0."""
    flat = np.zeros(int(np.prod(shape)))
    held = cells.values
    flat[held.field("at").to_numpy()] = held.field("v").to_numpy()
    return flat.reshape(shape)


def correlation_peak(product: np.ndarray, upsample: int = 1) -> np.ndarray:
    """The shift at which the inverse transform of a cross spectrum is largest, to 1 / upsample of a cell.

    The whole-cell peak is searched everywhere; around it the transform is evaluated on a finer grid, an axis at a time.
    """
    shape = product.shape
    peak = np.unravel_index(np.argmax(np.abs(np.fft.ifftn(product))), shape)
    at = np.array([p - n if p > n // 2 else p for p, n in zip(peak, shape, strict=True)], float)
    if upsample <= 1:
        return at
    reach = -(-3 * upsample // 4)
    fine = np.arange(-reach, reach + 1) / upsample
    values = product
    for axis, n in enumerate(shape):
        turn = np.exp(2j * np.pi * np.outer(at[axis] + fine, np.fft.fftfreq(n)))
        values = np.moveaxis(np.tensordot(turn, values, axes=(1, axis)), 0, axis)
    best = np.unravel_index(np.argmax(np.abs(values)), values.shape)
    return at + fine[list(best)]


def shift_linear(x: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The array moved by a shift of any fraction, linear between cells, edges repeated."""
    for axis, s in enumerate(shift):
        n = x.shape[axis]
        at = np.clip(np.arange(n) - s, 0, n - 1)
        low = np.floor(at).astype(int)
        part = (at - low).reshape([-1 if i == axis else 1 for i in range(x.ndim)])
        x = np.take(x, low, axis) * (1 - part) + np.take(x, np.minimum(low + 1, n - 1), axis) * part
    return x


def mean_frame(vox: DataFrame, on: list[str], axes: list[str], v: str) -> DataFrame:
    """The mean over frames of each cell of each stack ``on``."""
    return vox.groupBy(*on, *axes).agg(F.avg(v).alias(v))


def register(vox: DataFrame, stack: list[str], frame: str, v: str, box: Box, reference: DataFrame | None = None, upsample: int = 10, max_shift: float = 8.0) -> DataFrame:
    """Frames moved onto the reference of their stack: ``stack, frame``, axes, ``v`` and a ``shift_<axis>`` each.

    Args: ``vox`` with the columns of ``stack``, ``frame``, the axes of ``box`` and ``v``; ``reference`` with ``stack``,
    axes and ``v``, by default the mean of the stack's frames.  Shifts are the peak of the cross correlation to 1 / ``upsample``
    of a cell, clipped to ``max_shift``; frames are resampled linearly with edges repeated.

    Cells of the box that a frame lacks count as 0; a stack without reference comes out unmoved with null shifts.
    Null stacks are a stack.
    """
    axes, shape = list(box), _shape(box)
    ref = pack_frames(mean_frame(vox, stack, axes, v) if reference is None else reference, stack, v, box, "ref").withColumnsRenamed({s: f"_{s}" for s in stack})
    same = F.lit(True)
    for s in stack:
        same = same & F.col(s).eqNullSafe(F.col(f"_{s}"))
    pairs = pack_frames(vox, [*stack, frame], v, box).join(ref, same, "left")
    keys = [f for f in pairs.schema.fields if f.name in (*stack, frame)]

    def run(batches):
        for batch in batches:
            cells, refs = batch.column("cells"), batch.column("ref")
            moved, shifts = [], []
            for i in range(len(batch)):
                own = _frame(cells[i], shape)
                if refs[i].is_valid:
                    s = correlation_peak(np.fft.fftn(_frame(refs[i], shape)) * np.conj(np.fft.fftn(own)), upsample)
                    s = np.clip(s, -max_shift, max_shift)
                    own = shift_linear(own, s)
                    shifts.append(s.tolist())
                else:
                    shifts.append(None)
                moved.append(own.ravel())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keys), pa.array(shifts, pa.list_(pa.float64())), pa.array(moved, pa.list_(pa.float64()))], [*(f.name for f in keys), "_s", "_v"])

    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    list_of = ArrayType(DoubleType())
    done = pairs.select(*[f.name for f in keys], "cells", "ref").mapInArrow(run, StructType([*keys, StructField("_s", list_of), StructField("_v", list_of)]))
    shift = [F.get("_s", F.lit(i)).alias(f"shift_{a}") for i, a in enumerate(axes)]
    cells = done.select(*stack, frame, *shift, F.posexplode("_v").alias("_at", v))
    place, step = [], int(np.prod(shape))
    for a, n in zip(axes, shape, strict=True):
        step //= n
        place.append((F.floor(F.col("_at") / step) % n + box[a][0]).cast("int").alias(a))
    return cells.select(*stack, frame, *place, v, *[f"shift_{a}" for a in axes])


def register_twice(vox: DataFrame, stack: list[str], frame: str, v: str, box: Box, upsample: int = 10, max_shift: float = 8.0) -> DataFrame:
    """Registration against the mean of the frames, then of the same frames against the mean of what came out."""
    first = staged(register(vox, stack, frame, v, box, None, upsample, max_shift), "registered")
    return register(vox, stack, frame, v, box, mean_frame(first, stack, list(box), v), upsample, max_shift)


def sharpness(vox: DataFrame, on: list[str], y: str, x: str, v: str) -> DataFrame:
    """The mean squared gradient of each image ``on`` over its inner cells, by central differences: ``sharpness``."""
    ahead = lambda a: (F.lead(v).over(Window.partitionBy(*on, *([x] if a == y else [y])).orderBy(a)) - F.lag(v).over(Window.partitionBy(*on, *([x] if a == y else [y])).orderBy(a))) / 2
    g = vox.withColumn("_y", ahead(y)).withColumn("_x", ahead(x))
    return g.groupBy(*on).agg(F.avg(F.col("_y") * F.col("_y") + F.col("_x") * F.col("_x")).alias("sharpness"))


def drift(vox: DataFrame, stack: list[str], frame: str, v: str, box: Box) -> DataFrame:
    """Whole-cell drift of each stack: ``stack`` and a ``drift_<axis>`` each.

    The mean of the first third of the frames meets that of the last third by phase correlation with a whitened
    cross spectrum.  The sign is that of the shift which brings the last third back.  Stacks of fewer than 3 frames are left out.
    """
    axes, shape = list(box), _shape(box)
    frames = vox.select(*stack, frame).distinct()
    numbered = staged(place(frames, *stack, frame), "frames")
    own = numbered.groupBy(*stack).agg(F.min("place").alias("_first"), F.floor(F.count("*") / 3).alias("_third"), F.max("place").alias("_last")) if stack else numbered.agg(F.min("place").alias("_first"), F.floor(F.count("*") / 3).alias("_third"), F.max("place").alias("_last"))
    numbered = numbered.join(own, stack) if stack else numbered.join(F.broadcast(own))
    ends = numbered.select(*stack, frame, F.when(F.col("place") < F.col("_first") + F.col("_third"), "head").when(F.col("place") > F.col("_last") - F.col("_third"), "tail").alias("_end")).where("_end is not null")
    means = mean_frame(vox.join(ends, [*stack, frame]), [*stack, "_end"], axes, v)
    packs = pack_frames(means, [*stack, "_end"], v, box)
    both = packs.groupBy(*stack).agg(F.max(F.when(F.col("_end") == "head", F.col("cells"))).alias("head"), F.max(F.when(F.col("_end") == "tail", F.col("cells"))).alias("tail"))
    keys = [f for f in both.schema.fields if f.name in stack]

    def run(batches):
        for batch in batches:
            found = []
            for a, b in zip(batch.column("head"), batch.column("tail"), strict=True):
                product = np.fft.fftn(_frame(a, shape)) * np.conj(np.fft.fftn(_frame(b, shape)))
                found.append(correlation_peak(product / (np.abs(product) + 1e-9)).astype(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keys), pa.array(found, pa.list_(pa.int64()))], [*(f.name for f in keys), "_s"])

    from pyspark.sql.types import ArrayType, LongType, StructField, StructType

    out = both.where("head is not null and tail is not null").mapInArrow(run, StructType([*keys, StructField("_s", ArrayType(LongType()))]))
    return out.select(*stack, *[F.get("_s", F.lit(i)).alias(f"drift_{a}") for i, a in enumerate(axes)])
