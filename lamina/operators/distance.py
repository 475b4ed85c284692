"""Exact Euclidean distance transform on sparse cells, an axis at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType


def lower_envelope(at: np.ndarray, height: np.ndarray) -> np.ndarray:
    """min over j of (at[i] - at[j])**2 + height[j] for ascending places; infinite heights stand for no parabola."""
    own = np.flatnonzero(np.isfinite(height))
    if not len(own):
        return np.full(len(at), np.inf)
    places, heights = at[own].tolist(), height[own].tolist()
    kept, begins = [0], [-np.inf]
    for j in range(1, len(own)):
        while True:
            i = kept[-1]
            # Where the parabola of j falls below that of i.
            cross = (heights[j] - heights[i] + places[j] ** 2 - places[i] ** 2) / (2 * (places[j] - places[i]))
            if cross > begins[-1]:
                break
            kept.pop()
            begins.pop()
        kept.append(j)
        begins.append(cross)
    of = own[np.array(kept)[np.searchsorted(begins, at, "left") - 1]]
    return (at - at[of]) ** 2 + height[of]


def distance_transform(cells: DataFrame, target: str, on: list[str], spacing: dict[str, float]) -> DataFrame:
    """The distance of each cell to the nearest target cell of its volume: ``on``, axes, ``dist``.

    Args: ``cells`` with the columns of ``on``, the axes that ``spacing`` names and gives the size of a cell, and a boolean
    ``target``.  Each axis is one pass over lines of cells: the squared distances so far are parabolas along the line, whose
    lower envelope is the next ones.  A task holds lines, not volumes; there is no reach.

    Every line that holds a target must hold a cell for each place that is asked for, as in a full box.  Repeated cells are
    one, a target if any is.  A null target is none.  Cells of a volume without targets have a null distance.
    """
    axes = list(spacing)
    far = float("inf")
    now = cells.groupBy(*on, *axes).agg(F.min(F.when(F.col(target), 0.0).otherwise(far)).alias("_d"))
    for a in axes:
        line = [*on, *[b for b in axes if b != a]]
        held = now.groupBy(*line).agg(F.array_sort(F.collect_list(F.struct(F.col(a).alias("at"), F.col("_d").alias("d")))).alias("_c"))
        fields = [f for f in held.schema.fields if f.name != "_c"]

        def run(batches, a=a, fields=fields):
            for batch in batches:
                out = []
                for c in batch.column("_c"):
                    at = c.values.field("at").to_numpy(zero_copy_only=False)
                    out.append(lower_envelope(at * spacing[a], c.values.field("d").to_numpy()))
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), batch.column("_c"), pa.array(out, pa.list_(pa.float64()))], [*(f.name for f in fields), "_c", "_e"])

        done = held.mapInArrow(run, StructType([*fields, held.schema["_c"], StructField("_e", ArrayType(DoubleType()))]))
        now = done.select(*line, F.explode(F.arrays_zip(F.col("_c.at").alias("at"), F.col("_e").alias("e"))).alias("_x")).select(*line, F.col("_x.at").alias(a), F.col("_x.e").alias("_d"))
    return now.select(*on, *axes, F.when(F.col("_d") < far, F.sqrt("_d")).alias("dist"))
