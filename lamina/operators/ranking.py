"""Places of all rows of a table in one order, without bringing them to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.sources.readers import staged

#: Bits of the row number inside a partition in Spark's increasing ids.
ROW_BITS = 33


def place(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """The place of each row, from 1, in an order over the whole table.

    Rows are dealt to partitions by ranges of the order and sorted in them, so a place is the rows
    of earlier partitions and the row's own number.  Only one count a partition meets in one task.
    Rows that the order holds equal get different places; name a key last to settle which.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    x = staged(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part, row = F.shiftright("_at", ROW_BITS), F.col("_at") % (1 << ROW_BITS)
    counts = x.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return x.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + row + 1).drop("_part", "_at", "_before")
