"""Nearest rows by blocks against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import nearest
from lamina.operators import relational as rel


@pytest.mark.parametrize("block", [1024, 5])
def test_two_nearest_as_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(nearest, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 3), *np.round(rng.normal(size=2), 1).tolist()) for i in range(120)] + [(500 + i, 7, 1.0 + 0.0 * i, 2.0) for i in range(4)]
    rows += [(200, 8, 1.0, 1.0), (201, 9, 0.0, 1.0), (202, 9, 3.0, 1.0), (203, None, 0.0, 0.0)]
    odd = [None, math.nan, math.inf, -math.inf]
    rows += [(300 + i, 1, odd[i % 4], 1.0) for i in range(10)] + [(400 + i, 5, odd[i], odd[j]) for i in range(4) for j in range(4) if i == j or not i]
    e = spark.createDataFrame(rows, "key long, g int, a double, b double").dropDuplicates(["key"])
    b = e.select(F.col("key").alias("candidate"), "g", F.col("a").alias("c"), F.col("b").alias("d"))
    pairs = e.join(b, "g").where("key <> candidate").withColumn("score", (F.abs(F.col("a") - F.col("c")) + F.abs(F.col("b") - F.col("d"))) / 2)
    rank = lambda s: sorted(str(tuple(r)) for r in rel.best_and_runner_up(s, "key", "candidate", "score").collect())
    assert rank(nearest.two_nearest(e, "key", "g", ["a", "b"])) == rank(pairs)


def test_far_blocks_are_not_met(spark):
    rows = spark.range(40_000).repartition(4).selectExpr("id as key", "1 as g", "cast(id as double) as a")
    assert nearest.two_nearest(rows, "key", "g", ["a"]).count() < 100_000
