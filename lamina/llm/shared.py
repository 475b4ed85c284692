"""Helpers that several operators of this subpackage use: staging and components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether Spark removes a query's shuffle files at its end.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of one Arrow batch that a task gets, so that many long texts don't come at once.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 16 << 20
#: Output folders that a task writes side by side, so that rows needn't be sorted by folder.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset and the master is
    local (tests, a laptop) a folder of this process is made, set as checkpoint folder and
    removed at exit.  On a cluster without the setting this raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lamina-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{folder}")
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, batch_bytes: int = BATCH_BYTES, rows: int | None = None) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it again.

    This cuts the lineage: a lost executor costs the tasks that ran on it, not the plan
    behind the table.  Tasks get Arrow batches of about ``batch_bytes``.  ``rows``: the most of a
    row group, for rows of megabytes; a writer and a reader hold a group's rows, up to 4,096, at once.
    """
    return stage_at(df, fresh_path(df.sparkSession, name), batch_bytes, rows=rows)


def stage_at(df: DataFrame, path: str, batch_bytes: int = BATCH_BYTES, by: tuple[str, ...] = (), rows: int | None = None) -> DataFrame:
    """``stage`` at a given path, with a folder for each of the few values of the columns ``by``."""
    spark = df.sparkSession
    write_tidily(df, path, batch_bytes, by, rows=rows)
    return spark.read.schema(df.schema).parquet(path)


def write_tidily(df: DataFrame, path: str, batch_bytes: int = BATCH_BYTES, by: tuple[str, ...] = (), mode: str = "errorifexists", rows: int | None = None) -> None:
    """Write a frame as Parquet; its shuffle files, which nothing reads afterwards, don't stay on disk."""
    spark = df.sparkSession
    own = {TIDY: "true", BATCH: str(batch_bytes), WRITERS: "4"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        grouped = {"parquet.block.row.count.limit": str(rows)} if rows else {}
        df.write.mode(mode).options(compression="zstd", **grouped).partitionBy(*by).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a staged folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def packed(x: np.ndarray, level: int = 1) -> bytes:
    """The bytes of an array of one dimension, those of equal weight together, compressed."""
    return pa.Codec("zstd", compression_level=level).compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), asbytes=True) if len(x) else b""


def unpacked(data: bytes, n: int, dtype) -> np.ndarray:
    """The array of ``n`` values that ``packed`` packed."""
    size = np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    raw = np.frombuffer(pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(dtype).ravel()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as ``src, dst`` longs: ``node, root``.

    Each round every node hooks to the neighbour (itself included) with the least hash of
    that round, edges are redrawn between the hooks and the edges inside one hook vanish.
    Hashed priorities keep long chains from shrinking by one node a round.  ``root`` is
    some node of the component; nodes without edges don't occur.  Null ends are ignored.
    The rounds go on until no edge is left: the largest hash of a round hooks wherever it
    has an edge, so each round has fewer nodes than the one before.
    """
    spark = edges.sparkSession
    live = stage(
        edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(),
        "edges",
    )
    found = None
    for turn in count():
        if live.isEmpty():
            break
        both = live.unionByName(live.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        rank = lambda c, t=turn: F.xxhash64(F.lit(t), c)
        hook = stage(
            both.groupBy(F.col("src").alias("node")).agg(F.min(F.struct(rank(F.col("dst")).alias("h"), F.col("dst").alias("id"))).alias("best"))
            .select("node", F.when(rank(F.col("node")) <= F.col("best.h"), F.col("node")).otherwise(F.col("best.id")).alias("root")),
            "hooks",
        )
        a, b = hook.withColumnsRenamed({"node": "src", "root": "a"}), hook.withColumnsRenamed({"node": "dst", "root": "b"})
        live = stage(
            live.join(a, "src").join(b, "dst").where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(),
            "edges",
        )
        if found is None:
            found = hook
        else:
            step = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = stage(found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
    if found is None:
        return spark.createDataFrame([], "node long, root long")
    return found
