"""Typed readers, parsers and sinks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def usable_units(units: DataFrame, frames: str, planes: int, least: int) -> DataFrame:
    """Units with enough frames that divide into whole volumes."""
    return units.where((F.col(frames) >= least) & (F.col(frames) % planes == 0)).withColumn("volumes", F.floor(F.col(frames) / planes))


def unit_or_fail(units: DataFrame, key: Column, frames: str, planes: int) -> DataFrame:
    """One unit; the job fails if its frames don't divide into volumes."""
    bad = F.raise_error(F.concat(F.lit("frames don't divide: "), F.col(frames).cast("string"))).cast("bigint")
    return units.where(key).withColumn("volumes", F.when(F.col(frames) % planes == 0, F.floor(F.col(frames) / planes)).otherwise(bad))


def frame_to_plane(df: DataFrame, index: str, planes: int) -> DataFrame:
    """Volume ``t`` and plane ``z`` of interleaved frames."""
    return df.withColumn("t", F.floor(F.col(index) / planes)).withColumn("z", F.pmod(F.col(index), F.lit(planes)))


def parse_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The fields of a JSON text column; texts that aren't JSON give nulls."""
    return df.withColumn("_j", F.from_json(column, schema)).select(*df.columns, "_j.*")


def report(text: Column, patterns: dict[str, str]) -> Column:
    """Numbers of a free-text report, and the distinct warnings of its warnings block."""
    number = lambda p: F.regexp_extract(text, p, 1).try_cast("double")
    n = F.coalesce(F.regexp_extract(text, r"Warnings \((\d+)\)", 1).try_cast("int"), F.lit(0))
    block = F.regexp_extract(text, r"(?s)Warnings \(\d+\):?(.*?)(?:Files written|$)", 1)
    lines = F.array_distinct(F.filter(F.transform(F.split(block, "\n"), lambda x: F.btrim(x, F.lit(" -\t"))), lambda x: (x != "") & ~F.rlike(x, F.lit("^[0-9)]")) & ~F.contains(x, F.lit("(none)"))))
    return F.struct(*[number(p).alias(k) for k, p in patterns.items()], n.alias("n_warnings"), F.array_join(F.slice(lines, F.lit(1), n), " | ").alias("warnings"))


def read_csv(spark: SparkSession, path: str, schema: str, alternatives: dict[str, list[str]] | None = None) -> DataFrame:
    """A CSV with a declared schema; empty is null; ``alternatives`` fill a name from the first column present."""
    df = spark.read.csv(path, header=True, schema=schema, nullValue="", mode="PERMISSIVE")
    return reduce(lambda x, kv: x.withColumn(kv[0], F.coalesce(*[F.col(c) for c in kv[1] if c in x.columns])), (alternatives or {}).items(), df)


def read_json_tree(spark: SparkSession, path: str, schema: str, skip: str = r"/(old|_[^/]*)/", ignored: DataFrame | None = None) -> DataFrame:
    """JSON files of a tree with their paths, without superseded folders and ignored keys."""
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").option("multiLine", "true").json(path).withColumn("path", F.col("_metadata.file_path"))
    df = df.where(~F.col("path").rlike(skip))
    return df if ignored is None else df.join(ignored, ignored.columns, "left_anti")


def pick_element(items: Column, index: Column, has: Callable[[Column], Column]) -> Column:
    """The element at ``index`` from 0 if there is one, else the first that ``has`` accepts, else the first."""
    named = F.when((index >= 0) & (index < F.size(items)), F.get(items, index.cast("int")))
    return F.coalesce(named, F.get(F.filter(items, has), F.lit(0)), F.get(items, F.lit(0)))


def latest_version(df: DataFrame, root: str, schema: str, kind: str = "parquet") -> DataFrame:
    """Rows of the newest stamp under root; older versions stay as the archive.  ``df`` lends its session."""
    every = df.sparkSession.read.format(kind).schema(schema).option("recursiveFileLookup", "true").load(root).withColumn("stamp", F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/[^/]+$", 1))
    newest = every.agg(F.max("stamp").alias("stamp"))
    return every.join(F.broadcast(newest), "stamp")


def write_version(df: DataFrame, root: str, stamp: str, kind: str = "parquet") -> str:
    """Write under root/stamp and never over an older version, which so stays archived; the path is returned."""
    path = f"{root.rstrip('/')}/{stamp}"
    getattr(df.write.mode("errorifexists"), kind)(path)
    return path


def round_trip(df: DataFrame, spark: SparkSession) -> DataFrame:
    """The same rows after a pass through JSON text with the frame's own schema."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("j")).select(F.from_json("j", df.schema).alias("r")).select("r.*")


def staged(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder, for plans that read it more than once."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``; only where it is unset (tests, a laptop)
    and the master is local a folder of this machine is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='lamina-')}")
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
