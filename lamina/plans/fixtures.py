"""How the driver's tables stand for runs, regions, traces, events and voxels, in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL over the common tables below."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_tables(sql)
        return f

    return keep


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def since(unit: str):
    """Whole units since 2024, independent of the session time zone."""
    return F.expr(f"timestampdiff({unit}, timestamp_ntz'2024-01-01 00:00:00', ts)")


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Hourly mean value of each event type: ``region, t, f``."""
    return read(spark, d, "events").groupBy(F.col("event_type").alias("region"), since("HOUR").alias("t")).agg(F.avg("value").alias("f"))


def hours(spark: SparkSession, d: str) -> DataFrame:
    """Every whole hour from the first event to the last: ``t``."""
    ends = read(spark, d, "events").agg(F.min(since("HOUR")).alias("a"), F.max(since("HOUR")).alias("b"))
    return ends.where("a is not null").select(F.explode(F.sequence("a", "b")).alias("t"))


def points(spark: SparkSession, d: str) -> DataFrame:
    """Event times in whole seconds: ``user_id, region, s``."""
    return read(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("region"), since("SECOND").alias("s"), "value")


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Customers as runs of nations (groups) in regions: ``grp, sub, run, y, x, z``."""
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.avg("o_totalprice").alias("y"), F.count("*").alias("n_orders"))
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("n_regionkey").alias("grp"), F.col("n_nationkey").alias("sub"), F.col("c_custkey").alias("run"), F.col("c_acctbal").alias("x")).join(o, "run").withColumn("z", F.col("n_orders").cast("double"))


def voxels(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as 8 x 8 planes: ``frame, label, y, x, v``."""
    e = read(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    return e.select(F.col("vec_id").alias("frame"), "label", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def mask(spark: SparkSession, d: str, least: float = 0.25) -> DataFrame:
    """Voxels with |v| above a threshold: ``frame, y, x``."""
    return voxels(spark, d).where(F.abs("v") > least).select("frame", "y", "x")


TABLES = {
    "panel": "SELECT event_type AS region, date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) AS t, avg(value) AS f FROM events GROUP BY ALL",
    "points": "SELECT event_id, user_id, event_type AS region, date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS s, value FROM events",
    "runs": "SELECT n_regionkey AS grp, n_nationkey AS sub, c_custkey AS run, c_acctbal AS x, y, n_orders, CAST(n_orders AS DOUBLE) AS z FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT o_custkey, avg(o_totalprice) AS y, count(*) AS n_orders FROM orders GROUP BY ALL) ON o_custkey = c_custkey",
    "voxels": "SELECT vec_id AS frame, label, (i - 1) // 8 AS y, (i - 1) % 8 AS x, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS i FROM embeddings)",
    "mask": "SELECT frame, y, x FROM voxels WHERE abs(v) > 0.25",
    "dffs": "SELECT *, (f - f0) / greatest(f0, 1e-6) AS dff FROM (SELECT *, quantile_cont(f, 0.1) OVER (PARTITION BY region) AS f0 FROM panel)",
}


def with_tables(sql: str) -> str:
    """Put before a query the definitions of the common tables it names."""
    import re

    used, todo = [], [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    while todo:
        t = todo.pop(0)
        used = [t, *[u for u in used if u != t]]
        todo += [u for u in TABLES if u != t and re.search(rf"\b{u}\b", TABLES[t])]
    head = ", ".join(f"{t} AS ({TABLES[t]})" for t in used)
    recursive = re.match(r"\s*WITH RECURSIVE\s+(.*)", sql, re.S)
    plain = re.match(r"\s*WITH\s+(.*)", sql, re.S)
    if not used:
        return sql
    if recursive:
        return f"WITH RECURSIVE {head}, {recursive[1]}"
    return f"WITH {head}, {plain[1]}" if plain else f"WITH {head} {sql}"


def r6(*names: str):
    return [F.round(F.col(n), 6).alias(n) for n in names]
