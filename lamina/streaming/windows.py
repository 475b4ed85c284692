"""Windows over event streams in Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lamina.sources.readers import shared_path


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder (or a file) of events as a stream; ``ts`` in UTC as event time.

    Streams take only timestamps with a zone as event times, so zoneless ones are cast.
    """
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(stream: DataFrame, width: str, keys: list[str], late: str, slide: str | None = None) -> DataFrame:
    """Count and sum of ``value`` in tumbling windows, or in windows that begin every ``slide``; rows later than ``late`` are dropped."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width, slide), *keys)
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, gap: str, keys: list[str], late: str) -> DataFrame:
    """Sessions that a pause of ``gap`` ends: start, end and count."""
    s = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("n"))
    return s.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def drain(out: DataFrame, mode: str = "complete", keys: list[str] | None = None, settings: dict[str, str] | None = None) -> DataFrame:
    """Run a streaming query over all that is there and return its last state as a table.

    In update mode state goes when the watermark has passed it, and of each ``keys`` the row of the newest batch counts.
    The sink is a folder of the shared place; a batch that is tried again overwrites itself.  ``settings`` hold for the query.
    """
    spark, place = out.sparkSession, shared_path(out.sparkSession, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out" if mode == "complete" else f"{place}/out/batch={number}")

    before = {k: spark.conf.get(k, None) for k in settings or {}}
    for k, v in (settings or {}).items():
        spark.conf.set(k, v)
    try:
        # An in-order catch-up reads no row late: the whole input comes before the last batch ends.
        query = out.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").foreachBatch(keep).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if mode == "complete":
        return spark.read.schema(out.schema).parquet(f"{place}/out")
    every = spark.read.schema(StructType([*out.schema.fields, StructField("batch", LongType())])).parquet(f"{place}/out")
    if mode != "update" or not keys:
        return every.drop("batch")
    return every.groupBy(*keys).agg(F.max_by(F.struct(*out.columns), "batch").alias("_row")).select("_row.*")


def hourly_counts(spark: SparkSession, path: str) -> DataFrame:
    """Events and their sum of values by hour and type: ``hour, event_type, n, total``."""
    out = drain(windowed(event_stream(spark, path), "1 hour", ["event_type"], "31 days"), "update", ["window", "event_type"])
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 6).alias("total"))


def sliding_counts(spark: SparkSession, path: str) -> DataFrame:
    """The same in windows of two hours that begin every half hour: ``start, event_type, n, total``."""
    out = drain(windowed(event_stream(spark, path), "2 hours", ["event_type"], "31 days", "30 minutes"), "update", ["window", "event_type"])
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


def user_sessions(spark: SparkSession, path: str, gap: str) -> DataFrame:
    """Sessions of users: ``user_id, start, end, n``; ``end`` is the gap after the last event.  Streams know sessions in complete mode only."""
    out = drain(sessions(event_stream(spark, path), gap, ["user_id"], "31 days"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
