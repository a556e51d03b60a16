"""Windowed aggregates over event streams; the same functions serve batches.

``stream`` replays a table as a stream, with the event time as a timestamp;
``drain`` runs a query to the end of its input into a table of the shared folder
and reads it back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanack.sources import tables


def stream(spark: SparkSession, path: str, time: str = "ts", files_per_trigger: int = 1) -> DataFrame:
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn(time, F.col(time).cast("timestamp"))


def replay(df: DataFrame, part: Column, parts: int, name: str, time: str = "ts") -> DataFrame:
    """A table as a stream of ``parts`` micro-batches, one after the other: rows come with the part (0 and up) that ``part`` says, whatever their time."""
    spark = df.sparkSession
    path = tables.place(spark, name)
    dealt = df.withColumn("__part", part)
    for i in range(parts):
        dealt.filter(F.col("__part") == i).drop("__part").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path).withColumn(time, F.col(time).cast("timestamp"))


def tumbling(df: DataFrame, by: list[str], width: str, delay: str = "1 hour") -> DataFrame:
    w = df.withWatermark("ts", delay) if df.isStreaming else df
    return w.groupBy(F.window("ts", width), *by).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total")).select(F.col("window.start").alias("window_start"), *by, "n", "total")


def sliding(df: DataFrame, by: list[str], width: str, step: str, delay: str = "1 hour") -> DataFrame:
    w = df.withWatermark("ts", delay) if df.isStreaming else df
    return w.groupBy(F.window("ts", width, step), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *by, "n")


def sessions(df: DataFrame, by: list[str], gap: str, delay: str = "1 hour") -> DataFrame:
    w = df.withWatermark("ts", delay) if df.isStreaming else df
    return w.groupBy(F.session_window("ts", gap), *by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *by, "n")


def distinct(df: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """The first row of each key; a stream forgets keys once the watermark has passed them."""
    return df.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def followed(first: DataFrame, then: DataFrame, key: str, minutes: int, delay: str = "1 hour") -> DataFrame:
    """Rows of ``first`` with the rows of ``then`` of the same key that come after them, within so many minutes; for streams both sides are kept no longer than that and the delay, and rows later than the delay are left out.

    The columns of ``then`` come as ``then_...``.
    """
    if first.isStreaming:
        first, then = first.withWatermark("ts", delay), then.withWatermark("ts", delay)
    named = then.select(*(F.col(c).alias(f"then_{c}") for c in then.columns))
    near = (F.col(key) == F.col(f"then_{key}")) & (F.col("then_ts") > F.col("ts")) & (F.col("then_ts") <= F.col("ts") + F.expr(f"INTERVAL {minutes} MINUTES"))
    return first.join(named, near).drop(f"then_{key}")


def drain(df: DataFrame, name: str) -> DataFrame:
    """All that the stream appends until its input is read."""
    spark = df.sparkSession
    base = f"{tables.folder(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    df.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/rows").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/rows")
