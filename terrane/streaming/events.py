"""Structured Streaming front end: windowed counts of events, and resumable ingestion without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windows(events: DataFrame, length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums per tumbling window and type; ``late`` bounds the state."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    return seen.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of a user: events no further apart than ``gap``."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    return seen.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n")


def resume(items: DataFrame, done: DataFrame) -> DataFrame:
    """Items whose key has no final outcome yet; a repeat inside the batch is dropped."""
    final = done.where(F.col("outcome").isin("stored", "duplicate", "not_found")).select("batch_id", "requested_key")
    return items.dropDuplicates(["batch_id", "requested_key"]).join(final, ["batch_id", "requested_key"], "left_anti")


def replay(spark: SparkSession, d: str, work: str) -> DataFrame:
    """Run the windowed count as a stream over the events table until it is used up; returns what it wrote."""
    # The stream reads a folder; a Parquet file is linked by its parent folder and a name filter.
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    stamped = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    q = windows(stamped).writeStream.outputMode("append").format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{work}/out")
