"""Windows over event streams. Every function takes a streaming or a batch DataFrame with ts, and gives the same rows for the same events.

A row more than delay behind the latest one may be dropped by a stream, never by a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _marked(events: DataFrame, delay: str) -> DataFrame:
    return events.withWatermark("ts", delay) if events.isStreaming else events


def tumbling(events: DataFrame, length: str, keys: list[str], delay: str = "1 hour", slide: str | None = None, value: str = "value") -> DataFrame:
    """n, mean and max of each key's windows of length, every slide (or end to end)."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = _marked(events, delay).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "mean", "max")


def sessions(events: DataFrame, gap: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """start, end and n of each key's sessions, which end gap after their last event."""
    out = _marked(events, delay).groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def distinct(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """One event for each of keys; a stream forgets keys after delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def enriched(events: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Events with a dimension's columns, where it has them."""
    return events.join(dimension, key, "left")


def over_limit(events: DataFrame, keys: list[str], most: int, window: str, delay: str = "1 hour") -> DataFrame:
    """Windows in which a key had more than most events."""
    return tumbling(events, window, keys, delay).where(F.col("n") > most)


def run_available(spark: SparkSession, source: str, schema: StructType, pipeline: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Streams all that is in a folder of Parquet files through pipeline into sink once, and returns what sink holds; a restart goes on from checkpoint."""
    out = pipeline(spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(source))
    q = out.writeStream.outputMode(mode).format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(sink)


def mode_changes(events: DataFrame, keys: list[str], level: Column) -> DataFrame:
    """from_mode, to_mode, at of each change of level in a key's events, by a window over the key (batch)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("ts", "event_id")
    out = events.withColumn("to_mode", level).withColumn("from_mode", F.lag("to_mode").over(w))
    return out.where("from_mode is not null and from_mode <> to_mode").select(*keys, F.col("ts").alias("at"), "from_mode", "to_mode")
