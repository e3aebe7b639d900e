"""Observations as streams: current vintages and windowed means of what arrives.

A late revision is lawful however late it comes, so the current vintages keep no
watermark: state is one row for each (series, observation). The windowed means do: they
are final once the watermark on availability has passed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "series_id STRING, observation_time TIMESTAMP, available_time TIMESTAMP, value DOUBLE"


def read_observations(spark: SparkSession, path: str, schema: str = SCHEMA, files_per_trigger: int = 100) -> DataFrame:
    """A stream of observations from Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def current_vintages(observations: DataFrame) -> DataFrame:
    """The latest available value of each (series, observation); for update or complete output."""
    latest = F.max_by(F.struct("available_time", "value"), "available_time")
    return (
        observations.groupBy("series_id", "observation_time")
        .agg(latest.alias("_v"))
        .select("series_id", "observation_time", "_v.available_time", "_v.value")
    )


def windowed_means(observations: DataFrame, width: str, slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """Means over windows of availability, tumbling or sliding; later rows are dropped."""
    at = F.window("available_time", width, slide) if slide else F.window("available_time", width)
    return (
        observations.withWatermark("available_time", lateness)
        .groupBy("series_id", at.alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
        .select("series_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean")
    )


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Start a query that writes Parquet (append), or a table in memory (update, complete)."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if mode == "append":
        return writer.format("parquet").start(path)
    return writer.format("memory").queryName(path).start()
