"""An extension beyond the batch operators: telemetry as a stream. Events that come twice within the watermark count once; windows are summed
as they close."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, path: str) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(EVENT).parquet(path)


def windowed(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    once = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
