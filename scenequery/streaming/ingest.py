"""Scene statistics kept up to date as new pixel files arrive.

An extension: batches of pixels are added up per scene and time window by Structured Streaming, with a watermark for late
files. Mean and spread come from counts and sums, so a window's state is a few numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import radiometry as rad

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def event_stream(spark: SparkSession, folder: str, files_at_once: int = 8) -> DataFrame:
    """Events from Parquet files as they appear in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def window_stats(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """count, sum and sum of squares of valid values by collection and window, with mean and population std."""
    v = F.when(F.col("event_type") != "error", rad.positive(F.col("value")))
    stats = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    mean = F.col("s") / F.col("n")
    return stats.select(F.col("window.start").alias("start"), "event_type", "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))


def keep_updated(events: DataFrame, path: str, checkpoint: str, width: str = "1 day"):
    """Writes finished windows to Parquet, exactly once; returns the running query."""
    return window_stats(events, width).writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").start(path)
