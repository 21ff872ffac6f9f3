"""Tumbling-window profiles of an event stream, for drift monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_profile(events: DataFrame, ts: str, group: str, value: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, NULL share, mean and spread per window and group. Works on streams (with a
    watermark, so state is dropped once a window is closed) and on stored tables alike."""
    d = events.withColumn("_t", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        d = d.withWatermark("_t", late)
    v = F.col(value).cast("double")
    out = d.groupBy(F.window("_t", size).alias("w"), group).agg(
        F.count("*").alias("n"), F.round(F.avg(v.isNull().cast("int")), 6).alias("null_share"),
        F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_samp(v), 4).alias("std"))
    return out.select(F.col("w.start").alias("window_start"), group, "n", "null_share", "mean", "std")


def event_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Stream over the Parquet files of one table."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_to_parquet(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process everything available, append closed windows to `out`; restarts continue from the checkpoint."""
    q = (stream.writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def window_shift(profiles: DataFrame, group: str) -> DataFrame:
    """Change of the mean between the first and last window of each group, in first-window spreads."""
    pick = lambda c, f: f(c, "window_start")
    d = profiles.groupBy(group).agg(pick("mean", F.min_by).alias("first_mean"), pick("mean", F.max_by).alias("last_mean"), pick("std", F.min_by).alias("sd"),
                                    F.count("*").alias("windows"))
    return d.withColumn("normalised_shift", F.round(F.abs(F.col("last_mean") - F.col("first_mean")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0), 4))
