"""Extension: Structured Streaming over attempts. The same functions run on a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examlark.operators.analytics import exact_sum


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 4) -> DataFrame:
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Attempts and mean value by window and kind; later events than the watermark are left out of a stream."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.window(ts, every), kind).agg(F.count(F.lit(1)).alias("n"), F.round(exact_sum(F.col("value")).cast("double") / F.count("value"), 6).alias("mean_value")).select(F.col("window.start").alias("window_start"), kind, "n", "mean_value")


def sessions(events: DataFrame, ts: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.session_window(ts, gap), user).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
