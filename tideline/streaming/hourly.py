"""The hourly pivot over a stream: an extension, with no counterpart in batch-only use.

Counts are kept per key and hour under a watermark; a batch writer folds them
into the wide form, so late rows within the watermark change their cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tideline.operators.pivot import HOURS


def hourly_counts(stream: DataFrame, keys: list[str], at: str, delay: str = "2 hours") -> DataFrame:
    """Rows per key and hour window; rows later than ``delay`` are dropped."""
    rows = stream.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", delay)
    counts = rows.groupBy(F.window("__at", "1 hour").alias("w"), *keys).agg(F.count("*").alias("n"))
    return counts.select(*keys, F.to_date("w.start").alias("date"), F.hour("w.start").alias("hour"), "n")


def widen(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Hour rows as 24 columns per key and date."""
    return counts.groupBy(*keys, "date").agg(*(F.coalesce(F.sum(F.when(F.col("hour") == h, F.col("n"))), F.lit(0)).alias(f"hour_{h}") for h in HOURS))


def write_pivot(stream: DataFrame, keys: list[str], at: str, path: str, checkpoint: str, delay: str = "2 hours") -> StreamingQuery:
    """Append each hour once its watermark has passed, as Parquet; ``widen`` reads it."""
    counts = hourly_counts(stream, keys, at, delay)
    return counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
