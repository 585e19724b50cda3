"""The hourly pivot: trips counted per key and hour into 24 columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.columns import hour_columns
from tideline.functions.scalars import to_datetime, total_of

HOURS = range(24)


def hourly_pivot(df: DataFrame, keys: list[str], hour: Column, also: list[str] | None = None) -> DataFrame:
    """Count rows per key and hour: one conditional aggregate, one shuffle. Rows with a null key or hour don't count."""
    keys = [*(also or []), *keys]
    rows = df.select(*keys, hour.alias("__hour")).dropna(subset=[*keys, "__hour"])
    return rows.groupBy(*keys).agg(*(F.count_if(F.col("__hour") == h).alias(f"hour_{h}") for h in HOURS))


def pivot_trips(df: DataFrame, datetime: str = "pickup_datetime", location: str = "pickup_location", taxi_type: str = "taxi_type") -> DataFrame:
    """(taxi_type, date, pickup_place, hour_0 .. hour_23) of a trip table; unreadable datetimes are dropped."""
    for column, role in ((datetime, "pickup datetime"), (location, "pickup location"), (taxi_type, "taxi type")):
        if column not in df.columns:
            raise ValueError(f"no {role} column: {column}")
    at = to_datetime(F.col(datetime))
    rows = df.select(F.col(taxi_type).alias("taxi_type"), F.to_date(at).alias("date"), F.col(location).alias("pickup_place"), F.hour(at).alias("h"))
    return hourly_pivot(rows, ["taxi_type", "date", "pickup_place"], F.col("h"))


def low_count_cleanup(wide: DataFrame, min_rides: int) -> DataFrame:
    """Rows with at least ``min_rides`` over all hours; unchanged without hour columns."""
    hours = hour_columns(wide.columns)
    return wide.where(total_of(hours) >= min_rides) if hours else wide


def cleanup_stats(wide: DataFrame, min_rides: int) -> DataFrame:
    """rows_before, rows_after, rows_removed, min_rides: one row, one pass."""
    hours = hour_columns(wide.columns)
    kept = F.count_if(total_of(hours) >= min_rides) if hours else F.count("*")
    stats = wide.agg(F.count("*").alias("rows_before"), kept.alias("rows_after"))
    return stats.select("rows_before", "rows_after", (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"), F.lit(min_rides).alias("min_rides"))


def combine(per_file: DataFrame, keys: list[str]) -> DataFrame:
    """Sum the hour columns of several files' pivots per key."""
    hours = hour_columns(per_file.columns)
    return per_file.groupBy(*keys).agg(*(F.sum(h).alias(h) for h in hours))


def combine_with_threshold(df: DataFrame, file: str, keys: list[str], hour: Column, min_rides: int) -> DataFrame:
    """Two levels: count per file and key, keep counts of ``min_rides``, then sum over files."""
    per_file = hourly_pivot(df, keys, hour, also=[file])
    return combine(low_count_cleanup(per_file, min_rides), keys)


def row_breakdown(wide: DataFrame, date: str = "date", kind: str = "taxi_type") -> DataFrame:
    return wide.groupBy(F.year(date).alias("year"), kind).agg(F.count("*").alias("row_count"))
