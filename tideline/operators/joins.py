"""Left joins with lookup tables, filling, and match rates.

Lookups are broadcast by Spark below its size threshold and shuffled beyond it;
no hint is given, as their size isn't known here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalars import location_id
from tideline.operators.quantiles import exact_quantile


def enrich(df: DataFrame, lookup: DataFrame, on: str, fill: dict[str, object] | None = None) -> DataFrame:
    """Left join on one key. Null keys match nothing."""
    out = df.join(lookup, on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in (fill or {}).items()})


def zone_lookup(zones: DataFrame, key: str, *columns: str) -> DataFrame:
    """The distinct (key, columns) of a lookup table."""
    return zones.select(key, *columns).dropDuplicates()


def with_location_id(df: DataFrame, place: str = "pickup_place") -> DataFrame:
    """Add location_id and drop places that are no zone id, as coordinates are."""
    return df.withColumn("location_id", location_id(F.col(place).try_cast("double"))).where("location_id is not null")


def centroids(points: DataFrame, key: str = "LocationID", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Mean coordinates per zone."""
    return points.groupBy(key).agg(F.avg(lat).alias("latitude"), F.avg(lon).alias("longitude"))


def match_rate(joined: DataFrame, column: str) -> DataFrame:
    """matched, total, pct: how many rows found a partner."""
    out = joined.agg(F.count(column).alias("matched"), F.count("*").alias("total"))
    return out.withColumn("pct", F.round(100 * F.col("matched") / F.col("total"), 6))


def fill_with_median(df: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        middle = exact_quantile(df, c, 0.5)
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(middle).cast("double")))
    return df


def enrich_if_matched(df: DataFrame, lookup: DataFrame, on: str, columns: list[str], least_pct: float = 10.0) -> tuple[DataFrame, bool]:
    """Join and fill with medians if at least ``least_pct`` of the rows match; else the rows as they were."""
    out = df.join(lookup.select(on, *columns), on, "left")
    if (match_rate(out, columns[0]).first()["pct"] or 0.0) < least_pct:
        return df, False
    return fill_with_median(out, columns), True
