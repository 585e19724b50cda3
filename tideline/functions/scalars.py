"""Scalar expressions: coercion, clock parts, filling, binning, colours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_datetime(c: Column) -> Column:
    """Timestamp without zone; null where the value can't be read."""
    return c.try_cast("timestamp_ntz")


def to_number(c: Column) -> Column:
    """Double; null where the value can't be read or is NaN."""
    n = c.try_cast("double")
    return F.when(~F.isnan(n), n)


def minutes_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(6e7)


def day_of_week(c: Column) -> Column:
    """0 is Monday."""
    return F.weekday(c)


def day_name(c: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")]), c + 1)


def fill_and_clip(c: Column, fill: float = 1.0, least: float | None = 1.0) -> Column:
    out = F.coalesce(c, F.lit(fill))
    return out if least is None else F.greatest(out, F.lit(least))


def total_of(columns: list[str]) -> Column:
    """Row sum; null counts as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in columns])


def proportions(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column over the row's total; a total of 0 counts as 1."""
    total = total_of(columns)
    df = df.withColumn("__total", F.when(total == 0, 1).otherwise(total))  # a column of its own, so that it isn't added up for each hour
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) / F.col("__total") for c in columns}).drop("__total")


def is_whole(c: Column) -> Column:
    return c.isNotNull() & (c % 1 == 0)


def location_id(c: Column) -> Column:
    """Zone id of a place that may also be a coordinate: null unless whole."""
    return F.when(is_whole(c), c.cast("int"))


def quantile_bin(c: Column, edges: list[float]) -> Column:
    """Number of the bin of right-closed edges, the lowest included; doubled edges count once; null outside."""
    edges = sorted(set(edges))
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        low = c >= edges[i] if i == 0 else c > edges[i]
        out = F.when(low & (c <= edges[i + 1]), i).otherwise(out)
    return out


def colour(c: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """(hex colour from blue to red, radius 4 to 14) of a value on its range; the middle if the range is empty."""
    span = high - low
    part = F.when(span > 0, (c - low) / span).otherwise(0.5)
    red = F.floor(part * 255)
    text = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(red)), 2, "0"), F.lit("00"), F.lpad(F.lower(F.hex(255 - red)), 2, "0"))
    return text, F.when(span > 0, 4 + 10 * part).otherwise(6.0)
