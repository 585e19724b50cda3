"""Row filters with their accounting, and sequential percentile caps."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.quantiles import exact_quantile


def discards(df: DataFrame, readable: Column, matches: Column) -> DataFrame:
    """input_rows, parse_fail, mismatch, after_filters in one pass; a null match counts as a match (month unknown)."""
    good = F.coalesce(matches, F.lit(True))
    out = df.agg(F.count("*").alias("input_rows"), F.count_if(~readable).alias("parse_fail"), F.count_if(readable & ~good).alias("mismatch"))
    return out.withColumn("after_filters", F.col("input_rows") - F.col("parse_fail") - F.col("mismatch"))


def drop_mismatches(df: DataFrame, at: Column, year: Column, month: Column) -> DataFrame:
    """Rows whose own month is the file's, or whose file's month is unknown; unreadable datetimes go."""
    same = (F.year(at) == year) & (F.month(at) == month)
    return df.where(at.isNotNull() & F.coalesce(same, F.lit(True)))


def mismatches_by_month(df: DataFrame, at: Column, year: Column, month: Column, group: Column) -> DataFrame:
    """year, month, mismatch_rows, affected_groups; months without a mismatch stay, with 0."""
    wrong = ~((F.year(at) == year) & (F.month(at) == month))
    return df.groupBy(year.alias("year"), month.alias("month")).agg(F.count_if(wrong).alias("mismatch_rows"), F.count_distinct(F.when(wrong, group)).alias("affected_groups"))


def positive(df: DataFrame, above_zero: list[str], present: list[str] | None = None) -> DataFrame:
    """Rows with all of ``present`` and with ``above_zero`` above 0."""
    return df.dropna(subset=[*above_zero, *(present or [])]).where(reduce(lambda a, b: a & b, [F.col(c) > 0 for c in above_zero]))


def cap_sequentially(df: DataFrame, columns: list[str], q: float = 0.99) -> DataFrame:
    """Rows up to each column's quantile, each taken over the rows that the caps before it leave.

    The columns are persisted while the caps are looked for, so that ``df`` is computed once for them.
    """
    values = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ends = values.agg(*(f(F.when(~F.isnan(c), F.col(c))).alias(f"{n}_{c}") for c in columns for n, f in (("a", F.min), ("b", F.max)))).first()
        left = values
        for c in columns:
            limit = exact_quantile(left, c, q, (ends[f"a_{c}"], ends[f"b_{c}"]))
            if limit is not None:
                left, df = left.where(F.col(c) <= limit), df.where(F.col(c) <= limit)
    finally:
        values.unpersist()
    return df
