"""Intermediates below type=/year=/month= folders, of which single months can be redone, and what their paths say."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.paths import hadoop_path, month_of, taxi_type_of
from tideline.sources.discovery import filesystem


def write_months(df: DataFrame, path: str, kind: str = "taxi_type", redo: Iterable[tuple[int, int]] = ()) -> None:
    """Write by type, year and month. Folders that the table has rows for replace those that stand there; others stay as they are.

    Of the months to ``redo``, folders that the table has no row for go. Rows are dealt by
    folder first, so that a folder gets few files; Spark splits a folder that is too large for a task.
    """
    folders = ["type", "year", "month"]
    rows = df.withColumnRenamed(kind, "type")
    rows.hint("rebalance", *(F.col(c) for c in folders)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(hadoop_path(path))
    for year, month in redo:
        kept = {str(r["type"]) for r in rows.where((F.col("year") == year) & (F.col("month") == month)).select("type").distinct().collect()}  # a row a type
        fs, pattern = filesystem(df.sparkSession, f"{path}/type=*/year={year}/month={month}")
        for found in fs.globStatus(pattern) or []:
            if found.getPath().getParent().getParent().getName().removeprefix("type=") not in kept:
                fs.delete(found.getPath(), True)


def read_months(spark: SparkSession, path: str, months: Iterable[tuple[int, int]] | None = None) -> DataFrame:
    """The intermediates, of these (year, month) only if any are named: other folders aren't read."""
    rows = spark.read.parquet(hadoop_path(path))
    if months is None:
        return rows
    wanted = [(F.col("year") == y) & (F.col("month") == m) for y, m in months]
    return rows.where(reduce(or_, wanted)) if wanted else rows.limit(0)


def with_path_month(rows: DataFrame, path: str) -> DataFrame:
    """Add path_type, path_year and path_month: what the files' paths below ``path`` say. ``rows``: as read from files."""
    below = F.substring_index(F.col("_metadata.file_path"), path.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    year, month = month_of(below)
    return rows.withColumns({"path_type": taxi_type_of(below), "path_year": year, "path_month": month})
