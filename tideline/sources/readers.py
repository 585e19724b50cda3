"""Trip tables from files of differing schemas."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.columns import lower_headers, pivot_roles
from tideline.functions.paths import hadoop_path, month_of, taxi_type_of
from tideline.functions.scalars import to_datetime, to_number
from tideline.sources.discovery import footers

CANONICAL = ["pickup_datetime", "pickup_place", "taxi_type", "file", "file_year", "file_month"]


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*map(hadoop_path, paths))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with headers, lower-cased and trimmed."""
    return lower_headers(spark.read.csv(hadoop_path(path), header=True, inferSchema=True))


def parquet_schema(spark: SparkSession, path: str):
    return spark.read.parquet(hadoop_path(path)).schema


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, batch_size: int | None = None) -> DataFrame:
    """Arrow batches of the table through ``f``; with ``batch_size``, of so many rows (a partition's last one may have fewer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if batch_size is None:
                yield f(b)
                continue
            held, rows = [*held, b], rows + b.num_rows
            while rows >= batch_size:
                whole = pa.concat_batches(held)
                yield f(whole.slice(0, batch_size))
                held, rows = [whole.slice(batch_size)], rows - batch_size
        if rows:
            yield f(pa.concat_batches(held))

    return df.mapInArrow(run, schema)


def read_trips(spark: SparkSession, paths: Iterable[str], strict: bool = False, legacy: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """(trips in the canonical columns, errors per file). Files whose columns have the same names and types are one scan; the scans are united.

    Datetimes that can't be read are null. The type comes from its column, else from the path, else it is ``unknown``.
    A file whose data turn out to be damaged ends there; ``batch.run`` reports files without rows.
    """
    groups, errors = defaultdict(list), {}
    for path, typed in footers(spark, paths).items():
        columns = [c for c, _ in typed]
        roles = pivot_roles(columns, strict)
        if not columns:
            errors[path] = "the file can't be read"
        elif not roles["datetime"] or not roles["location"]:
            errors[path] = "no pickup " + ("datetime" if not roles["datetime"] else "location") + " column"
        else:
            groups[tuple(typed)].append(path)
    parts = []
    for typed, files in groups.items():
        roles = pivot_roles([c for c, _ in typed], strict)
        file = F.col("_metadata.file_path")
        year, month = month_of(file)
        kind = F.coalesce(F.col(f"`{roles['taxi_type']}`").cast("string") if roles["taxi_type"] else F.lit(None).cast("string"), taxi_type_of(file, legacy), F.lit("unknown"))
        parts.append(
            spark.read.option("ignoreCorruptFiles", "true").parquet(*map(hadoop_path, files)).select(
                to_datetime(F.col(f"`{roles['datetime']}`")).alias("pickup_datetime"), to_number(F.col(f"`{roles['location']}`")).alias("pickup_place"),
                kind.alias("taxi_type"), file.alias("file"), year.alias("file_year"), month.alias("file_month"),
            )
        )
    if not parts:
        schema = "pickup_datetime timestamp_ntz, pickup_place double, taxi_type string, file string, file_year int, file_month int"
        return spark.createDataFrame([], schema), errors
    return reduce(DataFrame.unionByName, parts), errors


def union_sources(sources: Iterable[tuple[str, DataFrame | None]], label: str = "service") -> DataFrame:
    """UNION ALL of labelled tables, missing ones skipped; columns that some lack are null there."""
    parts = [df.withColumn(label, F.lit(name)) for name, df in sources if df is not None]
    if not parts:
        raise ValueError("no source could be read")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
