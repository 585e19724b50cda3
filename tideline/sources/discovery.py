"""Finding Parquet files, and what their footers say."""

from __future__ import annotations

import os
import random
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from tideline.functions.paths import hadoop_path, is_s3_path


#: Footers that are read at a time.
FOOTERS = 32


def filesystem(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of any path that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(hadoop_path(path))
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _list(spark: SparkSession, path: str) -> list[str]:
    fs, p = filesystem(spark, path)
    found, files = [], fs.listFiles(p, True)
    while files.hasNext():
        f = files.next().getPath()
        if f.getName().endswith(".parquet"):
            found.append(f.toUri().getPath() if f.toUri().getScheme() in (None, "file") else f.toString())
    return sorted(found)


def discover(spark: SparkSession, path: str) -> list[str]:
    """All Parquet files below a folder, sorted; ValueError if it is empty text, missing, or no folder."""
    if not path:
        raise ValueError("the input path is empty")
    if not is_s3_path(path) and "://" not in path:
        if not os.path.exists(path):
            raise ValueError(f"{path} does not exist")
        if not os.path.isdir(path):
            raise ValueError(f"{path} is not a directory")
        path = os.path.abspath(path)
    return _list(spark, path)


def discover_any(spark: SparkSession, paths: str) -> list[str]:
    """As ``discover``, but also a comma-separated list in its order, or a single file; nothing is checked."""
    out: list[str] = []
    for p in filter(None, (x.strip() for x in paths.split(","))):
        out += [p] if p.endswith(".parquet") else _list(spark, p)
    return out


def footers(spark: SparkSession, paths: Iterable[str]) -> dict[str, list[tuple[str, str]]]:
    """(column, type) per file, from the footers; none for a file that can't be read.

    Each footer is a Spark job of its own, as only Spark reaches all file
    systems; FOOTERS of them run side by side.
    """

    def one(path: str) -> list[tuple[str, str]]:
        try:
            return spark.read.parquet(hadoop_path(path)).dtypes
        except (PySparkException, Py4JJavaError):  # a bad file must not stop the survey of the others
            return []

    paths = list(paths)
    with ThreadPoolExecutor(FOOTERS) as pool:
        return dict(zip(paths, pool.map(one, paths), strict=True))


def column_names(spark: SparkSession, paths: Iterable[str]) -> dict[str, list[str]]:
    """Columns per file."""
    return {p: [c for c, _ in columns] for p, columns in footers(spark, paths).items()}


def sample_files(paths: list[str], n: int = 5, seed: int = 42) -> list[str]:
    return random.Random(seed).sample(paths, min(n, len(paths)))


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a folder or prefix; whether there was one."""
    fs, p = filesystem(spark, path)
    return bool(fs.delete(p, True))
