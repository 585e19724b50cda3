"""Written tables in the folder that all executors share.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir`` and reading it
back, so that a lost executor never loses more than the tasks it was running.
The setting is read from the session; only where it is unset and Spark runs
within this process (local tests) a temporary folder takes its place.

Tables belong to the innermost ``scope`` of their thread; without one they stay
until ``release``. An operator that has stored what it derived from a table
deletes it with ``drop``.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_unscoped: list[str] = []
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def root(spark: SparkSession) -> str:
    """The shared folder; a temporary one if the session names none and runs locally."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tideline-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return "file://" + _own[0]


def _written() -> list[str]:
    mine = _scope.get()
    return _unscoped if mine is None else mine


@contextmanager
def scope() -> Iterator[list[str]]:
    """The paths of the tables that are written within, in order. What the caller hasn't deleted passes on to the scope around."""
    mine: list[str] = []
    token = _scope.set(mine)
    try:
        yield mine
    finally:
        _scope.reset(token)
        _written().extend(mine)


def table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` below the shared folder and return the table that was written. ``options``: of the Parquet writer."""
    spark = df.sparkSession
    path = f"{root(spark)}/tideline/{name}-{uuid.uuid4().hex}"
    _written().append(path)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables (as ``table`` returned them) that nothing will read again."""
    for t in tables:
        _delete(t.sparkSession, t._scratch)
        if t._scratch in _written():
            _written().remove(t._scratch)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete these tables and empty the list. Only for callers that have stored what they derived from them."""
    while paths:
        _delete(spark, paths.pop())


def release(spark: SparkSession) -> None:
    """Delete all tables of this process that no open scope holds. Only when results are stored."""
    delete(spark, _unscoped)
