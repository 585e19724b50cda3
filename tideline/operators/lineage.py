"""Cutting the lineage of small tables that are made in rounds."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []

def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and Spark runs within this process, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tideline-shared-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return "file://" + _own[0]


def cut(df: DataFrame) -> DataFrame:
    """The table, written to the session's checkpoint folder and read from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
