"""Month and taxi type from file paths, as column expressions and as plain functions."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns asked in order; only the first hit of each counts.
MONTH_PATTERNS = [r"(\d{4})-(\d{2})", r"year=(\d{4}).*month=(\d{1,2})", r"(\d{4})(\d{2})"]
TAXI_TYPES = ["yellow", "green", "fhvhv", "fhv"]
#: The older order, in which fhvhv can't be reached.
LEGACY_TAXI_TYPES = ["yellow", "green", "fhv", "fhvhv"]


def month_of(path: Column) -> tuple[Column, Column]:
    """(year, month) as nullable integers."""
    year = month = F.lit(None).cast("int")
    for p in reversed(MONTH_PATTERNS):
        y, m = (F.regexp_extract(path, p, i).try_cast("int") for i in (1, 2))
        good = m.between(1, 12)
        year, month = F.when(good, y).otherwise(year), F.when(good, m).otherwise(month)
    return year, month


def taxi_type_of(path: Column, legacy: bool = False) -> Column:
    """The type that the path names, or null."""
    out = F.lit(None).cast("string")
    for t in reversed(LEGACY_TAXI_TYPES if legacy else TAXI_TYPES):
        out = F.when(F.contains(F.lower(path), F.lit(t)), t).otherwise(out)
    return out


def infer_month(path: str) -> tuple[int, int] | None:
    for p in MONTH_PATTERNS:
        if (m := re.search(p, path)) and 1 <= int(m[2]) <= 12:
            return int(m[1]), int(m[2])
    return None


def infer_taxi_type(path: str, legacy: bool = False) -> str | None:
    return next((t for t in (LEGACY_TAXI_TYPES if legacy else TAXI_TYPES) if t in path.lower()), None)


def group_by_month(paths: Iterable[str]) -> dict[tuple[int | None, int | None], list[str]]:
    """Month -> paths, in order; paths without one under (None, None), last."""
    found = defaultdict(list)
    for p in paths:
        found[infer_month(p) or (None, None)].append(p)
    return dict(sorted(found.items(), key=lambda x: (x[0][0] is None, x[0])))


def is_s3_path(path: str, legacy: bool = False) -> bool:
    """Any case of ``s3://``, and ``s3a://``; legacy: ``s3://`` only."""
    return path.lower().startswith("s3://" if legacy else ("s3://", "s3a://"))


def hadoop_path(path: str) -> str:
    """The path that Spark reads: s3 becomes s3a."""
    return re.sub(r"^s3://", "s3a://", path, flags=re.I)


def storage_options(path: str) -> dict[str, object]:
    return {"anon": True, "requester_pays": False} if is_s3_path(path) else {}


def anonymous_conf(path: str) -> dict[str, str]:
    """Spark settings that the storage options stand for."""
    return {"spark.hadoop.fs.s3a.aws.credentials.provider": "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider"} if is_s3_path(path) else {}
