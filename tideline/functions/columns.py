"""Column resolvers: which column of a file plays which role.

Three resolvers with different rules exist side by side, one per stage.
They run on the driver, on column names only.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The zone id without underscores and blanks; known zone names; patterns, asked in order; coordinates.
ZONE_ID = "pulocationid"
ZONE_NAMES = ["pickup_place", "pickup_location_id", "pickup_zone", "pu_zone", "start_location_id"]
LOCATION_PATTERNS = [r".*pickup.*location.*", r".*pulocationid.*", r".*pu_location.*", r".*pu\s*location.*"]
COORDINATE_NAMES = ["pickup_latitude", "pickup_longitude", "pickup_lat", "pickup_lon"]
#: Patterns of the regression stage, asked in order.
FARE_ROLES = {
    "pickup_datetime": [r"tpep_pickup_datetime", r"pickup_datetime", r"trip_pickup_datetime", r".*pickup.*datetime.*"],
    "dropoff_datetime": [r"tpep_dropoff_datetime", r"dropoff_datetime", r"trip_dropoff_datetime", r".*dropoff.*datetime.*"],
    "trip_distance": [r"trip_distance", r"trip_dist", r".*distance.*"],
    "passenger_count": [r"passenger_count", r"passengers", r"pax_count"],
    "fare_amount": [r"fare_amount", r"fare_amt", r"fare"],
    "pickup_location": [r"pulocationid", r"pu_location_id", r"pickup_location", r"pickup_place", r"pulocation"],
}
FARE_REQUIRED = ["pickup_datetime", "dropoff_datetime", "trip_distance", "fare_amount"]
#: Exact names of the classification stage, asked in order.
CLASSIFIER_ROLES = {
    "raw_pickup_datetime": ["tpep_pickup_datetime", "lpep_pickup_datetime", "pickup_datetime"],
    "raw_dropoff_datetime": ["tpep_dropoff_datetime", "lpep_dropoff_datetime", "dropoff_datetime"],
    "trip_distance": ["trip_distance"],
    "passenger_count": ["passenger_count"],
}


def find_datetime_column(columns: Iterable[object]) -> str | None:
    """The first column whose name holds pickup and then datetime, in any case."""
    return next((str(c) for c in columns if re.match(r".*pickup.*datetime.*", str(c), re.I)), None)


def find_location_column(columns: Iterable[object], strict: bool = False) -> str | None:
    """The pickup place: the zone id, a known zone name, a pattern, then (unless strict) a coordinate; each asked of the columns in order."""
    names = [str(c) for c in columns if c is not None and str(c).strip()]
    lower = {c: c.strip().lower() for c in names}
    asked = [lambda c: re.sub(r"[_ ]", "", lower[c]) == ZONE_ID, lambda c: lower[c] in ZONE_NAMES]
    asked += [lambda c, p=p: re.match(p, lower[c]) for p in LOCATION_PATTERNS]
    asked += [] if strict else [lambda c: lower[c] in COORDINATE_NAMES]
    return next((c for fits in asked for c in names if fits(c)), None)


def find_taxi_type_column(columns: Iterable[object]) -> str | None:
    return next((str(c) for c in columns if re.sub(r"[_ ]", "", str(c).lower()) == "taxitype"), None)


def pivot_roles(columns: Iterable[object], strict: bool = False) -> dict[str, str | None]:
    columns = list(columns)
    return {"datetime": find_datetime_column(columns), "location": find_location_column(columns, strict), "taxi_type": find_taxi_type_column(columns)}


def common_schema(columns_of: Mapping[str, Iterable[str]]) -> dict[str, str | None]:
    """Role -> column: the first detection over all files."""
    found: dict[str, str | None] = {"datetime": None, "location": None, "taxi_type": None}
    for columns in columns_of.values():
        for role, column in pivot_roles(columns).items():
            found[role] = found[role] or column
    return found


def normalize_trips(df: DataFrame, roles: Mapping[str, str | None]) -> DataFrame:
    """Rename to pickup_datetime and pickup_location; a taxi_type role needs its column."""
    if roles.get("taxi_type") and roles["taxi_type"] not in df.columns:
        raise ValueError("the mapping names a taxi type column that the table lacks")
    names = {roles[r]: n for r, n in (("datetime", "pickup_datetime"), ("location", "pickup_location"), ("taxi_type", "taxi_type")) if roles.get(r) in df.columns}
    return df.withColumnsRenamed(names)


def normalize_fares(df: DataFrame) -> DataFrame:
    """The regression stage's columns only; ValueError if a required role has none."""
    found = {}
    for role, patterns in FARE_ROLES.items():
        found[role] = next((c for p in patterns for c in df.columns if re.fullmatch(p, c.strip(), re.I)), None)
    if lacking := [r for r in FARE_REQUIRED if not found[r]]:
        raise ValueError(f"no column for {', '.join(lacking)}")
    order = [*FARE_REQUIRED, "passenger_count", "pickup_location"]
    return df.select(*(F.col(f"`{found[r]}`").alias(r) for r in order if found[r]))


def normalize_classifier(df: DataFrame, label: int) -> DataFrame:
    """Rename by exact names, add taxi_type_int; absent roles are left out silently."""
    names = {}
    for role, wanted in CLASSIFIER_ROLES.items():
        if c := next((w for w in wanted if w in df.columns), None):
            names[c] = role
    return df.withColumnsRenamed(names).withColumn("taxi_type_int", F.lit(label))


def hour_columns(columns: Iterable[str]) -> list[str]:
    """Columns hour_N in numeric order."""
    return sorted((c for c in columns if re.fullmatch(r"hour_\d+", c)), key=lambda c: int(c[5:]))


def lower_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])
