"""Trip-type classification end to end: from raw trips, and from places' hourly profiles."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.columns import hour_columns, normalize_classifier, pivot_roles
from tideline.functions.paths import anonymous_conf
from tideline.functions.scalars import day_of_week, minutes_between, proportions, quantile_bin, to_datetime, to_number, total_of
from tideline.models.pca import Pca, fit_pca
from tideline.models.trees import accuracy, accuracy_bootstrap, evaluate, importances
from tideline.operators import aggregates as agg
from tideline.operators.filters import positive
from tideline.operators.pivot import hourly_pivot
from tideline.operators.quantiles import exact_quantile
from tideline.operators.sampling import sample_balanced, sample_fraction
from tideline.session import build_session
from tideline.sources.readers import read_parquet
from tideline.sources.sinks import write_text

TRIP_FEATURES = ["trip_distance", "passenger_count", "duration_min", "hour", "day_of_week"]
MIN_RIDES, COMPONENTS, SAMPLE = 20, 5, 0.15


def trip_features(raw: DataFrame, label: int) -> DataFrame:
    """Cleaned features of one service's trips: nothing missing, distance, duration and passengers above 0."""
    df = normalize_classifier(raw, label)
    at, end = to_datetime(F.col("raw_pickup_datetime")), to_datetime(F.col("raw_dropoff_datetime"))
    rows = df.select(at.alias("at"), minutes_between(at, end).alias("duration_min"), to_number(F.col("trip_distance")).alias("trip_distance"), to_number(F.col("passenger_count")).alias("passenger_count"), "taxi_type_int")
    rows = rows.withColumns({"hour": F.hour("at"), "day_of_week": day_of_week(F.col("at"))})
    return positive(rows, ["trip_distance", "duration_min", "passenger_count"], ["hour"])


def classify_trips(services: dict[int, DataFrame], rows_per_class: int = 50_000, trees: int = 100, seed: int = 42) -> dict:
    """Accuracy, its bootstrap, report, confusion matrix and importances of trees on raw trips."""
    parts = [trip_features(df, label) for label, df in services.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    keys = ["at", *TRIP_FEATURES]
    return _evaluated(sample_balanced(rows, "taxi_type_int", rows_per_class, *keys, seed=seed), TRIP_FEATURES, "taxi_type_int", keys, trees)


def profiles(services: dict[str, DataFrame], datetime: str = "pickup_datetime", place: str = "pickup_place", fraction: float = SAMPLE, min_rides: int = MIN_RIDES) -> DataFrame:
    """Hourly counts of (taxi_type, date, place) in a sample of trips, of keys with enough rides."""
    out = None
    for name, df in services.items():
        at = to_datetime(F.col(datetime))
        rows = sample_fraction(df, fraction, *df.columns).select(F.lit(name).alias("taxi_type"), F.to_date(at).alias("date"), F.col(place).alias("pickup_place"), F.hour(at).alias("h")).where(F.col("h").between(0, 23))
        wide = hourly_pivot(rows, ["taxi_type", "date", "pickup_place"], F.col("h"))
        out = wide if out is None else out.unionByName(wide)
    return out.where(F.col("taxi_type").isin("yellow", "green")).where(total_of(hour_columns(out.columns)) >= min_rides)


def with_profile_features(wide: DataFrame, k: int = COMPONENTS, shares: bool = False) -> tuple[DataFrame, Pca]:
    """Scores of the hours' shares, calendar parts, zone id (-1: none) and its fifth of all zones (2: none). ``shares``: ``wide`` has shares already, best persisted."""
    shares = wide if shares else proportions(wide, hour_columns(wide.columns))
    model = fit_pca(shares, k)
    zone = to_number(F.col("pickup_place"))
    edges = [exact_quantile(shares.select(zone.alias("z")), "z", q) for q in (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)]
    binned = quantile_bin(zone, edges) if None not in edges else F.lit(None).cast("int")
    return shares.withColumns({f"pc{i + 1}": model.score(i) for i in range(k)} | {
        "year": F.year("date"), "month": F.month("date"), "dow": F.coalesce(day_of_week(F.col("date")), F.lit(-1)),
        "zone": F.coalesce(zone.cast("int"), F.lit(-1)), "region": F.coalesce(binned, F.lit(2)),
    }), model


def classify_profiles(wide: DataFrame, enriched: bool = True, trees: int = 100) -> dict:
    """As ``classify_trips`` from hourly profiles; green is 0, yellow 1, as labels sort."""
    shares = proportions(wide, hour_columns(wide.columns)).persist()  # else every score copies the plan of every share
    try:
        rows, _ = with_profile_features(shares, shares=True)
        rows = rows.withColumn("label", (F.col("taxi_type") == "yellow").cast("int"))
        features = [f"pc{i + 1}" for i in range(COMPONENTS)] + (["year", "month", "dow", "zone", "region"] if enriched else [])
        return _evaluated(rows, features, "label", ["taxi_type", "date", "pickup_place"], trees)
    finally:
        shares.unpersist()


def _evaluated(rows: DataFrame, features: list[str], label: str, keys: list[str], trees: int) -> dict:
    model, held = evaluate(rows, features, label, keys, trees=trees)
    held = held.persist()
    found = {
        "accuracy": accuracy(held, label), "bootstrap": accuracy_bootstrap(held, label, "prediction", keys).first().asDict(), "report": [r.asDict() for r in agg.classification_report(held, label, "prediction").collect()],
        "confusion": [r.asDict() for r in agg.confusion(held, label, "prediction").collect()], "importances": importances(model, features), "model": model,
    }
    held.unpersist()
    return found


def run(spark: SparkSession, services: dict[str, str], output: str, rows_per_class: int = 50_000, trees: int = 100, by_profiles: bool = False) -> dict:
    """Tell services (name -> Parquet path, in the order of their labels from 0) apart by their trips, or yellow from green by places' hourly profiles; classes.json."""
    raw = {name: read_parquet(spark, path) for name, path in services.items()}
    if by_profiles:
        columns = {name: pivot_roles(df.columns) for name, df in raw.items()}
        found = classify_profiles(profiles({name: df.select(F.col(f"`{columns[name]['datetime']}`").alias("pickup_datetime"), F.col(f"`{columns[name]['location']}`").alias("pickup_place")) for name, df in raw.items()}), trees=trees)
    else:
        found = classify_trips(dict(enumerate(raw.values())), rows_per_class, trees)
    told = {k: v for k, v in found.items() if k != "model"}
    write_text(spark, f"{output}/classes.json", json.dumps({"services": list(services), **told}, indent=2, default=str))
    return found


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Boosted trees that tell the types of trips apart")
    p.add_argument("--green", required=True, help="Parquet file or folder of green trips (label 0)")
    p.add_argument("--yellow", required=True, help="of yellow trips (label 1)")
    p.add_argument("--output-dir", required=True)
    p.add_argument("--rows-per-class", type=int, default=50_000)
    p.add_argument("--trees", type=int, default=100)
    p.add_argument("--profiles", action="store_true", help="from hourly profiles of places instead of trips")
    p.add_argument("--anon-s3", action="store_true", help="read s3 paths without credentials")
    a = p.parse_args(args)
    spark = build_session("classes", None, anonymous_conf(a.green) if a.anon_s3 else None)
    run(spark, {"green": a.green, "yellow": a.yellow}, a.output_dir.rstrip("/"), a.rows_per_class, a.trees, a.profiles)


if __name__ == "__main__":
    main()
