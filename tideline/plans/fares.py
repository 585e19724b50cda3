"""Fare regression end to end: trips to cleaned features, enrichment, additive splines, evaluation."""

from __future__ import annotations

import argparse
import json
from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.paths import anonymous_conf

from tideline.functions.columns import normalize_fares
from tideline.functions.scalars import day_of_week, fill_and_clip, minutes_between, to_datetime, to_number
from tideline.models.gam import Gam, Linear, Smooth, fit_by_group
from tideline.operators import aggregates as agg
from tideline.operators.filters import cap_sequentially, positive
from tideline.operators.lineage import cut
from tideline.operators.joins import enrich, enrich_if_matched, zone_lookup
from tideline.operators.sampling import sample_rows, stratified_split
from tideline.session import build_session
from tideline.sources.readers import read_csv, read_parquet, union_sources
from tideline.sources.sinks import write_csv, write_text

#: Fixed values of the stage: services compared, boroughs compared, least rows of a group.
BOROUGHS = ["Manhattan", "Brooklyn", "Queens", "Bronx", "Staten Island"]
LEAST_ROWS = 200
MEASURES = ["fare_amount", "trip_distance", "duration_min"]


def fare_features(raw: DataFrame, max_rows: int | None = None, seed: int = 42, clip_passengers: bool = True, cap: float = 0.99) -> DataFrame:
    """Canonical columns, clock features, cleaned and capped rows.

    Passengers that are missing count as 1; below 1 they are raised to it unless ``clip_passengers`` is off.
    """
    df = normalize_fares(raw)
    at, end = to_datetime(F.col("pickup_datetime")), to_datetime(F.col("dropoff_datetime"))
    df = df.withColumns({"pickup_datetime": at, "dropoff_datetime": end, "trip_distance": to_number(F.col("trip_distance")), "fare_amount": to_number(F.col("fare_amount"))})
    people = to_number(F.col("passenger_count")) if "passenger_count" in df.columns else F.lit(None).cast("double")
    df = df.withColumns({
        "duration_min": minutes_between(F.col("pickup_datetime"), F.col("dropoff_datetime")), "hour": F.hour("pickup_datetime"), "day_of_week": day_of_week(F.col("pickup_datetime")),
        "passenger_count": fill_and_clip(people, 1.0, 1.0 if clip_passengers else None),
    })
    if max_rows is not None:
        df = sample_rows(df, max_rows, *df.columns, seed=seed)
    return cap_sequentially(positive(df, MEASURES, ["hour", "day_of_week"]), MEASURES, cap)


def add_scores(trips: DataFrame, scores: DataFrame, place: str = "pickup_place") -> tuple[DataFrame, bool]:
    """pc1 and pc2 of the pickup zone, medians where it has none; left out below a match rate of 10 %."""
    lookup = scores.select(F.col(place).cast("double").alias("pickup_location"), "pc1", "pc2")
    return enrich_if_matched(trips.withColumn("pickup_location", to_number(F.col("pickup_location"))), lookup, "pickup_location", ["pc1", "pc2"])


def add_boroughs(trips: DataFrame, zones: DataFrame) -> DataFrame:
    """borough of the pickup zone, Unknown where it has none."""
    lookup = zone_lookup(zones.select(F.col("locationid").cast("double").alias("pickup_location"), "borough"), "pickup_location", "borough")
    return enrich(trips, lookup, "pickup_location", {"borough": "Unknown"})


def terms(with_scores: bool) -> list[Smooth | Linear]:
    out = [Smooth("trip_distance"), Smooth("duration_min"), Smooth("hour", 24), Smooth("day_of_week", 7), Linear("passenger_count")]
    return [*out, Smooth("pc1"), Smooth("pc2")] if with_scores else out


def fit_fares(features: DataFrame, with_scores: bool = False, resamples: int = 50, train: float = 0.8, seed: int = 42) -> tuple[Gam, DataFrame, DataFrame]:
    """(model, rmse mae r2 of the held-out rows, those rows with predictions)."""
    split = stratified_split(features.withColumn("stratum", F.lit(1)), "stratum", *features.columns, fraction=train, seed=seed).drop("stratum")
    model = Gam(terms(with_scores), "fare_amount").fit(split.where("split = 'train'"), resamples=resamples, seed=seed)
    held = model.transform(split.where("split = 'valid'"))
    return model, agg.regression_metrics(held, F.col("fare_amount"), F.col("prediction")), held


def by_borough(trips: DataFrame) -> tuple[DataFrame, dict[str, Gam]]:
    """(mean fare by borough and hour, a model per borough with enough rows)."""
    known = trips.where(F.col("borough") != "Unknown")
    grid = agg.mean_grid(known, "borough", F.col("hour"), "fare_amount", list(range(24)), "hour_")
    return grid, fit_by_group(known, "borough", [Smooth("trip_distance"), Smooth("duration_min"), Smooth("hour", 24)], "fare_amount", BOROUGHS, LEAST_ROWS)


def compare_services(sources: Iterable[tuple[str, DataFrame | None]], max_rows: int | None = 100_000) -> tuple[DataFrame, DataFrame, dict[str, Gam]]:
    """(fare statistics, log trend of fare on distance, a model) per service; missing services are skipped.

    The measures that are left are persisted while they are compared, as quantiles and models take several passes.
    """
    parts = [(name, fare_features(df, max_rows, clip_passengers=False).select(*MEASURES) if df is not None else None) for name, df in sources]
    rows = union_sources(parts).persist(StorageLevel.MEMORY_AND_DISK)
    names = [name for name, df in parts if df is not None]
    try:
        stats, trend = cut(agg.group_stats(rows, "service", "fare_amount")), cut(agg.log_trend(rows, "service", "trip_distance", "fare_amount"))  # a row a service
        return stats, trend, fit_by_group(rows, "service", [Smooth("trip_distance"), Smooth("duration_min")], "fare_amount", names, LEAST_ROWS)
    finally:
        rows.unpersist()


def run(spark: SparkSession, source: str, output: str, max_rows: int | None = None, scores_csv: str | None = None, zones_csv: str | None = None, resamples: int = 50, train: float = 0.8, seed: int = 42) -> dict:
    """Fit the fares of one file or folder; metrics, curves and bands as fares.json, the parts of the terms and mean fares by borough as CSV."""
    trips, scored = fare_features(read_parquet(spark, source), max_rows, seed), False
    if scores_csv:
        trips, scored = add_scores(trips, read_csv(spark, scores_csv))
    trips = trips.persist()  # read for the split, the ranges, the moments and the errors
    try:
        model, metrics, held = fit_fares(trips, scored, resamples, train, seed)
        used = terms(scored)
        curves = {t.column: model.partial_dependence(i) for i, t in enumerate(used)}
        bands = {t.column: model.bootstrap_band(i) for i, t in enumerate(used)} if model.boot else {}
        found = {"rows": model.n, "penalty": float(model.lam), "with_scores": scored, **metrics.first().asDict(), "partial_dependence": curves, "bootstrap": bands}
        write_text(spark, f"{output}/fares.json", json.dumps(found, indent=2))
        write_csv(model.breakdown(held), f"{output}/breakdown")
        if zones_csv:
            grid, models = by_borough(add_boroughs(trips, read_csv(spark, zones_csv)))
            write_csv(grid, f"{output}/borough_hours")
            write_text(spark, f"{output}/boroughs.json", json.dumps({b: {"rows": m.n, "trip_distance": m.partial_dependence(0)} for b, m in models.items()}, indent=2))
        return found
    finally:
        trips.unpersist()


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Additive spline regression of trip fares")
    p.add_argument("--input", required=True, help="Parquet file or folder of one service's trips")
    p.add_argument("--output-dir", required=True)
    p.add_argument("--max-rows", type=int, help="sample so many rows; all by default")
    p.add_argument("--scores-csv", help="scores of the pickup places' components")
    p.add_argument("--zones-csv", help="table of zones and boroughs")
    p.add_argument("--resamples", type=int, default=50)
    p.add_argument("--train", type=float, default=0.8)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--anon-s3", action="store_true", help="read s3 paths without credentials")
    a = p.parse_args(args)
    spark = build_session("fares", None, anonymous_conf(a.input) if a.anon_s3 else None)
    run(spark, a.input, a.output_dir.rstrip("/"), a.max_rows, a.scores_csv, a.zones_csv, a.resamples, a.train, a.seed)


if __name__ == "__main__":
    main()
