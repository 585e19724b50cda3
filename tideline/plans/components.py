"""The component suite over a wide table: fit, tail, scores, stability, diagnostics, map markers."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.columns import lower_headers
from tideline.functions.paths import anonymous_conf
from tideline.functions.scalars import colour
from tideline.models.pca import bootstrap_stability, diagnostics, fit_pca, scores_by_place, tail_analysis
from tideline.operators.joins import centroids, with_location_id
from tideline.session import build_session
from tideline.sources.readers import read_csv, read_parquet
from tideline.sources.shapes import zone_centres
from tideline.sources.sinks import write_csv, write_text


def map_markers(scores: DataFrame, coordinates: DataFrame | None = None, value: str = "pc1", size: str = "pc2", place: str = "pickup_place") -> DataFrame:
    """A marker per place: colour by one score, radius by the size of another; places without coordinates are left out."""
    ends = scores.agg(F.min(value).alias("__a"), F.max(value).alias("__b"), F.min(F.abs(size)).alias("__c"), F.max(F.abs(size)).alias("__d"))
    rows = scores.join(F.broadcast(ends))  # one row
    text, _ = colour(F.col(value), F.col("__a"), F.col("__b"))
    _, radius = colour(F.abs(size), F.col("__c"), F.col("__d"))
    rows = rows.withColumns({"colour": text, "radius": radius}).drop("__a", "__b", "__c", "__d")
    if coordinates is None:
        return rows
    return with_location_id(rows, place).join(coordinates.withColumnRenamed("locationid", "location_id"), "location_id", "left").where("latitude is not null and longitude is not null")


#: Stages of the suite: each can be run alone.
STAGES = ["pca", "tail", "map", "stability", "diagnostics"]


def run(spark: SparkSession, source: str, output: str, resamples: int = 100, zones_csv: str | None = None, only: list[str] | None = None, zones_shp: str | None = None) -> dict:
    wide, stages = read_parquet(spark, source), only or STAGES
    place = "pickup_place"
    model = fit_pca(wide)
    if {"pca", "map"} & set(stages):
        scores = scores_by_place(wide, model, place)
        write_csv(scores, f"{output}/pc_scores")
        if (zones_csv or zones_shp) and "map" in stages:
            zones = read_csv(spark, zones_csv) if zones_csv else lower_headers(centroids(zone_centres(spark, zones_shp)))
            write_csv(map_markers(scores, zones, place=place), f"{output}/map_markers")
    keys = [c for c in wide.columns if not c.startswith("hour_")]
    made = {"pca": lambda: asdict(model), "tail": lambda: tail_analysis(model), "stability": lambda: bootstrap_stability(wide, keys, resamples), "diagnostics": lambda: diagnostics(model)}
    found = {name: f() for name, f in made.items() if name in stages}
    for name, content in found.items():
        write_text(spark, f"{output}/{name}.json", json.dumps(content, indent=2))
    return found


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Principal components of a wide table and what follows from them")
    p.add_argument("--input", required=True)
    p.add_argument("--output-dir", required=True)
    p.add_argument("--s3-output")
    p.add_argument("--zones-csv")
    p.add_argument("--zones-shp", help="shapefile of the zones, if there is no table of coordinates")
    p.add_argument("--B", type=int, default=100)
    p.add_argument("--anon-s3", action="store_true", help="read s3 paths without credentials")
    p.add_argument("--workers", type=int, help="cores of a local session")
    p.add_argument("--only", choices=STAGES, action="append", help="stages to run; all by default")
    a = p.parse_args(args)
    spark = build_session("components", f"local[{a.workers}]" if a.workers else None, anonymous_conf(a.input) if a.anon_s3 else None)
    run(spark, a.input, (a.s3_output or a.output_dir).rstrip("/"), a.B, a.zones_csv, a.only, a.zones_shp)


if __name__ == "__main__":
    main()
