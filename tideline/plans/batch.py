"""The batch pivot: files to the combined wide table, with its report.

Scan, normalise, filter, count per file and key, keep counts of min_rides, sum
over files, write. The discards are counted in one more pass over the same
columns, per file; months and the whole are sums of those.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.paths import anonymous_conf
from tideline.functions.scalars import total_of
from tideline.functions.sizes import peak_memory_mb, scan_conf
from tideline.operators.filters import drop_mismatches
from tideline.operators.pivot import combine, hourly_pivot, low_count_cleanup, row_breakdown
from tideline.session import build_session
from tideline.sources.discovery import delete, discover
from tideline.sources.readers import read_trips
from tideline.sources.sinks import performance_markdown, report_for, write_text, write_wide

KEYS = ["taxi_type", "date", "pickup_place"]


def per_file_pivot(trips: DataFrame) -> DataFrame:
    """One row per file and key, of the rows whose month is their file's."""
    kept = drop_mismatches(trips, F.col("pickup_datetime"), F.col("file_year"), F.col("file_month"))
    rows = kept.select("file", "taxi_type", F.to_date("pickup_datetime").alias("date"), "pickup_place", F.hour("pickup_datetime").alias("h"))
    return hourly_pivot(rows, KEYS, F.col("h"), also=["file"])


def file_statistics(trips: DataFrame) -> DataFrame:
    """Per file: input_rows, parse_fail, mismatch, after_filters."""
    at, wrong = F.col("pickup_datetime"), ~((F.year("pickup_datetime") == F.col("file_year")) & (F.month("pickup_datetime") == F.col("file_month")))
    out = trips.groupBy("file", "file_year", "file_month").agg(F.count("*").alias("input_rows"), F.count_if(at.isNull()).alias("parse_fail"), F.count_if(at.isNotNull() & F.coalesce(wrong, F.lit(False))).alias("mismatch"))
    return out.withColumn("after_filters", F.col("input_rows") - F.col("parse_fail") - F.col("mismatch"))


def month_statistics(files: DataFrame) -> DataFrame:
    """File statistics rolled up to months and to the whole (nulls); level 0 is a month, 1 the whole."""
    sums = [F.sum(c).alias(c) for c in ("input_rows", "parse_fail", "mismatch", "after_filters")]
    months = files.groupBy("file_year", "file_month").agg(F.count("*").alias("files"), *sums).withColumn("level", F.lit(0))
    whole = files.agg(F.count("*").alias("files"), *sums).withColumns({"file_year": F.lit(None).cast("int"), "file_month": F.lit(None).cast("int"), "level": F.lit(1)})
    return months.unionByName(whole).orderBy("level", F.asc_nulls_last("file_year"), F.asc_nulls_last("file_month"))


def run(spark: SparkSession, input_dir: str, output: str, min_rides: int = 50, max_files: int | None = None, report_file: str | None = None, keep_intermediate: bool = False, intermediate_dir: str | None = None, by_month: bool = False, intermediate_by_month: bool = False) -> dict:
    began, phases = time.time(), {}

    def phase(name: str, since: float) -> float:
        phases[name] = round(time.time() - since, 2)
        return time.time()

    t = began
    paths = discover(spark, input_dir)[:max_files]
    t = phase("discovery", t)
    trips, errors = read_trips(spark, paths)
    t = phase("validation", t)
    middle = (intermediate_dir or output.rstrip("/") + "_intermediate").rstrip("/")
    write_wide(per_file_pivot(trips), middle, intermediate_by_month)
    pivots = spark.read.parquet(middle).drop("year", "month")
    files = file_statistics(trips).persist()
    totals = [r for r in month_statistics(files).collect()][-1]
    months = files.where("mismatch > 0").groupBy(F.col("file_year").alias("year"), F.col("file_month").alias("month"))
    by_month_rows = months.agg(F.sum("mismatch").alias("mismatch_rows"), F.count("*").alias("affected_groups")).orderBy("year", "month").collect()
    per_file = [r.asDict() for r in files.orderBy("file").collect()]  # as many as ``paths``, which the driver holds anyway
    met = {r["file"].split("://")[-1].split(":")[-1].lstrip("/") for r in per_file}
    errors |= {p: "no row could be read" for p in paths if p not in errors and p.split("://")[-1].lstrip("/") not in met}
    t = phase("processing", t)
    counts = pivots.agg(F.count("*").alias("n"), F.count_if(total_of([f"hour_{h}" for h in range(24)]) < min_rides).alias("low")).first()
    write_wide(combine(low_count_cleanup(pivots, min_rides), KEYS), output, by_month)
    wide = spark.read.parquet(output)
    breakdown = row_breakdown(wide).orderBy("year", "taxi_type").collect()
    phase("combine", t)
    report = {
        "summary": {
            "files": len(paths), "errors": len(errors), "input_rows": totals["input_rows"] or 0, "rows_after_filters": totals["after_filters"] or 0, "intermediate_rows": counts["n"] - counts["low"],
            "output_columns": wide.columns, "final_rows": sum(r["row_count"] for r in breakdown), "min_rides": min_rides, "wall_seconds": round(time.time() - began, 2), "peak_memory_mb": round(peak_memory_mb(), 1),
        },
        "discards": {"parse_fail": totals["parse_fail"] or 0, "mismatch": totals["mismatch"] or 0, "low_count": counts["low"], "pivot_rows": counts["n"]},
        "by_month": [r.asDict() for r in by_month_rows], "by_year_type": [r.asDict() for r in breakdown], "per_file": per_file, "errors": errors, "phases": phases,
    }
    files.unpersist()
    if not keep_intermediate:
        delete(spark, middle)
    if report_file:
        write_text(spark, report_file, report_for(report_file, report))
        write_text(spark, report_file.rsplit(".", 1)[0] + "_performance.md", performance_markdown(report))
    return report


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Hourly pivot of trip files into one wide table")
    p.add_argument("--input-dir", required=True)
    p.add_argument("--output-dir", required=True)
    p.add_argument("--s3-output", help="where the wide table goes instead of below the output folder")
    p.add_argument("--min-rides", type=int, default=50)
    p.add_argument("--workers", type=int, help="cores of a local session")
    p.add_argument("--partition-size", help="bytes of a scan task, as 200MB")
    p.add_argument("--skip-partition-optimization", action="store_true", help="kept for callers; Spark sizes its tasks")
    p.add_argument("--keep-intermediate", action="store_true")
    p.add_argument("--intermediate-dir")
    p.add_argument("--report-file", default="report.json")
    p.add_argument("--max-files", type=int)
    p.add_argument("--by-month", action="store_true", help="partition the wide table by year and month")
    p.add_argument("--intermediate-by-month", action="store_true", help="partition the intermediate table by year and month")
    p.add_argument("--anon-s3", action="store_true", help="read s3 paths without credentials")
    a = p.parse_args(args)
    conf = (scan_conf(a.partition_size) if a.partition_size else {}) | (anonymous_conf(a.input_dir) if a.anon_s3 else {})
    spark = build_session("pivot", f"local[{a.workers}]" if a.workers else None, conf)
    out = a.s3_output or f"{a.output_dir.rstrip('/')}/final_wide_table.parquet"
    report = a.report_file if "/" in a.report_file else f"{a.output_dir.rstrip('/')}/{a.report_file}"
    run(spark, a.input_dir, out, a.min_rides, a.max_files, report, a.keep_intermediate, a.intermediate_dir, a.by_month, a.intermediate_by_month)


if __name__ == "__main__":
    main()
