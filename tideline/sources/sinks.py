"""Wide tables, score tables and run reports."""

from __future__ import annotations

import json
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.paths import hadoop_path
from tideline.functions.sizes import percent
from tideline.sources.discovery import filesystem


def write_wide(df: DataFrame, path: str, by_month: bool = False, date: str = "date") -> None:
    """Parquet; ``by_month``: below year=/month= folders."""
    if by_month:
        df.withColumns({"year": F.year(date), "month": F.month(date)}).write.mode("overwrite").partitionBy("year", "month").parquet(hadoop_path(path))
    else:
        df.write.mode("overwrite").parquet(hadoop_path(path))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(hadoop_path(path), header=True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text, to any place that Spark writes to."""
    fs, p = filesystem(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small text, from any place that Spark reads."""
    return spark.read.text(hadoop_path(path), wholetext=True).first()[0]


def report_json(report: dict) -> str:
    return json.dumps(report, indent=2, default=str)


def report_tex(report: dict) -> str:
    s = report.get("summary", {})
    items = "\n".join(f"  \\item {k.replace('_', ' ')}: {v}" for k, v in s.items())
    return "\\documentclass{article}\n\\begin{document}\n\\section*{Pivot report}\n\\begin{itemize}\n" + items + "\n\\end{itemize}\n\\end{document}\n"


def report_for(path: str, report: dict) -> str:
    """JSON for names that end so, else TeX."""
    return report_json(report) if path.endswith(".json") else report_tex(report)


def _table(head: list[str], rows: list[list[object]]) -> str:
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(map(str, r)) + " |" for r in rows)])


def performance_markdown(report: dict) -> str:
    s, d = report.get("summary", {}), report.get("discards", {})
    text = ["# Performance", "", f"- Wall time: {s.get('wall_seconds', 'N/A')} s", f"- Peak driver memory: {s.get('peak_memory_mb', 'N/A')} MB", ""]
    text += ["## Rows", "", *(f"- {k.replace('_', ' ')}: {s.get(k, 'N/A')}" for k in ("input_rows", "rows_after_filters", "intermediate_rows", "final_rows")), ""]
    whole, pivots = s.get("input_rows", 0), d.get("pivot_rows", 0)
    text += ["## Discards", "", f"- unreadable datetimes: {d.get('parse_fail', 0)} ({percent(d.get('parse_fail', 0), whole)} of trips)", f"- month mismatches: {d.get('mismatch', 0)} ({percent(d.get('mismatch', 0), whole)} of trips)", f"- low counts: {d.get('low_count', 0)} ({percent(d.get('low_count', 0), pivots)} of pivot rows)", ""]
    text += ["## Month mismatches", "", _table(["year", "month", "rows", "files"], [[m["year"], m["month"], m["mismatch_rows"], m["affected_groups"]] for m in report.get("by_month", [])]), ""]
    text += ["## Wide rows by year and type", "", _table(["year", "type", "rows"], [[r["year"], r["taxi_type"], r["row_count"]] for r in report.get("by_year_type", [])]), ""]
    columns = s.get("output_columns", [])
    text += ["## Schema summary", "", f"- Output columns: {len(columns)}", "", "```", ", ".join(columns) or "(none)", "```", ""]
    return "\n".join(text) + "\n"


def summarize_report(report: dict) -> str:
    """A report as a short markdown text; N/A for what it lacks."""
    s = report.get("summary", report)
    lines = ["# Report summary", "", *(f"- {k.replace('_', ' ')}: {s.get(k, 'N/A')}" for k in ("wall_seconds", "peak_memory_mb", "files", "errors", "input_rows", "rows_after_filters", "intermediate_rows", "final_rows"))]
    phases = report.get("phases", {})
    lines += ["", "## Phases", "", *(f"- {k}: {v} s" for k, v in phases.items())] if phases else ["", "## Phases", "", "N/A"]
    return "\n".join(lines) + "\n"


def summarize_file(spark: SparkSession, source: str, target: str) -> None:
    write_text(spark, target, summarize_report(json.loads(read_text(spark, source))))
