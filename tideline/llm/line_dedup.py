"""Line dedup by site-relative frequency, in DataFrame functions only.

A line is boilerplate of its host if the pages that contain it make up more
than ``ratio`` of the host's pages. A page is a row. A line of a single page
repeats nothing, so ``least_pages`` (2) is the least that counts; else a host
of few pages would lose all of its lines. With ``copies_once``, pages of one
host with the same text count as one page, for corpora whose copies are removed
later: a copy tells nothing about the site's template.

Only (host, line) hashes are shuffled, added up before the shuffle; a line
counts once a page, by a distinct within the row. A host has fewer than (lines
per page) / ratio boilerplate lines, so they fit into one array per host. Texts
meet those arrays in a join whose small side is a written table: Spark
broadcasts it below its size threshold and else shuffles, splitting the rows of
hot hosts. Lines are then dropped within the row.

Lines are compared without blanks at their ends. Blank lines always stay. Null
texts stay null (and are pages without lines); rows without a host are kept as they are. A text all of whose
lines go becomes empty; no row goes. Repeated rows are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import scratch

#: A line on more than this share of a host's pages is boilerplate, if it is on so many pages.
RATIO, LEAST_PAGES = 0.1, 2


def _line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, copies_once: bool = False) -> DataFrame:
    """(host, lines): hashes of each host's boilerplate lines; hosts without any have no row."""
    pages = docs.select(F.col(host).alias("host"), F.xxhash64(F.col(text)).alias("page"), F.col(text).alias("text")).where("host is not null")
    keys = F.array_distinct(F.transform(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != ""), _line_key))
    lines = pages.select("host", "page", F.explode(keys).alias("line"))
    if copies_once:
        pages, lines = pages.select("host", "page").distinct(), lines.distinct()
    totals = pages.groupBy("host").agg(F.count("*").alias("n_pages"))
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    frequent = counts.join(totals, "host").where(F.col("n") > F.col("n_pages") * ratio)
    return frequent.groupBy("host").agg(F.collect_list("line").alias("lines"))


def line_dedup(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, copies_once: bool = False) -> DataFrame:
    """One row per document: ``row`` (struct of all its columns), n_lines, n_dropped, and ``kept``, the text without boilerplate lines."""
    found = scratch.table(boilerplate(docs, host, text, ratio, least_pages, copies_once), "boilerplate")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    source = docs.select(row.alias("row"), F.col(host).alias("__host"))
    joined = source.join(found.select(F.col("host").alias("__host"), F.col("lines").alias("__lines")), "__host", "left")
    whole = F.col("row").getField(text)
    parts = F.split(whole, "\n", -1)
    kept = F.filter(parts, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("__lines"), _line_key(x)))
    kept = F.when(F.col("__lines").isNotNull(), kept)
    out = joined.select("row", F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"), kept.alias("__kept"))
    out = out.withColumn("n_lines", F.when(F.col("row").getField(text).isNull(), 0).otherwise(F.col("n_lines")).cast("long"))
    dropped = F.when(F.col("__kept").isNotNull(), F.col("n_lines") - F.size("__kept")).otherwise(0).cast("long")
    return out.select("row", "n_lines", dropped.alias("n_dropped"), F.coalesce(F.array_join("__kept", "\n"), whole).alias("kept"))
