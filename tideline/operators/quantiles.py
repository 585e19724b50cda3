"""Exact quantiles of large columns, by counting in bins and narrowing them.

Spark's exact percentile keeps a map of all distinct values in each buffer;
here a pass keeps only the counts of BINS ranges, whatever the table's size.
Callers that ask for several quantiles of one table should persist it.
"""

from __future__ import annotations

import sys
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.lineage import cut

BINS, FEW = 4096, 20_000
#: Targets (groups x columns x quantiles) whose intervals may be broadcast, some 100 bytes each; Spark chooses beyond that.
MOST_TARGETS = 50_000


def exact_quantile(df: DataFrame, column: str, q: float, ends: tuple[float, float] | None = None) -> float | None:
    """Linear interpolation between the two nearest values, as ``percentile`` does; None without values. NaN counts as null.

    ``ends``: values that none lies beyond, if they are known. Both neighbours
    of the quantile are looked for together: in each pass either one bin holds
    both, or one is the largest of its bin and the other the least of the next.
    """
    v = F.col("v")
    rows = df.select(F.col(column).cast("double").alias("v")).where(v.isNotNull() & ~F.isnan("v"))
    low, high = ends or rows.agg(F.min("v"), F.max("v")).first()
    below, place = 0, None
    while low is not None:
        width = (high - low) / BINS
        here = rows.where((v >= low) & (v <= high))
        bin_ = F.least(F.floor((v - low) / width), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        bins = here.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("bin").collect()
        if place is None:
            n = sum(r["n"] for r in bins)
            if not n:
                return None
            place = q * (n - 1)
        found = _around([(r["n"], r["a"], r["b"]) for r in bins], place, below)
        if isinstance(found, float):
            return found
        inside, a, b, below = found
        if inside <= FEW or (a, b) == (low, high):
            values = rows.where((v >= a) & (v <= b)).groupBy("v").agg(F.count("*").alias("n")).orderBy("v").collect()
            return _around([(r["n"], r["v"], r["v"]) for r in values], place, below)
        low, high = a, b
    return None


def _around(bins: list[tuple[int, float, float]], place: float, below: int) -> float | tuple[int, float, float, int]:
    """The value at ``place`` if the bins (count, least, largest) tell it; else the bin that holds both of its neighbours, and how many values are below that."""
    k, part = int(place), place - int(place)
    for i, (n, a, b) in enumerate(bins):
        if below + n > k:
            last = below + n == k + 1
            if a == b and not (part and last):
                return float(a)
            if last and part:
                return b + (bins[i + 1][1] - b) * part
            return float(b) if last else (n, a, b, below)
        below += n
    raise ValueError("the place lies beyond the values")


def grouped_quantiles(df: DataFrame, by: list[str], columns: list[str], quantiles: list[float]) -> DataFrame:
    """``by``, column, n, quantiles (array in the order asked for): exact quantiles of every group and column, all found together.

    Each pass counts the values of all groups and columns in ``BINS`` ranges of the interval that still holds a
    target, and a target goes on with the bin that holds it, until the bins' ends tell its value; so a pass needs
    memory for bins only, however many values a group has. Null and NaN are left out, a group without a value of a
    column has no row for it, null groups are one group, infinite values count as the largest doubles.
    """
    rows = df.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns))).alias("s")).select(*by, "s.column", "s.v")
    largest = F.lit(sys.float_info.max)
    rows = rows.where(F.col("v").isNotNull() & ~F.isnan("v")).withColumn("v", F.greatest(F.least("v", largest), -largest))
    keys = [*by, "column"]
    ends = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    targets = F.posexplode(F.array(*(F.lit(float(q)) for q in quantiles))).alias("t", "q")
    state = ends.select(*keys, "n", "low", "high", F.lit(0).cast("long").alias("below"), targets).withColumn("place", F.col("q") * (F.col("n") - 1)).drop("q")
    state = cut(state.withColumn("value", F.when(F.col("low") == F.col("high"), F.col("low"))))
    while (left := state.where("value is null").count()):
        state = cut(_narrowed(rows, state, keys, left))
    values = F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda s: s["value"])
    return state.groupBy(*keys).agg(F.first("n").alias("n"), values.alias("quantiles"))


def _narrowed(rows: DataFrame, state: DataFrame, keys: list[str], left: int) -> DataFrame:
    """The state after one more pass over the rows; ``left``: targets without a value."""
    open_ = state.where("value is null")
    intervals = open_.select(*keys, "low", "high").distinct()
    if left <= MOST_TARGETS:
        intervals = F.broadcast(intervals)
    r, i = rows.alias("r"), intervals.alias("i")
    inside = (F.col("r.v") >= F.col("i.low")) & (F.col("r.v") <= F.col("i.high"))
    on = reduce(and_, (F.col(f"r.{k}").eqNullSafe(F.col(f"i.{k}")) for k in keys))
    span = F.col("i.high") / 2 - F.col("i.low") / 2  # halves, as the width of an interval may exceed the largest double
    part = (F.col("r.v") / 2 - F.col("i.low") / 2) / F.when(span > 0, span)
    bin_ = F.coalesce(F.least(F.floor(part * BINS), F.lit(BINS - 1)), F.when(F.col("r.v") > F.col("i.low"), BINS - 1).otherwise(0))
    found = r.join(i, on & inside).select(*(F.col(f"r.{k}") for k in keys), "i.low", "i.high", bin_.alias("bin"), "r.v")
    bins = found.groupBy(*keys, "low", "high", "bin").agg(F.count("*").alias("k"), F.min("v").alias("a"), F.max("v").alias("b"))
    w = Window.partitionBy(*keys, "low", "high").orderBy("bin")  # BINS rows at most
    bins = bins.withColumns({"upto": F.sum("k").over(w), "next": F.lead("a").over(w)})
    o, b = open_.alias("o"), bins.alias("b")
    place, part = F.floor("o.place"), F.col("o.place") - F.floor("o.place")
    upto, before = F.col("o.below") + F.col("b.upto"), F.col("o.below") + F.col("b.upto") - F.col("b.k")
    on = reduce(and_, (F.col(f"o.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "low", "high"]))
    last = upto == place + 1
    value = (
        F.when((F.col("b.a") == F.col("b.b")) & ~((part > 0) & last), F.col("b.a"))
        .when(last & (part > 0), F.col("b.b") + (F.col("b.next") - F.col("b.b")) * part)
        .when(last, F.col("b.b"))
        .when((part == 0) & (before == place), F.col("b.a"))
    )
    moved = o.join(b, on & (before <= place) & (place < upto)).select(*(F.col(f"o.{k}") for k in keys), "o.n", F.col("b.a").alias("low"), F.col("b.b").alias("high"), before.alias("below"), "o.t", "o.place", value.alias("value"))
    return state.where("value is not null").select(moved.columns).unionByName(moved)
