"""Statistics of groups and columns, metrics of predictions, curves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.quantiles import grouped_quantiles


def group_stats(df: DataFrame, by: str, value: str, digits: int = 2) -> DataFrame:
    """n, mean, median, std (n - 1), p25, p75 per group."""
    q = grouped_quantiles(df, [by], [value], [0.25, 0.5, 0.75]).select(F.col(by).alias("__by"), F.col("quantiles").alias("p"))
    out = df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")).join(q, F.col(by).eqNullSafe(F.col("__by")), "left")
    r = lambda c: F.round(c, digits)
    return out.select(by, "n", r(F.col("mean")).alias("mean"), r(F.col("p")[1]).alias("median"), r(F.col("std")).alias("std"), r(F.col("p")[0]).alias("p25"), r(F.col("p")[2]).alias("p75"))


def mean_grid(df: DataFrame, by: str, column: Column, value: str, values: list[int], prefix: str) -> DataFrame:
    """Mean per group and column value, as one column each; missing cells stay null."""
    return df.groupBy(by).agg(*(F.avg(F.when(column == v, F.col(value))).alias(f"{prefix}{v}") for v in values))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """col_a, col_b, corr over all ordered pairs, from one aggregate of the upper triangle."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    cell = lambda a, b: F.lit(1.0) if a == b else F.col(f"`{a}|{b}`" if (a, b) in pairs else f"`{b}|{a}`")
    cells = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), cell(a, b).alias("corr")) for a in columns for b in columns]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def log_trend(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """slope, intercept, r2 of log1p(y) on log1p(x) per group."""
    rows = df.select(by, F.log1p(x).alias("x"), F.log1p(y).alias("y"))
    return rows.groupBy(by).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bin (0 ..), n over [min, max]; the last bin is closed, empty bins have no row."""
    ends = df.agg(F.min(value).alias("a"), F.max(value).alias("b"))
    place = F.when(F.col("b") > F.col("a"), F.least(F.floor((F.col(value) - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1))).otherwise(0)
    rows = df.select(value).where(F.col(value).isNotNull()).join(F.broadcast(ends))  # one row
    return rows.groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def describe(df: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    """column, count, mean, std, min, p25, p50, p75, max, one row per column; one pass for the moments, the quantiles of all columns together."""
    aggs = [F.struct(F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")).alias(c) for c in columns]
    row = df.agg(*aggs)
    r = lambda x: F.round(x.cast("double"), digits)
    s = row.select(F.explode(F.array(*(F.col(f"`{c}`") for c in columns))).alias("s")).select("s.*")
    s = s.join(grouped_quantiles(df, [], columns, [0.25, 0.5, 0.75]).select("column", F.col("quantiles").alias("p")), "column", "left")  # a row a column
    return s.select("column", "count", r(F.col("mean")).alias("mean"), r(F.col("std")).alias("std"), r(F.col("min")).alias("min"), *(r(F.col("p")[i]).alias(n) for i, n in enumerate(("p25", "p50", "p75"))), r(F.col("max")).alias("max"))


def standardized(df: DataFrame, column: str, population: bool = False) -> Column:
    """z of a column; sample deviation unless ``population``."""
    s = df.agg(F.avg(column).alias("m"), (F.stddev_pop if population else F.stddev_samp)(column).alias("s")).first()
    return (F.col(column) - F.lit(s["m"])) / F.lit(s["s"] or None)


def box_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quartiles and ends of standardised columns, as a box plot draws them."""
    return describe(df.select(*(standardized(df, c).alias(c) for c in columns)), columns, 6)


def survival(df: DataFrame, value: str, tie: list[str], ranges: int = 256) -> DataFrame:
    """rank, x, survival = rank / n of non-zero absolute values, largest first; ties by ``tie``.

    Ranks are counted within equal ranges of the value, on top of the larger
    ranges' counts, so no task sorts all rows.
    """
    rows = df.select(F.abs(F.col(value).cast("double")).alias("x"), *tie).where("x > 0")
    ends = rows.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    part = F.when(F.col("b") > F.col("a"), F.least(F.floor((F.col("x") - F.col("a")) / (F.col("b") - F.col("a")) * ranges), F.lit(ranges - 1))).otherwise(0).cast("int")
    rows = rows.join(F.broadcast(ends)).withColumn("part", part).drop("a", "b")  # one row
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("part"))  # one row per range
    counts = counts.select("part", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("x"), *tie)) + F.col("before")
    return rows.join(F.broadcast(counts), "part").select(rank.cast("long").alias("rank"), "x", (rank / F.col("n")).alias("survival"))  # ranges rows at most


def tail_fit(curve: DataFrame) -> DataFrame:
    """alpha, r2, classification, tail_points of the largest max(10, ceil(5 %)) points: log10 survival on log10 x."""
    n = curve.agg(F.count("*").alias("n"))
    tail = curve.join(F.broadcast(n)).where(F.col("rank") <= F.greatest(F.lit(10), F.ceil(0.05 * F.col("n"))))  # one row
    x, y = F.log10("x"), F.log10("survival")
    fit = tail.agg((-F.regr_slope(y, x)).alias("alpha"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("tail_points"))
    kind = F.when(F.col("tail_points") < 5, "insufficient_data").when((F.col("r2") > 0.85) & (F.col("alpha") > 0) & (F.col("alpha") < 5), "heavy_tail").otherwise("light_tail")
    return fit.select("alpha", "r2", kind.alias("classification"), "tail_points")


def cumulative_ratio(df: DataFrame, weight: str, tie: str) -> DataFrame:
    """rank, ratio, cum_ratio of a small table of weights, largest first."""
    w = Window.orderBy(F.desc(weight), tie)
    total = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.select(F.row_number().over(w).cast("long").alias("rank"), (F.col(weight) / total).alias("ratio"), (F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)) / total).alias("cum_ratio"))


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count("*").alias("n"))


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """class, precision, recall, f1, support per class, then 'macro avg', 'weighted avg' and 'accuracy' (its value in every column)."""
    cells = confusion(df, label, prediction)
    truth = cells.groupBy(F.col(label).cast("string").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(0)).alias("hit"))
    guess = cells.groupBy(F.col(prediction).cast("string").alias("class")).agg(F.sum("n").alias("guessed"))
    rows = truth.join(guess, "class", "full").fillna(0, ["support", "hit", "guessed"])
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rows = rows.select("class", share(F.col("hit"), F.col("guessed")).alias("precision"), share(F.col("hit"), F.col("support")).alias("recall"), "support", "hit")
    f1 = share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    rows = rows.withColumn("f1", f1)
    names = ["precision", "recall", "f1"]
    macro = rows.agg(*(F.avg(c).alias(c) for c in names), F.sum("support").alias("support")).withColumn("class", F.lit("macro avg"))
    weighted = rows.agg(*((F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names), F.sum("support").alias("support")).withColumn("class", F.lit("weighted avg"))
    hit = F.sum("hit") / F.sum("support")
    accuracy = rows.agg(*(hit.alias(c) for c in names), F.sum("support").alias("support")).withColumn("class", F.lit("accuracy"))
    return reduce(DataFrame.unionByName, [x.select("class", *names, "support") for x in (rows, macro, weighted, accuracy)])


def label_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add the label's number in the order of all labels, from 0; null stays null."""
    labels = df.select(column).where(F.col(column).isNotNull()).distinct()
    numbered = labels.withColumn(out, (F.row_number().over(Window.orderBy(column)) - 1).cast("int"))  # one row per label
    return df.join(numbered, column, "left")


def groups_with_rows(df: DataFrame, by: str, groups: list[str], least: int) -> DataFrame:
    """(by, n): those of ``groups`` that have at least ``least`` rows."""
    return df.where(F.col(by).isin(groups)).groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def residuals(df: DataFrame, y: Column, guess: Column, *keys: str) -> DataFrame:
    """``keys``, y, guess and residual, as a residual plot draws them."""
    return df.select(*keys, y.alias("y"), guess.alias("guess"), (y - guess).alias("residual"))


def grouped_histogram(df: DataFrame, by: str, value: str, bins: int) -> DataFrame:
    """by, bin, n, share of the group over the whole table's range, as violins and overlaid histograms draw them."""
    ends = df.agg(F.min(value).alias("a"), F.max(value).alias("b"))
    place = F.when(F.col("b") > F.col("a"), F.least(F.floor((F.col(value) - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1))).otherwise(0)
    rows = df.select(by, value).where(F.col(value).isNotNull()).join(F.broadcast(ends))  # one row
    cells = rows.groupBy(by, place.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def regression_metrics(df: DataFrame, y: Column, guess: Column) -> DataFrame:
    """rmse, mae, r2 in one pass."""
    e = df.select(y.alias("y"), (y - guess).alias("e"))
    return e.agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae"), (1 - F.sum(F.col("e") * F.col("e")) / (F.var_pop("y") * F.count("y"))).alias("r2"))


def log_profile_r2(df: DataFrame, key: str, values: str) -> DataFrame:
    """r2 of log|v| on its index among the values above 1e-10, per row of an array column; 0 with fewer than 5."""
    rows = df.select(key, F.posexplode(F.transform(F.filter(values, lambda v: F.abs(v) > 1e-10), lambda v: F.log(F.abs(v.cast("double"))))).alias("i", "y"))
    fit = rows.groupBy(key).agg(F.regr_r2("y", "i").alias("r"), F.count("*").alias("n"))
    out = df.select(key).join(fit, key, "left")
    return out.select(key, F.when(F.coalesce("n", F.lit(0)) < 5, 0.0).otherwise(F.coalesce("r", F.lit(0.0))).alias("r2"))
