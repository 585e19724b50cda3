"""What distributions look like, per group: density curves, boxes with whiskers and outliers, tests of spread, normal scores, distances from the mean.

Null and NaN values are left out everywhere; null groups are one group. Groups
are as many as the caller's table has; nothing here holds a group's values.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.special import chi2_sf, f_sf, normal_quantile
from tideline.models.distributions import chi2_quantile
from tideline.operators.quantiles import grouped_quantiles

#: Ranges of values that are ranked by themselves, and the accuracy of their edges.
RANGES, ACCURACY = 1024, 10_000
#: Ranks that one row of equal values is spread into at a time.
SPREAD = 10_000


def _values(df: DataFrame, by: list[str], value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return df.select(*by, v.alias("v")).where(v.isNotNull() & ~F.isnan(v))


def _on(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Inner join of a table with one of a row a group, null groups included; all columns of the first, those of the second that aren't keys."""
    if not by:
        return left.join(F.broadcast(right))  # one row
    l, r = left.alias("l"), right.alias("r")
    on = F.lit(True)
    for k in by:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return l.join(r, on).select("l.*", *(F.col(f"r.{c}") for c in right.columns if c not in by))


def density(df: DataFrame, by: list[str], value: str, points: int = 200, bins: int = 1024, cut: float = 0.0) -> DataFrame:
    """``by``, point (0 ..), x, density: a Gaussian kernel estimate with Scott's bandwidth, std (n - 1) times n^(-1/5), on ``points`` places.

    The curve goes from ``cut`` bandwidths below the group's least value to as many above its largest. Values are counted
    on a grid of ``bins`` places from the least to the largest, each by its distance from the two beside it, and the counts
    are what the kernel is laid over: a pass over the rows sends ``bins`` counts a group. Groups without spread have no curve.
    """
    rows = _values(df, by, value)
    ends = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.stddev_samp("v").alias("s")).where("s > 0")
    ends = ends.withColumn("h", F.col("s") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    place = (F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * (bins - 1)
    left = F.least(F.floor(place), F.lit(bins - 2))
    part = place - left
    halves = F.explode(F.array(F.struct(left.alias("bin"), (1 - part).alias("w")), F.struct((left + 1).alias("bin"), part.alias("w")))).alias("s")
    counted = _on(rows, ends.select(*by, "low", "high"), by).select(*by, halves).groupBy(*by, "s.bin").agg(F.sum("s.w").alias("w"))
    grid = counted.groupBy(*by).agg(F.collect_list(F.struct("bin", "w")).alias("grid"))  # ``bins`` at most
    curves = _on(grid, ends, by).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    first, last = F.col("low") - cut * F.col("h"), F.col("high") + cut * F.col("h")
    x = first + (last - first) * F.col("point") / (points - 1)
    step = (F.col("high") - F.col("low")) / (bins - 1)

    def kernel(total: Column, s: Column) -> Column:
        u = (F.col("x") - F.col("low") - s["bin"] * F.col("step")) / F.col("h")
        return total + s["w"] * F.exp(-u * u / 2)

    total = F.aggregate("grid", F.lit(0.0), kernel)
    return curves.withColumns({"x": x, "step": step}).select(*by, "point", "x", (total / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))


def box_whiskers(df: DataFrame, by: list[str], value: str, reach: float = 1.5) -> DataFrame:
    """``by``, n, q1, median, q3, low, high (the last values within ``reach`` box lengths of the box), below, above (outliers on either side)."""
    boxed = _boxed(df, by, value, reach)
    inside = F.col("v").between(F.col("low_fence"), F.col("high_fence"))
    return boxed.groupBy(*by).agg(
        F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("q1", "median", "q3")), F.min(F.when(inside, F.col("v"))).alias("low"), F.max(F.when(inside, F.col("v"))).alias("high"),
        F.count_if(F.col("v") < F.col("low_fence")).alias("below"), F.count_if(F.col("v") > F.col("high_fence")).alias("above"),
    )


def box_outliers(df: DataFrame, by: list[str], value: str, reach: float = 1.5) -> DataFrame:
    """The rows of ``df`` whose value lies beyond the whiskers, with ``fence``: the fence that they are beyond."""
    boxes = _boxes(df, by, value, reach)
    v = F.col(value).cast("double")
    out = _on(df, boxes.select(*by, F.col("low_fence").alias("__low"), F.col("high_fence").alias("__high")), by)
    fence = F.when(v < F.col("__low"), F.col("__low")).when(~F.isnan(v) & (v > F.col("__high")), F.col("__high"))
    return out.withColumn("fence", fence).where("fence is not null").drop("__low", "__high")


def _boxes(df: DataFrame, by: list[str], value: str, reach: float) -> DataFrame:
    q = F.col("quantiles")
    found = grouped_quantiles(df, by, [value], [0.25, 0.5, 0.75]).select(*by, q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"))
    length = F.col("q3") - F.col("q1")
    return found.withColumns({"low_fence": F.col("q1") - reach * length, "high_fence": F.col("q3") + reach * length})


def _boxed(df: DataFrame, by: list[str], value: str, reach: float) -> DataFrame:
    return _on(_values(df, by, value), _boxes(df, by, value, reach), by)


def spread_tests(df: DataFrame, by: str, value: str) -> DataFrame:
    """test (bartlett, levene), statistic, p, reject (p < 0.05), groups, n: whether the groups' variances are equal.

    Levene's is about the medians. Groups of fewer than two values are left out; with fewer than two groups, or
    where a group (Bartlett) or all (Levene) have no spread, the statistic is null.
    """
    rows = _values(df, [by], value)
    medians = grouped_quantiles(df, [by], [value], [0.5]).where("n > 1").select(by, F.col("quantiles")[0].alias("median"))
    away = F.abs(F.col("v") - F.col("median"))
    groups = _on(rows, medians, [by]).groupBy(by).agg(F.count("*").alias("n"), F.var_samp("v").alias("s2"), F.avg(away).alias("z"), F.var_pop(away).alias("z2"))
    n, k = F.sum("n"), F.count("*")
    one = groups.agg(
        n.alias("n"), k.alias("k"), F.min("s2").alias("least"),
        F.sum((F.col("n") - 1) * F.col("s2")).alias("within"), F.sum((F.col("n") - 1) * F.when(F.col("s2") > 0, F.log("s2"))).alias("logs"), F.sum(1 / (F.col("n") - 1)).alias("inverse"),
        F.sum(F.col("n") * F.col("z2")).alias("within_z"), F.sum(F.col("n") * F.col("z")).alias("sum_z"), F.sum(F.col("n") * F.col("z") * F.col("z")).alias("square_z"),
    ).where("n > 0")
    free, degrees = F.when(F.col("n") > F.col("k"), F.col("n") - F.col("k")), F.when(F.col("k") > 1, F.col("k") - 1)
    bartlett = (free * F.log(F.col("within") / free) - F.col("logs")) / (1 + (F.col("inverse") - 1 / free) / (3 * degrees))
    between = F.col("square_z") - F.col("sum_z") * F.col("sum_z") / F.col("n")
    levene = free / degrees * between / F.when(F.col("within_z") > 0, F.col("within_z"))
    named = one.select("n", "k", F.when(F.col("least") > 0, bartlett).alias("b"), levene.alias("l"), degrees.alias("degrees"), free.alias("free"))
    tests = F.array(F.struct(F.lit("bartlett").alias("test"), F.col("b").alias("statistic"), chi2_sf(F.col("b"), F.col("degrees")).alias("p")), F.struct(F.lit("levene").alias("test"), F.col("l").alias("statistic"), f_sf(F.col("l"), F.col("degrees"), F.col("free")).alias("p")))
    return named.select(F.explode(tests).alias("t"), "k", "n").select("t.*", (F.col("t.p") < 0.05).alias("reject"), F.col("k").alias("groups"), "n")


def _edges(df: DataFrame, value: str, ranges: int) -> list[float]:
    """Values that cut a column into about equal ranges; from a quantile sketch, as any edges give the same ranks."""
    found = df.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], ACCURACY).alias("e")).first()["e"] or []
    return [-math.inf, *sorted(set(found)), math.inf]


def _in_range(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Add ``range``: of the edges, that which the value is in."""
    if len(edges) < 3:
        return df.withColumn("range", F.lit(0.0))
    return Bucketizer(inputCol=value, outputCol="range", splits=edges).transform(df)


def ranked_values(df: DataFrame, by: list[str], value: str, ranges: int = RANGES) -> DataFrame:
    """``by``, v, k, before, n: each distinct value, its rows, the group's rows below it, and all of the group.

    Equal values are counted first, and values are added up within ranges, on top of the ranges below.
    """
    rows = _values(df, by, value)
    counted = _in_range(rows.groupBy(*by, "v").agg(F.count("*").alias("k")), "v", _edges(rows, "v", ranges))
    w = Window.partitionBy(*by)
    sizes = counted.groupBy(*by, "range").agg(F.sum("k").alias("k"))  # ``ranges`` a group
    base = F.coalesce(F.sum("k").over(w.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*by, "range", base.alias("base"), F.sum("k").over(w).alias("n"))
    within = F.coalesce(F.sum("k").over(Window.partitionBy(*by, "range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = _on(counted.withColumn("within", within), sizes, [*by, "range"])
    return ranked.select(*by, "v", "k", (F.col("base") + F.col("within")).alias("before"), "n")


def normal_scores(df: DataFrame, by: list[str], value: str, positions: str = "filliben", ranges: int = RANGES) -> DataFrame:
    """``by``, rank, x, score, n: the values in order and the normal quantiles that they stand against in a Q-Q plot.

    ``positions``: ``filliben`` (the plot's) or ``blom``, (rank - 3/8) / (n + 1/4), which the Shapiro-Francia test takes.
    """
    ranked = ranked_values(df, by, value, ranges)
    last = F.col("before") + F.col("k")
    # many equal values are cut up and dealt out before they become rows
    cuts = ranked.select(*by, "v", "n", last.alias("last"), F.explode(F.sequence(F.col("before") + 1, last, F.lit(SPREAD))).alias("first"))
    ends = F.least(F.col("first") + SPREAD - 1, F.col("last"))
    rows = cuts.select(*by, "v", F.col("n").cast("double").alias("m"), F.explode(F.sequence("first", ends)).alias("rank"))
    r, m = F.col("rank").cast("double"), F.col("m")
    if positions == "blom":
        p = (r - 0.375) / (m + 0.25)
    else:
        end = F.pow(F.lit(0.5), 1 / m)
        p = F.when(m == 1, F.lit(0.5)).when(r == 1, 1 - end).when(r == m, end).otherwise((r - 0.3175) / (m + 0.365))
    return rows.select(*by, "rank", F.col("v").alias("x"), normal_quantile(p).alias("score"), F.col("m").cast("long").alias("n"))


def normality(df: DataFrame, by: list[str], value: str, ranges: int = RANGES) -> DataFrame:
    """``by``, n, slope, intercept, r of the Q-Q plot's line, w, p: Shapiro and Francia's W' and Royston's p of it (5 values and more)."""
    line = normal_scores(df, by, value, "filliben", ranges).groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope("x", "score").alias("slope"), F.regr_intercept("x", "score").alias("intercept"), F.corr("x", "score").alias("r"))
    blom = normal_scores(df, by, value, "blom", ranges).groupBy(*by).agg(F.pow(F.corr("x", "score"), 2).alias("w"))
    out = _on(line, blom, by)
    u = F.log("n")
    #: Royston's approximation of 1993 for W'.
    mean = -1.2725 + 1.0521 * (F.log(u) - u)
    deviation = 1.0308 - 0.26758 * (F.log(u) + 2 / u)
    z = (F.log(1 - F.col("w")) - mean) / deviation
    return out.withColumn("p", F.when((F.col("n") >= 5) & (F.col("w") < 1), normal_sf(z)))


def normal_sf(z: Column) -> Column:
    """P(Z >= z), by the chi-squared distribution of one degree of freedom."""
    half = chi2_sf(z * z, F.lit(1.0)) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def mahalanobis(df: DataFrame, columns: list[str], shrinkage: float = 0.1, levels: tuple[float, ...] = (0.95, 0.99, 0.999), ranges: int = RANGES) -> DataFrame:
    """The rows that have all ``columns``, with d2, outlier_95, outlier_99, outlier_999 (d2 beyond the chi-squared quantile) and rank (1 is farthest, equal ones alike).

    The covariance is blended with its mean variance times the identity, as ``shrinkage`` says. Means and covariances are
    one aggregate, the distance is an expression of a row's cells, and ranks are ranks within ranges of the distance.
    """
    x = [F.col(f"`{c}`").cast("double") for c in columns]
    whole = df
    for v in x:
        whole = whole.where(v.isNotNull() & ~F.isnan(v))
    p = len(columns)
    sums = whole.agg(F.count("*").alias("n"), *(F.avg(v).alias(f"m{i}") for i, v in enumerate(x)), *(F.covar_samp(x[i], x[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p))).first()
    if sums["n"] < 2:
        return whole.limit(0).withColumns({"d2": F.lit(0.0), **{_flag(v): F.lit(False) for v in levels}, "rank": F.lit(1).cast("long")})
    cov = np.array([[sums[f"c{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
    inverse = np.linalg.pinv((1 - shrinkage) * cov + shrinkage * np.trace(cov) / p * np.eye(p))
    away = [v - F.lit(sums[f"m{i}"]) for i, v in enumerate(x)]
    d2 = F.lit(0.0)
    for i in range(p):
        for j in range(i, p):
            d2 = d2 + away[i] * away[j] * F.lit(float(inverse[i, j] * (1 if i == j else 2)))
    rows = whole.withColumn("d2", d2)
    rows = _in_range(rows, "d2", _edges(rows, "d2", ranges))
    w = Window.orderBy(F.desc("range"))  # ``ranges`` rows
    sizes = rows.groupBy("range").agg(F.count("*").alias("__k"))
    sizes = sizes.select("range", F.coalesce(F.sum("__k").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    rank = F.rank().over(Window.partitionBy("range").orderBy(F.desc("d2"))) + F.col("__base")
    flags = {_flag(v): F.col("d2") > chi2_quantile(v, p) for v in levels}
    return rows.join(F.broadcast(sizes), "range").withColumns({**flags, "rank": rank.cast("long")}).drop("range", "__base")  # ``ranges`` rows


def _flag(level: float) -> str:
    return "outlier_" + f"{level:g}"[2:]
