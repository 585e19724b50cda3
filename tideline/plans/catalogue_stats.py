"""Registered queries of distributions, tests, resamples, splines, replayed months and the leading components."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.special import ACKLAM, ACKLAM_EDGE
from tideline.functions.splines import spline_basis as basis
from tideline.models.distributions import chi2_quantile
from tideline.operators import distributions as dist
from tideline.models.power import leading_components
from tideline.models.trees import accuracy_bootstrap
from tideline.operators.lineage import cut, shared_folder
from tideline.operators.quantiles import grouped_quantiles
from tideline.operators.sampling import POISSON
from tideline.plans.fares import compare_services
from tideline.plans.catalogue import _RULE, _W, HOURS, _ruled, _wide, query, table
from tideline.sources.discovery import delete
from tideline.sources.months import read_months, with_path_month, write_months


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


_LEVELS = (0.01, 0.25, 0.5, 0.75, 0.99)
_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS \"column\", count({c}) AS n, " + ", ".join(f"round(quantile_cont({c}, {q}), 6) AS q{round(100 * q)}" for q in _LEVELS) + " FROM lineitem GROUP BY l_returnflag" for c in _MEASURES))
def quantiles_by_service(spark, sf_dir):
    """Exact quantiles of four measures of each service, found together."""
    found = grouped_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], _MEASURES, list(_LEVELS))
    return found.select("l_returnflag", "column", "n", *(F.round(F.col("quantiles")[i], 6).alias(f"q{round(100 * q)}") for i, q in enumerate(_LEVELS)))


@query("""WITH g AS (SELECT l_returnflag AS f, count(*) AS n, var_samp(l_extendedprice) AS s2, median(l_extendedprice) AS m FROM lineitem GROUP BY l_returnflag),
z AS (SELECT f, avg(abs(l_extendedprice - m)) AS z, var_pop(abs(l_extendedprice - m)) AS z2 FROM lineitem JOIN g ON f = l_returnflag GROUP BY f),
t AS (SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS k, sum((n - 1) * s2) AS within, sum((n - 1) * ln(s2)) AS logs, sum(1.0 / (n - 1)) AS inverse, sum(n * z2) AS within_z, sum(n * z) AS sum_z, sum(n * z * z) AS square_z FROM g JOIN z USING (f)),
s AS (SELECT n, k, ((n - k) * ln(within / (n - k)) - logs) / (1 + (inverse - 1 / (n - k)) / (3 * (k - 1))) AS b, (n - k) / (k - 1) * (square_z - sum_z * sum_z / n) / within_z AS l FROM t),
p AS (SELECT 'bartlett' AS test, b AS statistic, exp(-b / 2) AS p, n, k FROM s UNION ALL SELECT 'levene', l, pow(1 + 2 * l / (n - k), -(n - k) / 2), n, k FROM s)
SELECT test, round(statistic, 6) AS statistic, round(p, 6) AS p, p < 0.05 AS reject, CAST(k AS BIGINT) AS groups, CAST(n AS BIGINT) AS n FROM p""")
def spread_tests_by_service(spark, sf_dir):
    """Bartlett's and Levene's tests over the three services; with two degrees of freedom SQL has both distributions in closed form."""
    return _rounded(dist.spread_tests(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice"), 6, "statistic", "p")


_POINTS, _BINS = 200, 1024


@query(f"""WITH e AS (SELECT l_returnflag AS f, CAST(count(*) AS DOUBLE) AS n, min(l_extendedprice) AS a, max(l_extendedprice) AS b, stddev_samp(l_extendedprice) * pow(CAST(count(*) AS DOUBLE), -0.2) AS h FROM lineitem GROUP BY l_returnflag),
p AS (SELECT f, (l_extendedprice - a) / (b - a) * {_BINS - 1} AS place FROM lineitem JOIN e ON f = l_returnflag),
s AS (SELECT f, CAST(least(floor(place), {_BINS - 2}) AS INTEGER) AS bin, place - least(floor(place), {_BINS - 2}) AS part FROM p),
c AS (SELECT f, bin, sum(w) AS w FROM (SELECT f, bin, 1 - part AS w FROM s UNION ALL SELECT f, bin + 1, part FROM s) GROUP BY f, bin),
x AS (SELECT f, n, a, b, h, CAST(point AS INTEGER) AS point, a + (b - a) * point / {_POINTS - 1} AS x FROM e, range({_POINTS}) r(point))
SELECT f AS l_returnflag, point, round(any_value(x), 6) AS x, round(sum(w * exp(-pow((x - a - bin * (b - a) / {_BINS - 1}) / h, 2) / 2)) / any_value(n * h * sqrt(2 * pi())) * 1e6, 9) AS density FROM x JOIN c USING (f) GROUP BY f, point""")
def fare_density(spark, sf_dir):
    """The density of prices per service, per million."""
    out = dist.density(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", _POINTS, _BINS)
    return out.select("l_returnflag", "point", F.round("x", 6).alias("x"), F.round(F.col("density") * 1e6, 9).alias("density"))


_BOX = "b AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type), f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM b)"


@query(f"""WITH {_BOX} SELECT event_type, count(*) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
min(value) FILTER (value BETWEEN lo AND hi) AS low, max(value) FILTER (value BETWEEN lo AND hi) AS high, count(*) FILTER (value < lo) AS below, count(*) FILTER (value > hi) AS above FROM events JOIN f USING (event_type) GROUP BY event_type""")
def box_whiskers(spark, sf_dir):
    return _rounded(dist.box_whiskers(table(spark, sf_dir, "events"), ["event_type"], "value"), 6, "q1", "median", "q3")


@query(f"WITH {_BOX} SELECT event_id, event_type, value, round(CASE WHEN value < lo THEN lo ELSE hi END, 6) AS fence FROM events JOIN f USING (event_type) WHERE value < lo OR value > hi")
def box_outliers(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return _rounded(dist.box_outliers(rows, ["event_type"], "value"), 6, "fence")


def _polynomial(coefficients: list[float], x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out}) * ({x}) + ({c!r})"
    return f"({out})"


def _quantile_sql(p: str) -> str:
    """The normal quantile's rational approximation."""
    a, b, c, d = ACKLAM
    q, low, high = f"({p} - 0.5)", f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    middle = f"{_polynomial(a, f'{q} * {q}')} * {q} / {_polynomial(b, f'{q} * {q}')}"
    return f"CASE WHEN {p} < {ACKLAM_EDGE} THEN {_polynomial(c, low)} / {_polynomial(d, low)} WHEN {p} > {1 - ACKLAM_EDGE!r} THEN -{_polynomial(c, high)} / {_polynomial(d, high)} ELSE {middle} END"


_PLACED = "o AS (SELECT l_returnflag AS f, l_extendedprice AS x, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS DOUBLE) AS r, CAST(count(*) OVER (PARTITION BY l_returnflag) AS DOUBLE) AS n FROM lineitem)"
_FILLIBEN = "CASE WHEN r = 1 THEN 1 - pow(0.5, 1 / n) WHEN r = n THEN pow(0.5, 1 / n) ELSE (r - 0.3175) / (n + 0.365) END"


@query(f"WITH {_PLACED}, q AS (SELECT f, x, r, {_FILLIBEN} AS p FROM o) SELECT f AS l_returnflag, CAST(r AS BIGINT) AS rank, x, round({_quantile_sql('p')}, 9) AS score FROM q")
def qq_of_prices(spark, sf_dir):
    """Each service's prices in order, against normal quantiles."""
    out = dist.normal_scores(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return out.select("l_returnflag", "rank", "x", F.round("score", 9).alias("score"))


@query(f"""WITH {_PLACED}, q AS (SELECT f, x, {_FILLIBEN} AS p, (r - 0.375) / (n + 0.25) AS b FROM o), s AS (SELECT f, x, {_quantile_sql('p')} AS s, {_quantile_sql('b')} AS m FROM q)
SELECT f AS l_returnflag, count(*) AS n, round(regr_slope(x, s), 6) AS slope, round(regr_intercept(x, s), 6) AS intercept, round(corr(x, s), 9) AS r, round(pow(corr(x, m), 2), 9) AS w FROM s GROUP BY f""")
def normality_of_prices(spark, sf_dir):
    """The Q-Q line of each service's prices and the Shapiro-Francia statistic."""
    out = dist.normality(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice").drop("p")
    return _rounded(_rounded(out, 6, "slope", "intercept"), 9, "r", "w")


_C = ["l_quantity", "l_extendedprice", "l_discount"]
_FLAGS = ", ".join(f"d2 > {chi2_quantile(v, 3)!r} AS outlier_{n}" for v, n in ((0.95, "95"), (0.99, "99"), (0.999, "999")))


@query(f"""WITH m AS (SELECT avg({_C[0]}) AS m1, avg({_C[1]}) AS m2, avg({_C[2]}) AS m3, var_samp({_C[0]}) AS v1, var_samp({_C[1]}) AS v2, var_samp({_C[2]}) AS v3, 0.9 * covar_samp({_C[0]}, {_C[1]}) AS d, 0.9 * covar_samp({_C[0]}, {_C[2]}) AS e, 0.9 * covar_samp({_C[1]}, {_C[2]}) AS g FROM lineitem),
s AS (SELECT m1, m2, m3, d, e, g, 0.9 * v1 + 0.1 * (v1 + v2 + v3) / 3 AS a, 0.9 * v2 + 0.1 * (v1 + v2 + v3) / 3 AS b, 0.9 * v3 + 0.1 * (v1 + v2 + v3) / 3 AS c FROM m),
i AS (SELECT *, a * (b * c - g * g) - d * (d * c - g * e) + e * (d * g - b * e) AS det FROM s),
r AS (SELECT l_orderkey, l_linenumber, {_C[0]} - m1 AS x, {_C[1]} - m2 AS y, {_C[2]} - m3 AS z, i.* FROM lineitem, i),
q AS (SELECT l_orderkey, l_linenumber, ((b * c - g * g) * x * x + (a * c - e * e) * y * y + (a * b - d * d) * z * z + 2 * ((e * g - d * c) * x * y + (d * g - b * e) * x * z + (d * e - a * g) * y * z)) / det AS d2 FROM r)
SELECT l_orderkey, l_linenumber, round(d2, 6) AS d2, {_FLAGS} FROM q""")
def line_distances(spark, sf_dir):
    """Every line item's distance from the mean of three measures; SQL has the inverse of a 3 x 3 matrix in closed form."""
    out = dist.mahalanobis(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_C), _C)
    return _rounded(out.select("l_orderkey", "l_linenumber", "d2", "outlier_95", "outlier_99", "outlier_999"), 6, "d2")


_N = 7


def _spline_sql() -> str:
    """Cubic splines in closed form: the four that are not 0 between two knots."""
    pieces = ["pow(1 - t, 3) / 6", "(3 * t * t * t - 6 * t * t + 4) / 6", "(-3 * t * t * t + 3 * t * t + 3 * t + 1) / 6", "t * t * t / 6"]
    value = lambda j: "CASE i " + " ".join(f"WHEN {j - r} THEN {p}" for r, p in enumerate(pieces) if 0 <= j - r <= _N - 4) + " ELSE 0.0 END"
    columns = ", ".join(f"round({value(j)}, 9) AS b{j}" for j in range(_N))
    return f"""WITH e AS (SELECT min(l_quantity) AS a, (max(l_quantity) - min(l_quantity)) / {_N - 3} AS s FROM lineitem),
u AS (SELECT l_orderkey, l_linenumber, (least(l_quantity, a + s * {_N - 3} - 1e-12 * greatest(1.0, s)) - a) / s AS u FROM lineitem, e), t AS (SELECT *, least(floor(u), {_N - 4}) AS i, u - least(floor(u), {_N - 4}) AS t FROM u)
SELECT l_orderkey, l_linenumber, {columns} FROM t"""


@query(_spline_sql())
def spline_basis(spark, sf_dir):
    """Seven cubic splines of each line item's quantity; they sum to 1."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    a, b = rows.agg(F.min("l_quantity"), F.max("l_quantity")).first()
    out = rows.withColumn("b", basis(F.col("l_quantity"), a, b, _N))
    return out.select("l_orderkey", "l_linenumber", *(F.round(F.col("b")[j], 9).alias(f"b{j}") for j in range(_N)))


_DRAWN = " + ".join(f"CAST(u > {p!r} AS INTEGER)" for p in POISSON)


@query(f"""WITH {_RULE.replace('FROM events', ', event_id FROM events')}, b AS (SELECT CAST(label = pred AS INTEGER) AS hit, g, md5(concat_ws('|', CAST(event_id AS VARCHAR), CAST(g AS VARCHAR), '42')) AS h FROM r, range(25) t(g)),
u AS (SELECT hit, 4 * g + i AS b, (CAST('0x' || substr(h, CAST(8 * i + 1 AS BIGINT), 8) AS BIGINT) + 0.5) / 4294967296.0 AS u FROM b, range(4) s(i)), w AS (SELECT b, hit, {_DRAWN} AS w FROM u),
a AS (SELECT b, CAST(sum(w * hit) AS DOUBLE) / sum(w) AS a FROM w GROUP BY b) SELECT round(avg(a), 9) AS mean, round(stddev_pop(a), 9) AS std, round(quantile_cont(a, 0.025), 9) AS low, round(quantile_cont(a, 0.975), 9) AS high FROM a""")
def accuracy_bootstrap_rows(spark, sf_dir):
    """The accuracy of a rule over 100 resamples whose counts come from digests of the event's id."""
    return _rounded(accuracy_bootstrap(_ruled(spark, sf_dir), "label", "pred", ["event_id"]), 9, "mean", "std", "low", "high")


_REDONE = (1995, 3)


@query(f"""WITH o AS (SELECT ['yellow', 'green', 'fhv'][o_custkey % 3 + 1] AS type, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(o_orderdate AS DATE) AS date FROM orders),
d AS (SELECT type, year, month, date, count(*) AS rides FROM o GROUP BY ALL)
SELECT type, year, month, count(*) AS days, CAST(sum(rides) AS BIGINT) AS rides FROM d WHERE (year, month) <> {_REDONE} OR rides >= 2 GROUP BY ALL""")
def replayed_months(spark, sf_dir):
    """Orders a day by type, year and month; one month is redone with a threshold, all are read back, and named by their paths."""
    o = table(spark, sf_dir, "orders")
    kind = F.element_at(F.array(F.lit("yellow"), F.lit("green"), F.lit("fhv")), (F.col("o_custkey") % 3 + 1).cast("int"))
    days = o.groupBy(kind.alias("taxi_type"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("rides"))
    path = f"{shared_folder(spark)}/replayed-{uuid.uuid4().hex}"
    write_months(days, path)
    write_months(days.where((F.col("year") == _REDONE[0]) & (F.col("month") == _REDONE[1]) & (F.col("rides") >= 2)), path, redo=[_REDONE])
    rows = with_path_month(read_months(spark, path), path)
    out = cut(rows.groupBy(F.col("path_type").alias("type"), F.col("path_year").alias("year"), F.col("path_month").alias("month")).agg(F.count("*").alias("days"), F.sum("rides").alias("rides")))
    delete(spark, path)
    return out


_STEPS = 300


def _power_sql() -> str:
    rows = ", ".join("[" + ", ".join(f"covar_pop(hour_{min(i, j)}, hour_{max(i, j)})" for j in range(24)) + "]" for i in range(24))
    start = "[" + ", ".join(repr(1 + i / 100) for i in range(24)) + "]"
    unit = lambda v: f"[x / sqrt(list_dot_product({v}, {v})) FOR x IN {v}]"
    parts = [f"WITH RECURSIVE {_W}, m1 AS (SELECT [{rows}] AS m FROM w)"]
    for k in (1, 2):
        parts.append(f"p{k}(s, v) AS (SELECT 0, {unit(start)} UNION ALL SELECT s + 1, {unit('w')} FROM (SELECT s, [list_dot_product(r, v) FOR r IN m] AS w FROM p{k}, m{k} WHERE s < {_STEPS}))")
        parts.append(f"u{k} AS (SELECT v, list_dot_product(v, [list_dot_product(r, v) FOR r IN m]) AS variance, m FROM p{k}, m{k} WHERE s = {_STEPS})")
        parts.append(f"c{k} AS (SELECT {k} AS component, variance, m, CASE WHEN list_contains(v, list_max([abs(x) FOR x IN v])) THEN v ELSE [-x FOR x IN v] END AS v FROM u{k})")
        parts.append(f"m{k + 1} AS (SELECT [[m[i][j] - variance * v[i] * v[j] FOR j IN range(1, 25)] FOR i IN range(1, 25)] AS m FROM c{k})")
    every = " UNION ALL ".join(f"SELECT component, variance, v FROM c{k}" for k in (1, 2))
    return ", ".join(parts) + f" SELECT component, round(variance, 6) AS variance, 'hour_' || h AS feature, round(v[h + 1], 6) AS loading FROM ({every}), range(24) r(h)"


@query(_power_sql())
def leading_component(spark, sf_dir):
    """The two leading components of the wide table, by power iteration and deflation."""
    found = leading_components(_wide(spark, sf_dir), HOURS, 2, _STEPS)
    rows = found.select("component", F.round("variance", 6).alias("variance"), F.posexplode("loadings").alias("h", "x"))
    return rows.select("component", "variance", F.concat(F.lit("hour_"), F.col("h").cast("string")).alias("feature"), F.round("x", 6).alias("loading"))


_CAPPED = """t AS (SELECT l_returnflag AS service, l_extendedprice AS fare, l_quantity AS distance, date_diff('microsecond', o_orderdate, l_shipdate) / 6e7 AS minutes FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
a AS (SELECT * FROM t WHERE fare > 0 AND distance > 0 AND minutes > 0),
b AS (SELECT a.* FROM a JOIN (SELECT service, quantile_cont(fare, 0.99) AS q FROM a GROUP BY service) USING (service) WHERE fare <= q),
c AS (SELECT b.* FROM b JOIN (SELECT service, quantile_cont(distance, 0.99) AS q FROM b GROUP BY service) USING (service) WHERE distance <= q),
d AS (SELECT c.* FROM c JOIN (SELECT service, quantile_cont(minutes, 0.99) AS q FROM c GROUP BY service) USING (service) WHERE minutes <= q)"""


@query(f"""WITH {_CAPPED} SELECT service, count(*) AS n, round(avg(fare), 2) AS mean, round(median(fare), 2) AS median, round(stddev_samp(fare), 2) AS std, round(quantile_cont(fare, 0.25), 2) AS p25, round(quantile_cont(fare, 0.75), 2) AS p75,
round(regr_slope(ln(1 + fare), ln(1 + distance)), 6) AS slope, round(regr_intercept(ln(1 + fare), ln(1 + distance)), 6) AS intercept, round(regr_r2(ln(1 + fare), ln(1 + distance)), 6) AS r2, true AS fitted FROM d GROUP BY service""")
def services_compared(spark, sf_dir):
    """The fare stage's comparison of services: cleaned and capped each by itself, fare statistics, log trend, and whether a spline model was fit."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_returnflag", F.col("o_orderdate").alias("tpep_pickup_datetime"), F.col("l_shipdate").alias("tpep_dropoff_datetime"), F.col("l_quantity").alias("trip_distance"), F.col("l_extendedprice").alias("fare_amount"),
        F.col("l_linenumber").alias("passenger_count"), F.col("l_suppkey").alias("PULocationID"),
    ).persist(StorageLevel.MEMORY_AND_DISK)
    try:  # the services read the join once each for their caps and once for what is left
        stats, trend, models = compare_services([(f, rows.where(F.col("l_returnflag") == f).drop("l_returnflag")) for f in ("A", "N", "R")], None)
    finally:
        rows.unpersist()
    out = stats.join(_rounded(trend, 6, "slope", "intercept", "r2"), "service")
    return out.withColumn("fitted", F.col("service").isin(list(models)))
