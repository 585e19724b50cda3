"""The registered queries of the analytics part, each with its SQL where SQL can express it.

Roles: an event is a trip, its type the taxi type, ``user_id % 5`` the place,
``event_id % 3`` the file; line items joined with their orders are trips with a
fare, a distance and a duration; nation and region are the zone lookup.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.paths import month_of, taxi_type_of
from tideline.functions.scalars import colour, day_of_week, fill_and_clip, minutes_between, proportions, quantile_bin, to_number, total_of
from tideline.models.gam import Gam, Linear, Smooth, fit_by_group
from tideline.models.gram import covariance, moments
from tideline.models.pca import bootstrap_stability, diagnostics, fit_pca, scores_by_place, tail_analysis
from tideline.models.trees import accuracy, accuracy_bootstrap, evaluate, importances, sweep
from tideline.operators import aggregates as agg
from tideline.operators.filters import cap_sequentially, discards, mismatches_by_month, positive
from tideline.operators.joins import centroids, enrich, fill_with_median, match_rate
from tideline.operators.pivot import cleanup_stats, combine_with_threshold, hourly_pivot, low_count_cleanup, row_breakdown
from tideline.operators.quantiles import exact_quantile
from tideline.operators.sampling import sample_rows, stratified_split
from tideline.sources.readers import union_sources

MIN_RIDES, FILE_MIN_RIDES = 10, 4
KEYS = ["event_type", "date", "place"]
HOURS = [f"hour_{h}" for h in range(24)]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_type", F.to_date("ts").alias("date"), (F.col("user_id") % 5).alias("place"), F.hour("ts").alias("h"), (F.col("event_id") % 3).alias("file"))


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_pivot(_event_rows(spark, sf_dir), KEYS, F.col("h"))


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their orders: a shuffle join on the order key, of pruned columns."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    out = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return out.withColumn("duration_min", minutes_between(F.col("o_orderdate"), F.col("l_shipdate")))


_H = ", ".join(f"CAST(count(*) FILTER (hour(ts) = {h}) AS BIGINT) AS hour_{h}" for h in range(24))
_SUM_H = ", ".join(f"CAST(sum(hour_{h}) AS BIGINT) AS hour_{h}" for h in range(24))
_TOTAL = " + ".join(HOURS)
_W = f"w AS (SELECT event_type, CAST(ts AS DATE) AS date, user_id % 5 AS place, {_H} FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL GROUP BY ALL)"
_T = "t AS (SELECT *, date_diff('microsecond', o_orderdate, l_shipdate) / 6e7 AS duration_min FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(f"WITH {_W} SELECT * FROM w")
def hourly_pivot_counts(spark, sf_dir):
    return _wide(spark, sf_dir)


@query(f"WITH {_W} SELECT * FROM w WHERE {_TOTAL} >= 10")
def low_count_filter(spark, sf_dir):
    return low_count_cleanup(_wide(spark, sf_dir), MIN_RIDES)


@query(f"WITH {_W} SELECT count(*) AS rows_before, count(*) FILTER ({_TOTAL} >= 10) AS rows_after, count(*) FILTER ({_TOTAL} < 10) AS rows_removed, 10 AS min_rides FROM w")
def cleanup_statistics(spark, sf_dir):
    return cleanup_stats(_wide(spark, sf_dir), MIN_RIDES)


@query(f"WITH f AS (SELECT event_id % 3 AS file, event_type, CAST(ts AS DATE) AS date, user_id % 5 AS place, {_H} FROM events GROUP BY ALL), k AS (SELECT * FROM f WHERE {_TOTAL} >= 4) SELECT event_type, date, place, {_SUM_H} FROM k GROUP BY ALL")
def combine_wide_table(spark, sf_dir):
    return combine_with_threshold(_event_rows(spark, sf_dir), "file", KEYS, F.col("h"), FILE_MIN_RIDES)


@query(f"WITH {_W} SELECT CAST(year(date) AS INTEGER) AS year, event_type, count(*) AS row_count FROM w WHERE {_TOTAL} >= 10 GROUP BY ALL")
def row_breakdown_year_type(spark, sf_dir):
    return row_breakdown(low_count_cleanup(_wide(spark, sf_dir), MIN_RIDES), kind="event_type")


@query(f"WITH {_W} SELECT event_type, date, place, CAST({_TOTAL} AS BIGINT) AS total_rides FROM w")
def total_rides(spark, sf_dir):
    return _wide(spark, sf_dir).select(*KEYS, total_of(HOURS).alias("total_rides"))


@query(f"WITH {_T} SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) FILTER (wrong) AS mismatch_rows, count(DISTINCT l_returnflag) FILTER (wrong) AS affected_groups FROM (SELECT *, year(l_shipdate) <> year(o_orderdate) OR month(l_shipdate) <> month(o_orderdate) AS wrong FROM t) GROUP BY ALL")
def month_mismatch_by_month(spark, sf_dir):
    at = F.col("o_orderdate")
    return mismatches_by_month(_trips(spark, sf_dir), F.col("l_shipdate"), F.year(at), F.month(at), F.col("l_returnflag"))


@query(f"WITH {_T}, u AS (SELECT o_orderdate, CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_shipdate END AS shipped FROM t) SELECT count(*) AS input_rows, count(*) FILTER (shipped IS NULL) AS parse_fail, count(*) FILTER (shipped IS NOT NULL AND NOT same) AS mismatch, count(*) FILTER (shipped IS NOT NULL AND same) AS after_filters FROM (SELECT shipped, year(shipped) = year(o_orderdate) AND month(shipped) = month(o_orderdate) AS same FROM u)")
def discard_accounting(spark, sf_dir):
    """Every seventh line's date is made unreadable text, to be coerced to null."""
    text = F.when(F.col("l_linenumber") % 7 == 0, F.lit("not_a_date")).otherwise(F.col("l_shipdate").cast("string"))
    rows = _trips(spark, sf_dir).select("o_orderdate", text.try_cast("timestamp_ntz").alias("at"))
    same = (F.year("at") == F.year("o_orderdate")) & (F.month("at") == F.month("o_orderdate"))
    return discards(rows, F.col("at").isNotNull(), same)


_STATS = "count(*) AS input_rows, count(*) FILTER (wrong) AS mismatch"


@query(f"WITH {_T}, s AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, l_returnflag AS file, year(l_shipdate) <> year(o_orderdate) OR month(l_shipdate) <> month(o_orderdate) AS wrong FROM t) SELECT year, file, CAST(grouping(year, file) AS INTEGER) AS level, {_STATS} FROM s GROUP BY ROLLUP (year, file)")
def file_month_rollup(spark, sf_dir):
    """Statistics per file, per year and of the whole, in one grouping."""
    t = _trips(spark, sf_dir)
    wrong = ~((F.year("l_shipdate") == F.year("o_orderdate")) & (F.month("l_shipdate") == F.month("o_orderdate")))
    rows = t.select(F.year("o_orderdate").alias("year"), F.col("l_returnflag").alias("file"), wrong.alias("wrong"))
    return rows.rollup("year", "file").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("input_rows"), F.count_if("wrong").alias("mismatch"))


#: Shapes of paths, to be filled with an order's year and month; the last ones name no month.
SHAPES = [
    "yellow_tripdata_%04d-%02d.parquet", "/data/%04d-%02d/file.parquet", "s3://bucket/year=%04d/month=%02d/data.parquet", "GREEN_data_%04d%02d.parquet", "fhvhv_%04d-%02d_data_2023-01.parquet",
    "/data/fhv/%04d_%02d.parquet", "uber_%04d-%02d-13.parquet", "data_%1$04d-13_%2$02d.parquet", "data_%1$04d-00_%2$02d.parquet", "data.parquet",
]
_PATHS = f"""(SELECT o_orderkey, format([{", ".join("'" + s.replace("%1$04d", "{0:04d}").replace("%2$02d", "{1:02d}").replace("%04d", "{0:04d}").replace("%02d", "{1:02d}") + "'" for s in SHAPES)}][o_orderkey % {len(SHAPES)} + 1], year(o_orderdate), month(o_orderdate)) AS path FROM orders)"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path for every order, of one of the shapes."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))
    path = F.lit(None).cast("string")
    for i, shape in enumerate(SHAPES):
        path = F.when(F.col("o_orderkey") % len(SHAPES) == i, F.format_string(shape, "y", "m") if "%" in shape else F.lit(shape)).otherwise(path)
    return o.select("o_orderkey", path.alias("path"))


def _month_sql(pattern: str, tail: str) -> str:
    y, m = (f"try_cast(regexp_extract(path, '{pattern}', {i}) AS INTEGER)" for i in (1, 2))
    return f"CASE WHEN {m} BETWEEN 1 AND 12 THEN {{'y': {y}, 'm': {m}}} ELSE {tail} END"


_MONTH = _month_sql(r"(\d{4})-(\d{2})", _month_sql(r"year=(\d{4}).*month=(\d{1,2})", _month_sql(r"(\d{4})(\d{2})", "NULL")))


@query(f"SELECT o_orderkey, path, s.y AS year, s.m AS month FROM (SELECT o_orderkey, path, {_MONTH} AS s FROM {_PATHS})")
def infer_month_from_path(spark, sf_dir):
    year, month = month_of(F.col("path"))
    return _paths(spark, sf_dir).select("o_orderkey", "path", year.alias("year"), month.alias("month"))


@query(f"SELECT o_orderkey, path, CASE WHEN contains(lower(path), 'yellow') THEN 'yellow' WHEN contains(lower(path), 'green') THEN 'green' WHEN contains(lower(path), 'fhvhv') THEN 'fhvhv' WHEN contains(lower(path), 'fhv') THEN 'fhv' END AS type, CASE WHEN contains(lower(path), 'yellow') THEN 'yellow' WHEN contains(lower(path), 'green') THEN 'green' WHEN contains(lower(path), 'fhv') THEN 'fhv' END AS legacy_type FROM {_PATHS}")
def infer_type_from_path(spark, sf_dir):
    path = F.col("path")
    return _paths(spark, sf_dir).select("o_orderkey", "path", taxi_type_of(path).alias("type"), taxi_type_of(path, legacy=True).alias("legacy_type"))


@query(f"WITH {_T} SELECT l_orderkey, l_linenumber, duration_min, CAST(hour(l_shipdate) AS INTEGER) AS hour, CAST(isodow(l_shipdate) - 1 AS INTEGER) AS day_of_week FROM t")
def trip_features(spark, sf_dir):
    return _trips(spark, sf_dir).select("l_orderkey", "l_linenumber", "duration_min", F.hour("l_shipdate").alias("hour"), day_of_week(F.col("l_shipdate")).alias("day_of_week"))


@query(f"""WITH {_T}, a AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, duration_min FROM t WHERE l_extendedprice > 0 AND l_quantity > 0 AND duration_min > 0),
b AS (SELECT * FROM a WHERE l_extendedprice <= (SELECT quantile_cont(l_extendedprice, 0.99) FROM a)), c AS (SELECT * FROM b WHERE l_quantity <= (SELECT quantile_cont(l_quantity, 0.99) FROM b))
SELECT * FROM c WHERE duration_min <= (SELECT quantile_cont(duration_min, 0.99) FROM c)""")
def fare_clean_p99(spark, sf_dir):
    measures = ["l_extendedprice", "l_quantity", "duration_min"]
    rows = positive(_trips(spark, sf_dir), measures).select("l_orderkey", "l_linenumber", *measures)
    return cap_sequentially(rows, measures)


@query(f"WITH {_T} SELECT l_orderkey, l_linenumber, l_quantity, duration_min, l_linenumber - 2 AS passengers FROM t WHERE l_quantity > 0 AND duration_min > 0 AND l_linenumber - 2 > 0")
def classifier_clean(spark, sf_dir):
    rows = _trips(spark, sf_dir).withColumn("passengers", F.col("l_linenumber") - 2)
    return positive(rows, ["l_quantity", "duration_min", "passengers"]).select("l_orderkey", "l_linenumber", "l_quantity", "duration_min", "passengers")


@query("SELECT event_id, greatest(coalesce(try_cast(CASE WHEN event_id % 3 = 0 THEN props ELSE CAST(value AS VARCHAR) END AS DOUBLE), 1.0), 1.0) AS num FROM events")
def coerce_numeric(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", fill_and_clip(to_number(text)).alias("num"))


@query("SELECT c_custkey, coalesce(r_name, 'Unknown') AS region_name FROM customer LEFT JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey >= 5) ON c_nationkey = n_nationkey")
def zone_left_join_unknown(spark, sf_dir):
    """Nations below 5 are left out of the lookup, so that some rows find nothing."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    zones = nation.where("n_nationkey >= 5").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("region_name")).dropDuplicates()
    return enrich(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), zones, "c_nationkey", {"region_name": "Unknown"}).select("c_custkey", "region_name")


_PLACE_MEANS = "m AS (SELECT user_id % 5 AS place, avg(value) AS score FROM events WHERE user_id % 5 <> 0 GROUP BY ALL)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("place", F.col("user_id") % 5)
    means = e.where("place <> 0").groupBy("place").agg(F.avg("value").alias("score"))
    return e.join(means, "place", "left")


@query(f"WITH {_PLACE_MEANS}, j AS (SELECT event_id, score FROM events LEFT JOIN m ON user_id % 5 = place) SELECT event_id, round(coalesce(score, (SELECT median(score) FROM j)), 6) AS score FROM j")
def score_enrich_median_fill(spark, sf_dir):
    return fill_with_median(_scored(spark, sf_dir), ["score"]).select("event_id", F.round("score", 6).alias("score"))


@query(f"WITH {_PLACE_MEANS} SELECT count(score) AS matched, count(*) AS total, round(100.0 * count(score) / count(*), 6) AS pct FROM events LEFT JOIN m ON user_id % 5 = place")
def match_rate_of_scores(spark, sf_dir):
    return match_rate(_scored(spark, sf_dir), "score")


@query("SELECT service, count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT 'clicks' AS service, user_id FROM events WHERE event_type = 'click' UNION ALL SELECT 'views', user_id FROM events WHERE event_type = 'view' UNION ALL SELECT 'others', user_id FROM events WHERE event_type NOT IN ('click', 'view')) GROUP BY ALL")
def multi_service_union(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type")
    parts = [("clicks", e.where("event_type = 'click'")), ("views", e.where("event_type = 'view'")), ("others", e.where("event_type not in ('click', 'view')")), ("missing", None)]
    return union_sources(parts).groupBy("service").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT l_returnflag AS service, count(l_extendedprice) AS n, round(avg(l_extendedprice), 2) AS mean, round(median(l_extendedprice), 2) AS median, round(stddev_samp(l_extendedprice), 2) AS std, round(quantile_cont(l_extendedprice, 0.25), 2) AS p25, round(quantile_cont(l_extendedprice, 0.75), 2) AS p75 FROM lineitem GROUP BY ALL")
def fare_stats_by_service(spark, sf_dir):
    return agg.group_stats(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "service"), "service", "l_extendedprice")


@query("SELECT event_type, " + ", ".join(f"round(avg(value) FILTER (hour(ts) = {h}), 6) AS mean_{h}" for h in range(24)) + " FROM events GROUP BY ALL")
def mean_by_region_hour(spark, sf_dir):
    grid = agg.mean_grid(table(spark, sf_dir, "events"), "event_type", F.hour("ts"), "value", list(range(24)), "mean_")
    return grid.select("event_type", *(F.round(f"mean_{h}", 6).alias(f"mean_{h}") for h in range(24)))


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY ALL ORDER BY n DESC, segment")
def segment_counts(spark, sf_dir):
    return agg.value_counts(table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "segment"), "segment")


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a in _NUM for b in _NUM if a != b) + "".join(f" UNION ALL SELECT '{a}', '{a}', CAST(1.0 AS DOUBLE)" for a in _NUM))
def corr_matrix(spark, sf_dir):
    return agg.correlations(table(spark, sf_dir, "lineitem"), _NUM).select("col_a", "col_b", F.round("corr", 6).alias("corr"))


@query("SELECT l_returnflag AS service, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM (SELECT l_returnflag, ln(1 + l_quantity) AS x, ln(1 + l_extendedprice) AS y FROM lineitem) GROUP BY ALL")
def log_trend_by_service(spark, sf_dir):
    fit = agg.log_trend(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "service"), "service", "l_quantity", "l_extendedprice")
    return fit.select("service", *(F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")))


@query("WITH e AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem) SELECT CAST(least(floor((l_extendedprice - a) / (b - a) * 60), 59) AS BIGINT) AS bin, count(*) AS n FROM lineitem, e GROUP BY ALL")
def price_histogram(spark, sf_dir):
    return agg.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 60)


@query("""WITH u AS (SELECT DISTINCT user_id FROM events), q AS (SELECT quantile_cont(CAST(user_id AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS e, min(user_id) AS a, max(user_id) AS b FROM u)
SELECT user_id, CAST(CASE WHEN user_id <= e[1] THEN 0 WHEN user_id <= e[2] THEN 1 WHEN user_id <= e[3] THEN 2 WHEN user_id <= e[4] THEN 3 ELSE 4 END AS INTEGER) AS region FROM u, q""")
def qcut_region(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    edges = [exact_quantile(users, "user_id", q) for q in (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)]
    return users.select("user_id", quantile_bin(F.col("user_id"), edges).alias("region"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 3) AS mean, round(stddev_samp({c}), 3) AS std, round(min({c}), 3) AS min, round(quantile_cont({c}, 0.25), 3) AS p25, round(quantile_cont({c}, 0.5), 3) AS p50, round(quantile_cont({c}, 0.75), 3) AS p75, round(max({c}), 3) AS max FROM lineitem" for c in _NUM))
def describe_numeric(spark, sf_dir):
    return agg.describe(table(spark, sf_dir, "lineitem"), _NUM)


_Z = "(l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_samp(l_quantity) FROM lineitem)"


@query(f"WITH z AS (SELECT {_Z} AS l_quantity FROM lineitem) SELECT 'l_quantity' AS \"column\", count(l_quantity) AS count, round(avg(l_quantity), 6) + 0 AS mean, round(stddev_samp(l_quantity), 6) AS std, round(min(l_quantity), 6) AS min, round(quantile_cont(l_quantity, 0.25), 6) AS p25, round(quantile_cont(l_quantity, 0.5), 6) AS p50, round(quantile_cont(l_quantity, 0.75), 6) AS p75, round(max(l_quantity), 6) AS max FROM z")
def standardized_box(spark, sf_dir):
    out = agg.box_stats(table(spark, sf_dir, "lineitem").select("l_quantity"), ["l_quantity"])
    return out.withColumn("mean", F.col("mean") + F.lit(0.0))


@query(f"WITH {_W} SELECT " + ", ".join(f"round(avg({h}), 6) AS {h}" for h in HOURS) + " FROM w")
def column_means(spark, sf_dir):
    return _wide(spark, sf_dir).agg(*(F.round(F.avg(h), 6).alias(h) for h in HOURS))


_PAIRS = [(i, j) for i in range(24) for j in range(24)]


@query(f"WITH {_W}, c AS (SELECT " + ", ".join(f"covar_pop(hour_{i}, hour_{j}) AS c{i}_{j}" for i, j in _PAIRS if i <= j) + " FROM w) " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(c{min(i, j)}_{max(i, j)}, 6) AS cov FROM c" for i, j in _PAIRS))
def covariance_matrix(spark, sf_dir):
    _, _, cov = covariance(moments(_wide(spark, sf_dir), HOURS)[0])
    return spark.createDataFrame([(i, j, float(cov[i, j])) for i, j in _PAIRS], "i int, j int, cov double").withColumn("cov", F.round("cov", 6))


@query(f"WITH {_W} SELECT event_type, date, place, " + ", ".join(f"round({h} / CAST(CASE WHEN ({_TOTAL}) = 0 THEN 1 ELSE {_TOTAL} END AS DOUBLE), 6) AS {h}" for h in HOURS) + " FROM w")
def hour_proportions(spark, sf_dir):
    out = proportions(_wide(spark, sf_dir), HOURS)
    return out.select(*KEYS, *(F.round(h, 6).alias(h) for h in HOURS))


_CURVE = "s AS (SELECT rank, x, rank / n AS survival, n FROM (SELECT row_number() OVER (ORDER BY x DESC, l_orderkey, l_linenumber) AS rank, x, CAST(count(*) OVER () AS DOUBLE) AS n FROM (SELECT abs(l_extendedprice) AS x, l_orderkey, l_linenumber FROM lineitem) WHERE x > 0))"


@query(f"WITH {_CURVE} SELECT rank, x, round(survival, 9) AS survival FROM s")
def survival_curve(spark, sf_dir):
    return agg.survival(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_orderkey", "l_linenumber"]).select("rank", "x", F.round("survival", 9).alias("survival"))


@query(f"WITH {_CURVE}, f AS (SELECT -regr_slope(log10(survival), log10(x)) AS alpha, regr_r2(log10(survival), log10(x)) AS r2, count(*) AS tail_points FROM s WHERE rank <= greatest(10, ceil(0.05 * n))) SELECT round(alpha, 6) AS alpha, round(r2, 6) AS r2, CASE WHEN tail_points < 5 THEN 'insufficient_data' WHEN r2 > 0.85 AND alpha > 0 AND alpha < 5 THEN 'heavy_tail' ELSE 'light_tail' END AS classification, tail_points FROM f")
def tail_fit(spark, sf_dir):
    fit = agg.tail_fit(agg.survival(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_orderkey", "l_linenumber"]))
    return fit.select(F.round("alpha", 6).alias("alpha"), F.round("r2", 6).alias("r2"), "classification", "tail_points")


@query("WITH h AS (SELECT hour(ts) AS hour, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY ALL) SELECT row_number() OVER (ORDER BY n DESC, hour) AS rank, round(n / sum(n) OVER (), 9) AS ratio, round(sum(n) OVER (ORDER BY n DESC, hour ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 9) AS cum_ratio FROM h")
def cumulative_variance(spark, sf_dir):
    hours = table(spark, sf_dir, "events").groupBy(F.hour("ts").alias("hour")).agg(F.count("*").cast("double").alias("n"))
    return agg.cumulative_ratio(hours, "n", "hour").select("rank", F.round("ratio", 9).alias("ratio"), F.round("cum_ratio", 9).alias("cum_ratio"))


@query("""WITH v AS (SELECT vec_id, [ln(abs(CAST(x AS DOUBLE))) FOR x IN embedding IF abs(x) > 1e-10] AS y FROM embeddings), p AS (SELECT vec_id, len(y) AS n, unnest(y) AS y, unnest(range(len(y))) AS i FROM v)
SELECT vec_id, round(coalesce(r, 0.0), 6) AS r2 FROM embeddings LEFT JOIN (SELECT vec_id, CASE WHEN count(*) < 5 THEN 0.0 ELSE regr_r2(y, i) END AS r FROM p GROUP BY vec_id) USING (vec_id)""")
def vandermonde_r2(spark, sf_dir):
    return agg.log_profile_r2(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").select("vec_id", F.round("r2", 6).alias("r2"))


@query("""WITH o AS (SELECT quality, row_number() OVER (PARTITION BY quality ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), '42')), doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT quality, CASE WHEN r <= floor(n * 0.8) THEN 'train' ELSE 'valid' END AS split, count(*) AS n FROM o GROUP BY ALL""")
def stratified_split_counts(spark, sf_dir):
    return stratified_split(table(spark, sf_dir, "labels"), "quality", "doc_id").groupBy("quality", "split").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), '42')), doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, CASE WHEN r <= floor(n * 0.8) THEN 'train' ELSE 'valid' END AS split FROM o""")
def stratified_split_rows(spark, sf_dir):
    return stratified_split(table(spark, sf_dir, "labels"), "quality", "doc_id").select("doc_id", "quality", "split")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), '42')), l_orderkey, l_linenumber, l_quantity LIMIT 1000")
def sample_of_trips(spark, sf_dir):
    """The sampling operator: 1000 rows without replacement."""
    return sample_rows(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), 1000, "l_orderkey", "l_linenumber")


_RULE = "r AS (SELECT CAST(event_type IN ('purchase', 'click') AS INTEGER) AS label, CAST(value > 50 AS INTEGER) AS pred FROM events)"


def _ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").isin("purchase", "click").cast("int").alias("label"), (F.col("value") > 50).cast("int").alias("pred"), "event_id")


@query(f"WITH {_RULE} SELECT label, pred, count(*) AS n FROM r GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return agg.confusion(_ruled(spark, sf_dir), "label", "pred")


@query(f"""WITH {_RULE}, k AS (SELECT unnest([0, 1]) AS c), s AS (SELECT c, count(*) FILTER (label = c AND pred = c) AS hit, count(*) FILTER (label = c) AS support, count(*) FILTER (pred = c) AS guessed FROM k, r GROUP BY c),
p AS (SELECT CAST(c AS VARCHAR) AS class, CASE WHEN guessed > 0 THEN hit / guessed ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0.0 END AS recall, support, hit FROM s WHERE support + guessed > 0),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM p),
a AS (SELECT class, precision, recall, f1, CAST(support AS BIGINT) AS support FROM f UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), CAST(sum(support) AS BIGINT) FROM f)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM a""")
def classification_report(spark, sf_dir):
    out = agg.classification_report(_ruled(spark, sf_dir), "label", "pred")
    return out.select("class", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query("SELECT round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(1 - sum(e * e) / (var_pop(y) * count(y)), 6) AS r2 FROM (SELECT l_extendedprice AS y, l_extendedprice - (1000 + 1500 * l_quantity) AS e FROM lineitem)")
def regression_metrics(spark, sf_dir):
    out = agg.regression_metrics(table(spark, sf_dir, "lineitem"), F.col("l_extendedprice"), 1000 + 1500 * F.col("l_quantity"))
    return out.select(F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


@query("""WITH p AS (SELECT user_id % 5 AS place, avg(value) AS score FROM events GROUP BY ALL), q AS (SELECT *, min(score) OVER () AS a, max(score) OVER () AS b FROM p WHERE place <> 3),
r AS (SELECT place, CASE WHEN b > a THEN (score - a) / (b - a) ELSE 0.5 END AS part, b > a AS wide FROM q)
SELECT place, '#' || lpad(lower(to_hex(CAST(floor(part * 255) AS BIGINT))), 2, '0') || '00' || lpad(lower(to_hex(255 - CAST(floor(part * 255) AS BIGINT))), 2, '0') AS colour, round(CASE WHEN wide THEN 4 + 10 * part ELSE 6.0 END, 6) AS radius FROM r""")
def map_markers(spark, sf_dir):
    """Place 3 has no coordinates and gets no marker."""
    rows = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("place")).agg(F.avg("value").alias("score")).where("place <> 3")
    ends = rows.agg(F.min("score").alias("a"), F.max("score").alias("b"))
    text, radius = colour(F.col("score"), F.col("a"), F.col("b"))
    return rows.join(F.broadcast(ends)).select("place", text.alias("colour"), F.round(radius, 6).alias("radius"))  # one row


@query("SELECT n_regionkey AS region, round(avg(s_acctbal), 6) AS latitude, round(avg(n_nationkey), 6) AS longitude FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL")
def zone_centroids(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    out = centroids(rows, "n_regionkey", "s_acctbal", "n_nationkey")
    return out.select(F.col("n_regionkey").alias("region"), F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))


@query(f"""WITH {_W}, q AS (SELECT quantile_cont(CAST(place AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS e FROM w)
SELECT event_type, date, place, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(isodow(date) - 1 AS INTEGER) AS dow, CAST(coalesce(place, -1) AS INTEGER) AS loc_id,
CAST(CASE WHEN place <= e[1] THEN 0 WHEN place <= e[2] THEN 1 WHEN place <= e[3] THEN 2 WHEN place <= e[4] THEN 3 ELSE 4 END AS INTEGER) AS region FROM w, q""")
def enriched_features(spark, sf_dir):
    return _enriched(_wide(spark, sf_dir)).select(*KEYS, "year", "month", "dow", "loc_id", "region")


def _enriched(wide: DataFrame) -> DataFrame:
    edges = [exact_quantile(wide, "place", q) for q in (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)]
    return wide.withColumns({
        "year": F.year("date"), "month": F.month("date"), "dow": day_of_week(F.col("date")), "loc_id": F.coalesce(F.col("place"), F.lit(-1)).cast("int"),
        "region": F.coalesce(quantile_bin(F.col("place"), edges), F.lit(2)),
    })


@query()
def pca_loadings(spark, sf_dir):
    return fit_pca(_wide(spark, sf_dir)).loadings_frame(spark)


@query()
def pca_scores_by_place(spark, sf_dir):
    wide = _wide(spark, sf_dir)
    return scores_by_place(wide, fit_pca(wide), "place")


@query()
def pca_summary(spark, sf_dir):
    """Summary numbers of the components and of their tail."""
    model = fit_pca(_wide(spark, sf_dir))
    found, tail = diagnostics(model), tail_analysis(model)
    rows = [(k, float(found[k])) for k in ("condition_number", "effective_rank", "kaiser", "orthogonality")] + [(f"tail_{k}", float(v)) for k, v in tail.items() if not isinstance(v, str)]
    return spark.createDataFrame(rows, "measure string, value double")


@query()
def hour_outliers(spark, sf_dir):
    """Hours by their distance from the others in the space of components."""
    rows = [(i + 1, h["hour"], h["d2"], h["p"]) for i, h in enumerate(diagnostics(fit_pca(_wide(spark, sf_dir)))["mahalanobis"])]
    return spark.createDataFrame(rows, "rank int, hour string, d2 double, p double")


@query()
def pca_bootstrap(spark, sf_dir):
    found = bootstrap_stability(_wide(spark, sf_dir), KEYS, 100, 2)
    return spark.createDataFrame([(k, float(v)) for k, v in found.items() if not isinstance(v, list)], "measure string, value double")


_TERMS = [Smooth("l_quantity"), Smooth("duration_min"), Smooth("hour", 24), Smooth("dow", 7), Linear("l_linenumber")]


def _fares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = positive(_trips(spark, sf_dir), ["l_extendedprice", "l_quantity", "duration_min"])
    return rows.withColumns({"hour": F.hour("l_shipdate"), "dow": day_of_week(F.col("l_shipdate"))})


@query()
def gam_fit(spark, sf_dir):
    """Held-out error of the additive model of the price."""
    rows = stratified_split(_fares(spark, sf_dir).select("l_orderkey", "l_linestatus", "l_extendedprice", *(t.column for t in _TERMS)), "l_linestatus", "l_orderkey", "l_linenumber").persist()
    try:  # ranges, moments and errors read the split once each
        model = Gam(_TERMS, "l_extendedprice").fit(rows.where("split = 'train'"))
        out = agg.regression_metrics(model.transform(rows.where("split = 'valid'")), F.col("l_extendedprice"), F.col("prediction"))
        return spark.createDataFrame([(*out.first(), float(model.lam))], "rmse double, mae double, r2 double, penalty double")
    finally:
        rows.unpersist()


@query()
def gam_partial_dependence(spark, sf_dir):
    model = Gam(_TERMS, "l_extendedprice").fit(_fares(spark, sf_dir), resamples=50, keys=["l_orderkey", "l_linenumber"])
    rows = []
    for i, t in enumerate(_TERMS):
        for a, b in zip(model.partial_dependence(i, 50), model.bootstrap_band(i, 50), strict=True):
            rows.append((t.column, a["x"], a["effect"], a["low"], a["high"], b["low"], b["high"]))
    return spark.createDataFrame(rows, "term string, x double, effect double, low double, high double, boot_low double, boot_high double")


@query()
def gam_by_service(spark, sf_dir):
    models = fit_by_group(_fares(spark, sf_dir), "l_returnflag", [Smooth("l_quantity"), Smooth("duration_min")], "l_extendedprice", ["A", "N", "R"])
    rows = [(g, m.n, m.lam, *(float(x["effect"]) for x in m.partial_dependence(0, 3))) for g, m in models.items()]
    return spark.createDataFrame(rows, "service string, n long, penalty double, low double, middle double, high double")


@query()
def gam_breakdown(spark, sf_dir):
    rows = _fares(spark, sf_dir).select("l_extendedprice", *(t.column for t in _TERMS)).persist(StorageLevel.MEMORY_AND_DISK)
    try:  # ranges, moments and effects read the join once each
        found = Gam(_TERMS, "l_extendedprice").fit(rows).breakdown(rows)
        return spark.createDataFrame(found.collect(), found.schema)  # a row per term
    finally:
        rows.unpersist()


_FEATURES = ["l_quantity", "l_discount", "l_tax", "duration_min"]


@contextmanager
def _classified(spark: SparkSession, sf_dir: str) -> Iterator[DataFrame]:
    """Whether the quantity less its discount is above the median: two of the features tell it, the other two don't.

    The join is persisted meanwhile, as the median, the split and the bins take several passes.
    """
    rows = positive(_trips(spark, sf_dir), ["l_quantity", "duration_min"]).select("l_orderkey", "l_linenumber", *_FEATURES).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        net = F.col("l_quantity") * (1 - F.col("l_discount"))
        yield rows.withColumn("label", (net > exact_quantile(rows.select(net.alias("net")), "net", 0.5)).cast("int"))
    finally:
        rows.unpersist()


@query()
def gbt_accuracy(spark, sf_dir):
    """Held-out accuracy, its bootstrap, and the features' importances."""
    keys = ["l_orderkey", "l_linenumber"]
    with _classified(spark, sf_dir) as rows:
        model, held = evaluate(rows, _FEATURES, "label", keys)
        held = held.select(*keys, "label", "prediction").persist(StorageLevel.MEMORY_AND_DISK)
        boot = accuracy_bootstrap(held, "label", "prediction", keys, 100).first()
        rows = [("accuracy", accuracy(held, "label")), *((f"boot_{k}", float(boot[k])) for k in ("mean", "std", "low", "high")), *importances(model, _FEATURES)]
        held.unpersist()
    return spark.createDataFrame([(a, float(b)) for a, b in rows], "measure string, value double")


@query()
def gbt_profiles(spark, sf_dir):
    """Type of a key from its hours' principal scores and calendar features."""
    # cached: the plan's cells are otherwise copied into every score
    wide = _enriched(proportions(_wide(spark, sf_dir).where("event_type in ('click', 'view')"), HOURS)).persist()
    try:
        model = fit_pca(wide, 5)
        rows = wide.withColumns({f"pc{k + 1}": model.score(k) for k in range(5)}).withColumn("label", (F.col("event_type") == "view").cast("int"))
        features = [f"pc{k + 1}" for k in range(5)] + ["month", "dow", "loc_id", "region"]
        _, held = evaluate(rows, features, "label", KEYS)
        report = agg.classification_report(held, "label", "prediction")
        return spark.createDataFrame(report.collect(), report.schema)  # a row per class
    finally:
        wide.unpersist()


@query()
def gbt_sweep(spark, sf_dir):
    with _classified(spark, sf_dir) as rows:
        rows = sweep(rows, _FEATURES, "label", ["l_orderkey", "l_linenumber"])
    return spark.createDataFrame([(r["depth"], r["rate"], float(r["accuracy"])) for r in rows], "depth int, rate double, accuracy double")
