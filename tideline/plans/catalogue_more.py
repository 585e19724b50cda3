"""Registered queries of operators that the catalogue's pipelines use only inside: samples, fills, labels, resolvers, fixed components."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.columns import common_schema, hour_columns, normalize_classifier, normalize_fares, normalize_trips, pivot_roles
from tideline.functions.paths import month_of
from tideline.functions.scalars import day_name, day_of_week
from tideline.functions.sizes import percent_text, size_of, size_text
from tideline.models.gram import fill_with_means
from tideline.models.pca import Pca, diagnostics, scores_by_place
from tideline.operators import aggregates as agg
from tideline.operators.joins import centroids, enrich, enrich_if_matched, with_location_id
from tideline.operators.pivot import pivot_trips
from tideline.operators.sampling import hash_limit, sample_balanced, sample_fraction, stratified_split
from tideline.plans.catalogue import _H, _MONTH, _PATHS, _W, HOURS, _paths, _wide, query, table

_LINES = ["l_orderkey", "l_linenumber"]
_MD5 = "md5(l_orderkey || '|' || l_linenumber || '|42')"


def _lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*_LINES, *columns)


@query(f"SELECT l_orderkey, l_linenumber, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY {_MD5}, l_orderkey, l_linenumber) AS place FROM lineitem) WHERE place <= 500")
def balanced_sample(spark, sf_dir):
    return sample_balanced(_lines(spark, sf_dir, "l_returnflag"), "l_returnflag", 500, *_LINES)


@query(f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {_MD5} < '{hash_limit(0.15)}'")
def fraction_sample(spark, sf_dir):
    return sample_fraction(_lines(spark, sf_dir), 0.15, *_LINES)


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN row_number() OVER (ORDER BY {_MD5}, l_orderkey, l_linenumber) <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'valid' END AS split FROM lineitem")
def train_valid_split(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("stratum", F.lit(1))
    return stratified_split(rows, "stratum", *_LINES).drop("stratum")


@query("SELECT event_id, round(coalesce(v, avg(v) OVER ()), 6) AS value FROM (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM events)")
def mean_fill(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))
    return fill_with_means(rows, ["value"]).withColumn("value", F.round("value", 6))


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS z FROM lineitem")
def population_z(spark, sf_dir):
    rows = _lines(spark, sf_dir, "l_quantity")
    return rows.select(*_LINES, F.round(agg.standardized(rows, "l_quantity", population=True), 6).alias("z"))


@query("SELECT event_id, place, CAST(place AS INTEGER) AS location_id FROM (SELECT event_id, user_id / 4.0 AS place FROM events) WHERE place % 1 = 0")
def whole_places(spark, sf_dir):
    return with_location_id(table(spark, sf_dir, "events").select("event_id", (F.col("user_id") / 4.0).alias("place")), "place")


@query("SELECT day, count(*) AS n FROM (SELECT CASE isodow(ts) WHEN 1 THEN 'Mon' WHEN 2 THEN 'Tue' WHEN 3 THEN 'Wed' WHEN 4 THEN 'Thu' WHEN 5 THEN 'Fri' WHEN 6 THEN 'Sat' WHEN 7 THEN 'Sun' END AS day FROM events) GROUP BY day")
def weekday_counts(spark, sf_dir):
    return agg.value_counts(table(spark, sf_dir, "events").select(day_name(day_of_week(F.col("ts"))).alias("day")), "day")


@query("SELECT n_nationkey, n_name, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM nation LEFT JOIN (SELECT s_nationkey, avg(s_acctbal) AS latitude, avg(s_suppkey) AS longitude FROM supplier WHERE s_nationkey % 4 <> 0 GROUP BY s_nationkey) ON n_nationkey = s_nationkey")
def zones_with_centroids(spark, sf_dir):
    points = table(spark, sf_dir, "supplier").where("s_nationkey % 4 <> 0")
    found = enrich(table(spark, sf_dir, "nation"), centroids(points, "s_nationkey", "s_acctbal", "s_suppkey").withColumnRenamed("s_nationkey", "n_nationkey"), "n_nationkey")
    return found.select("n_nationkey", "n_name", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))


@query("WITH s AS (SELECT s_suppkey, CAST(s_nationkey / 2.0 AS DOUBLE) AS pickup_place, s_acctbal AS score FROM supplier) SELECT s_suppkey, score, CAST(pickup_place AS INTEGER) AS location_id, coalesce(n_name, 'Unknown') AS zone FROM s LEFT JOIN (SELECT * FROM nation WHERE n_nationkey <> 3) ON n_nationkey = pickup_place WHERE pickup_place % 1 = 0")
def scores_with_zones(spark, sf_dir):
    scores = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") / 2.0).alias("pickup_place"), F.col("s_acctbal").alias("score"))
    zones = table(spark, sf_dir, "nation").where("n_nationkey <> 3").select(F.col("n_nationkey").cast("int").alias("location_id"), F.col("n_name").alias("zone"))
    return enrich(with_location_id(scores), zones, "location_id", {"zone": "Unknown"}).select("s_suppkey", "score", "location_id", "zone")


_GATE = "(SELECT s_suppkey AS k, s_acctbal AS score FROM supplier WHERE s_suppkey % {0} = 0)"


@query(" UNION ALL ".join(f"""SELECT '{name}' AS gate, n, CASE WHEN 100.0 * hit / n >= 10 THEN round(filled, 4) END AS total FROM (SELECT count(*) AS n, count(score) AS hit, sum(coalesce(score, m)) AS filled
FROM (SELECT score, (SELECT quantile_cont(y.score, 0.5) FROM lineitem x JOIN {_GATE.format(part)} y ON x.l_suppkey = y.k) AS m FROM lineitem LEFT JOIN {_GATE.format(part)} ON l_suppkey = k))""" for name, part in (("open", 3), ("shut", 50))))
def match_rate_gate(spark, sf_dir):
    """A lookup that matches a third of the lines is joined and filled with its median; one that matches fewer than a tenth is left out."""
    lines, scores, out = _lines(spark, sf_dir, "l_suppkey"), table(spark, sf_dir, "supplier"), None
    for name, part in (("open", 3), ("shut", 50)):
        lookup = scores.where(F.col("s_suppkey") % part == 0).select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_acctbal").alias("score"))
        rows, used = enrich_if_matched(lines, lookup, "l_suppkey", ["score"])
        total = F.round(F.sum("score"), 4) if used else F.lit(None).cast("double")
        one = rows.agg(F.lit(name).alias("gate"), F.count("*").alias("n"), total.alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'NONE') GROUP BY c_mktsegment HAVING count(*) >= 200")
def groups_with_enough_rows(spark, sf_dir):
    return agg.groups_with_rows(table(spark, sf_dir, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY", "NONE"], 200)


@query("SELECT l_orderkey, l_linenumber, CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS label FROM lineitem")
def encoded_labels(spark, sf_dir):
    return agg.label_encode(_lines(spark, sf_dir, "l_returnflag"), "l_returnflag", "label").select(*_LINES, "label")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice AS y, 900.0 * l_quantity AS guess, round(l_extendedprice - 900.0 * l_quantity, 6) AS residual FROM lineitem")
def residual_rows(spark, sf_dir):
    rows = _lines(spark, sf_dir, "l_extendedprice", "l_quantity").withColumn("g", 900.0 * F.col("l_quantity"))
    return agg.residuals(rows, F.col("l_extendedprice"), F.col("g"), *_LINES).withColumn("residual", F.round("residual", 6))


@query("WITH e AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem), c AS (SELECT l_returnflag, CAST(least(floor((l_extendedprice - a) / (b - a) * 25), 24) AS BIGINT) AS bin, count(*) AS n FROM lineitem, e GROUP BY ALL) SELECT l_returnflag, bin, n, round(n / sum(n) OVER (PARTITION BY l_returnflag), 9) AS share FROM c")
def violin_shares(spark, sf_dir):
    return agg.grouped_histogram(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", 25).withColumn("share", F.round("share", 9))


#: Made-up components, so that what is derived from components can be told in SQL.
_FIXED = Pca(HOURS, [round(1 + 0.137 * h, 3) for h in range(24)], [8.0, 3.0, 1.5], [[round(((h * 7 + k * 5) % 23 - 11) / 32 + h / 1000, 6) for k in range(3)] for h in range(24)], 100, 12.5)
_PLACED = ", ".join("round(avg(" + " + ".join(f"(hour_{h} - {_FIXED.mean[h]}) * ({_FIXED.loadings[h][k]})" for h in range(24)) + f"), 6) AS pc{k + 1}" for k in range(3))


@query(f"WITH {_W} SELECT place, {_PLACED} FROM w GROUP BY place")
def scores_of_fixed_components(spark, sf_dir):
    out = scores_by_place(_wide(spark, sf_dir), _FIXED, "place")
    return out.select("place", *(F.round(f"pc{k + 1}", 6).alias(f"pc{k + 1}") for k in range(3)))


_SCORE = [" + ".join(f"(hour_{h} - {_FIXED.mean[h]}) * ({_FIXED.loadings[h][k]})" for h in range(24)) for k in range(3)]
_LOADED = (
    f"{_W}, s AS (SELECT [" + ", ".join(f"var_pop({x})" for x in _SCORE) + "] AS lam FROM w), "
    + "l AS (SELECT hour, k, v, lam[k] AS lam FROM (VALUES " + ", ".join(f"('{HOURS[h]}', {k + 1}, CAST({_FIXED.loadings[h][k]} AS DOUBLE))" for h in range(24) for k in range(3)) + ") t(hour, k, v), s)"
)
_PART = "c AS (SELECT hour, sum(v * v * lam) AS total FROM l GROUP BY hour), z AS (SELECT hour, total, (total - avg(total) OVER ()) / stddev_pop(total) OVER () AS z FROM c)"


def _measured(spark: SparkSession, sf_dir: str) -> Pca:
    """The fixed components with the variances that their scores have in the wide table, largest first."""
    found = _wide(spark, sf_dir).agg(*(F.var_pop(_FIXED.score(k)).alias(f"v{k}") for k in range(3))).first()
    order = sorted(range(3), key=lambda k: -found[k])
    return replace(_FIXED, variances=[found[k] for k in order], loadings=[[row[k] for k in order] for row in _FIXED.loadings])


@query(f"WITH {_LOADED}, {_PART} SELECT hour, round(total, 6) AS total, round(z, 6) AS z, abs(z) > 2 AS outlier FROM z")
def contributions_of_fixed_components(spark, sf_dir):
    """Each hour's part in the variance that the fixed components have in the wide table."""
    rows = [(h, round(c["total"], 6), round(c["z"], 6), c["outlier"]) for h, c in diagnostics(_measured(spark, sf_dir))["contribution"].items()]
    return spark.createDataFrame(rows, "hour string, total double, z double, outlier boolean")


@query(f"""WITH {_LOADED}, {_PART}, d AS (SELECT DISTINCT k, lam FROM l), g AS (SELECT max(abs(s - CASE WHEN i = j THEN 1 ELSE 0 END)) AS o FROM (SELECT a.k AS i, b.k AS j, sum(a.v * b.v) AS s FROM l a JOIN l b ON a.hour = b.hour GROUP BY a.k, b.k))
SELECT arg_max(hour, total) AS peak_hour, arg_min(hour, total) AS quiet_hour, (SELECT round(max(lam) / min(lam), 6) FROM d) AS condition_number, (SELECT round(sum(lam) * sum(lam) / sum(lam * lam), 6) FROM d) AS effective_rank,
(SELECT count(*) FROM d WHERE lam / (SELECT max(lam) FROM d) > 1.0 / 24) AS kaiser, (SELECT round(o, 9) FROM g) AS orthogonality FROM c""")
def summary_of_fixed_components(spark, sf_dir):
    d = diagnostics(_measured(spark, sf_dir))
    row = (d["peak_hour"], d["quiet_hour"], round(d["condition_number"], 6), round(d["effective_rank"], 6), d["kaiser"], round(d["orthogonality"], 9))
    return spark.createDataFrame([row], "peak_hour string, quiet_hour string, condition_number double, effective_rank double, kaiser long, orthogonality double")


@query("SELECT l_shipdate AS pickup_datetime, l_shipdate AS dropoff_datetime, l_quantity AS trip_distance, l_extendedprice AS fare_amount, l_linenumber AS passenger_count, l_suppkey AS pickup_location FROM lineitem")
def fare_columns(spark, sf_dir):
    names = {"surcharge_fare": "l_discount", "Trip_Pickup_DateTime": "l_shipdate", "trip_dropoff_datetime": "l_shipdate", "trip_dist": "l_quantity", "fare_amt": "l_extendedprice", "pax_count": "l_linenumber", "pickup_place": "l_suppkey"}
    lines = table(spark, sf_dir, "lineitem")
    return normalize_fares(lines.select(*(F.col(c).alias(n) for n, c in names.items())))


@query("SELECT l_shipdate AS raw_pickup_datetime, l_shipdate AS raw_dropoff_datetime, l_quantity AS trip_distance, l_linenumber AS passenger_count, CAST(1 AS INTEGER) AS taxi_type_int FROM lineitem")
def classifier_columns(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return normalize_classifier(lines.select(F.col("l_shipdate").alias("lpep_pickup_datetime"), F.col("l_shipdate").alias("lpep_dropoff_datetime"), F.col("l_quantity").alias("trip_distance"), F.col("l_linenumber").alias("passenger_count")), 1)


#: Headers that tables of trips come with, for a datetime, a place and two measures.
_HEADERS = [
    ("ids", ["tpep_pickup_datetime", "PULocationID", "VendorID", "amount"]),
    ("known names", ["PickupDateTime", "pickup_place", "pickup_location", "amount"]),
    ("column order", ["pickup_datetime", "pickup_zone", "pickup_location_id", "amount"]),
    ("patterns", ["Trip_Pickup_DateTime", "pu_location", "do_location", "amount"]),
    ("coordinates", ["pickup_datetime", "pickup_longitude", "pickup_latitude", "amount"]),
    ("start", ["start_lat", "Start_Location_ID", "vendor", "amount"]),
]


@query(" UNION ALL ".join(f"SELECT '{n}' AS kind, event_type, count(*) AS n, " + ("max(ts)" if n != "start" else "CAST(NULL AS TIMESTAMP)") + " AS last, count(DISTINCT user_id) AS places FROM events GROUP BY event_type" for n, _ in _HEADERS))
def resolved_columns(spark, sf_dir):
    """Events under several tables' headers: rows, last datetime and places, by the columns that are resolved."""
    e, out = table(spark, sf_dir, "events"), None
    for kind, (at, place, *more) in _HEADERS:
        rows = e.select(F.col("ts").alias(at), F.col("user_id").alias(place), *(F.lit(-1).alias(c) for c in more), "event_type")
        roles = pivot_roles([at, place, *more])
        last = F.max(roles["datetime"]) if roles["datetime"] else F.lit(None)
        one = rows.groupBy("event_type").agg(F.count("*").alias("n"), last.cast(rows.schema[at].dataType).alias("last"), F.count_distinct(roles["location"]).alias("places")).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out.select("kind", "event_type", "n", "last", "places")


@query("SELECT 'events' AS source, CAST(ts AS DATE) AS day, user_id AS place, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'orders', CAST(o_orderdate AS DATE), o_custkey, count(*) FROM orders GROUP BY ALL")
def common_columns(spark, sf_dir):
    """Two tables of differing headers under the names that they have in common."""
    parts = {
        "events": table(spark, sf_dir, "events").select(F.col("ts").alias("tpep_pickup_datetime"), F.col("user_id").alias("pickup_zone"), F.lit(1).alias("hour_10"), F.lit(1).alias("hour_2")),
        "orders": table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("pickup_datetime"), F.col("o_custkey").alias("pickup_zone"), F.lit(1).alias("x")),
    }
    found, out = common_schema({n: df.columns for n, df in parts.items()}), None
    for name, df in parts.items():
        rows = normalize_trips(df, {**found, "datetime": df.columns[0], "location": df.columns[1]})
        assert hour_columns(df.columns) == (["hour_2", "hour_10"] if name == "events" else [])
        one = rows.groupBy(F.to_date(rows.columns[0]).alias("day"), F.col(rows.columns[1]).alias("place")).agg(F.count("*").alias("n")).withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("source", "day", "place", "n")


_UNIT = "CASE WHEN n >= 1048576 THEN 2 WHEN n >= 1024 THEN 1 ELSE 0 END"


@query(f"""WITH g AS (SELECT source, lang, CAST(sum(strlen(text)) AS BIGINT) AS n FROM documents GROUP BY ALL), t AS (SELECT *, {_UNIT} AS u, sum(n) OVER (PARTITION BY source) AS whole FROM g),
s AS (SELECT *, CASE WHEN u = 0 THEN n || 'B' ELSE printf('%.2f', n / pow(1024, u)) || ['KB', 'MB'][u] END AS size FROM t)
SELECT source, lang, n AS bytes, size, CASE WHEN u = 0 THEN n ELSE CAST(floor(CAST(printf('%.2f', n / pow(1024, u)) AS DOUBLE) * pow(1024, u)) AS BIGINT) END AS again, printf('%.2f', 100.0 * n / whole) || '%' AS share FROM s""")
def size_texts(spark, sf_dir):
    """Bytes of texts by source and language, as text, read back, and as a share of the source's."""
    d = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.sum(F.octet_length("text")).alias("bytes"))
    whole = F.sum("bytes").over(Window.partitionBy("source"))
    out = d.withColumns({"size": size_text(F.col("bytes")), "share": percent_text(F.col("bytes"), whole)})
    return out.select("source", "lang", "bytes", "size", size_of(F.col("size")).alias("again"), "share")


@query(f"SELECT s.y AS year, s.m AS month, count(DISTINCT path) AS files FROM (SELECT path, {_MONTH} AS s FROM {_PATHS}) GROUP BY ALL")
def files_by_month(spark, sf_dir):
    """Distinct paths by the month that they name."""
    paths = _paths(spark, sf_dir).select("path").distinct()
    year, month = month_of(F.col("path"))
    return paths.groupBy(year.alias("year"), month.alias("month")).agg(F.count("*").alias("files"))


@query(f"SELECT event_type AS taxi_type, CAST(ts AS DATE) AS date, user_id AS pickup_place, {_H} FROM events GROUP BY event_type, CAST(ts AS DATE), user_id")
def pivot_of_trips(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("string").alias("pickup_datetime"), F.col("user_id").alias("pickup_location"), F.col("event_type").alias("taxi_type"))
    return pivot_trips(rows)
