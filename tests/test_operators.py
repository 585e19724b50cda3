"""Pivot, filters, joins, sampling and statistics on small tables."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tideline.operators import aggregates as A
from tideline.operators import joins as J
from tideline.operators import quantiles as Q
from tideline.operators.filters import cap_sequentially, discards, drop_mismatches
from tideline.operators.pivot import cleanup_stats, combine, combine_with_threshold, low_count_cleanup, pivot_trips, row_breakdown
from tideline.operators.sampling import poisson_weight, sample_balanced, sample_fraction, sample_rows, stratified_split

HOURS = [f"hour_{h}" for h in range(24)]


def trips(spark, rows):
    return spark.createDataFrame(rows, "pickup_datetime string, pickup_location long, taxi_type string")


def test_tiny_pivot(spark):
    rows = [("2023-01-01 00:00:00", 1, "yellow")] * 2 + [("2023-01-01 05:00:00", 1, "yellow"), ("2023-01-01 05:00:00", 2, "yellow"), ("not_a_date", 1, "yellow"), ("2023-01-01 05:00:00", None, "yellow")]
    wide = pivot_trips(trips(spark, rows))
    assert wide.columns == ["taxi_type", "date", "pickup_place", *HOURS]
    got = {r.pickup_place: r for r in wide.collect()}
    assert got[1].hour_0 == 2 and got[1].hour_5 == 1 and got[2].hour_5 == 1 and sum(got[1][h] for h in HOURS) == 3 and got[1].hour_7 == 0
    for c, role in (("pickup_datetime", "pickup datetime"), ("pickup_location", "pickup location"), ("taxi_type", "taxi type")):
        with pytest.raises(ValueError, match=role):
            pivot_trips(trips(spark, rows).drop(c))
    assert pivot_trips(trips(spark, rows).limit(0)).collect() == []


def test_hourly_grid(spark):
    rows = [(f"2023-01-{d:02d} {h:02d}:10:00", z, "yellow") for d in range(1, 6) for h in range(24) for z in (1, 2, 3)]
    got = pivot_trips(trips(spark, rows)).collect()
    assert len(got) == 15 and all(r[h] == 1 for r in got for h in HOURS)


def test_cleanup(spark):
    wide = spark.createDataFrame([("y", 1, 60), ("y", 2, 10), ("y", 3, 50), ("y", 4, 49), ("y", 5, None)], "taxi_type string, place int, hour_0 int")
    assert sorted(r.place for r in low_count_cleanup(wide, 50).collect()) == [1, 3]
    assert tuple(cleanup_stats(wide, 50).first()) == (5, 2, 3, 50)
    plain = wide.drop("hour_0")
    assert low_count_cleanup(plain, 50).count() == 5 and tuple(cleanup_stats(plain, 50).first()) == (5, 5, 0, 50)


def test_two_levels(spark):
    """The threshold holds per file, before the sum."""
    rows = [("a", "k", 1)] * 3 + [("b", "k", 1)] * 2 + [("b", "k", 2)] * 3 + [("c", "m", 0)] * 2
    df = spark.createDataFrame(rows, "file string, key string, h int")
    got = combine_with_threshold(df, "file", ["key"], F.col("h"), 3).collect()
    assert len(got) == 1 and (got[0].hour_1, got[0].hour_2) == (5, 3)
    wide = spark.createDataFrame([("k", 1), ("k", 2), ("m", 3)], "key string, hour_4 long")
    assert {r.key: r.hour_4 for r in combine(wide, ["key"]).collect()} == {"k": 3, "m": 3}
    dates = spark.createDataFrame([(dt.date(2023, 1, 1), "y"), (dt.date(2023, 5, 1), "y")], "date date, taxi_type string")
    assert row_breakdown(dates).first().row_count == 2


def test_month_mismatch(spark):
    days = ["2023-01-15", "2023-01-20", "2023-02-01", "2023-01-10", "2023-12-31", None]
    df = spark.createDataFrame([(d, 2023, 1) for d in days] + [("2020-05-05", None, None)], "d string, y int, m int").withColumn("at", F.col("d").cast("timestamp_ntz"))
    assert drop_mismatches(df, F.col("at"), F.col("y"), F.col("m")).count() == 4
    row = discards(df, F.col("at").isNotNull(), (F.year("at") == F.col("y")) & (F.month("at") == F.col("m"))).first()
    assert tuple(row) == (7, 1, 2, 4)


def test_exact_quantiles(spark, monkeypatch):
    monkeypatch.setattr(Q, "FEW", 5)
    r = random.Random(0)
    values = [r.choice([1.0, 2.0, r.random() * 1e6, -r.random()]) for _ in range(999)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    for q in (0.0, 0.01, 0.5, 0.77, 0.99, 1.0):
        assert Q.exact_quantile(df, "v", q) == pytest.approx(df.agg(F.percentile("v", q)).first()[0], rel=1e-12)
    assert Q.exact_quantile(df.limit(0), "v", 0.5) is None
    ties = spark.createDataFrame([(3.0,)] * 50, "v double")
    assert Q.exact_quantile(ties, "v", 0.3) == 3.0


def test_sequential_caps(spark):
    df = spark.createDataFrame([(float(i), float(200 - i)) for i in range(200)], "a double, b double")
    got = cap_sequentially(df, ["a", "b"], 0.9)
    first = sorted(float(i) for i in range(200))[: int(0.9 * 199) + 1]
    left = [200 - v for v in first]
    limit = statistics.quantiles(sorted(left), n=10, method="inclusive")[8]
    assert got.count() == sum(v <= limit for v in left)


def test_joins(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.5), (None, 3.0)], "k int, pickup_place double")
    zones = spark.createDataFrame([(1, "Q", 5.0)], "k int, name string, score double")
    got = J.enrich(df, zones, "k", {"name": "Unknown"}).collect()
    assert sorted((r.name for r in got), key=str) == ["Q", "Unknown", "Unknown"]
    assert tuple(J.match_rate(df.join(zones, "k", "left"), "score").first()) == (1, 3, pytest.approx(33.333333))
    assert J.with_location_id(df).count() == 2
    filled, used = J.enrich_if_matched(df, zones, "k", ["score"])
    assert used and [r.score for r in filled.collect()] == [5.0] * 3
    same, used = J.enrich_if_matched(df, zones, "k", ["score"], 50)
    assert not used and same.columns == df.columns


def test_sampling(spark):
    df = spark.range(4000).withColumn("y", (F.col("id") % 3).cast("int"))
    once, again = (sample_rows(x, 50, "id").select("id").collect() for x in (df, df.repartition(7)))
    assert {r.id for r in once} == {r.id for r in again} and len(once) == 50
    assert abs(sample_fraction(df, 0.15, "id").count() - 600) < 100
    assert all(r["count"] == 100 for r in sample_balanced(df, "y", 100, "id").groupBy("y").count().collect())
    split = stratified_split(df, "y", "id")
    for r in split.groupBy("y").agg(F.count_if(F.col("split") == "train").alias("t"), F.count("*").alias("n")).collect():
        assert r.t == int(0.8 * r.n)
    w = df.select(*(poisson_weight(b, "id").alias(f"w{b}") for b in range(3))).agg(*(f(F.col(f"w{b}")) for b in range(3) for f in (F.avg, F.var_samp))).first()
    assert all(abs(v - 1) < 0.1 for v in w)


def test_statistics(spark):
    df = spark.createDataFrame([("a", float(i), float(i * i)) for i in range(1, 30)] + [("b", 4.0, 4.0)], "g string, x double, y double")
    row = {r.g: r for r in A.group_stats(df, "g", "x").collect()}["a"]
    assert (row.n, row["mean"], row["median"], row.p25, row.p75) == (29, 15.0, 15.0, 8.0, 22.0)
    cells = {(r.col_a, r.col_b): r["corr"] for r in A.correlations(df.where("g = 'a'"), ["x", "y"]).collect()}
    assert cells["x", "x"] == 1.0 and cells["x", "y"] == cells["y", "x"] > 0.9
    assert sum(r.n for r in A.histogram(df, "x", 7).collect()) == 30
    assert A.histogram(df.where("g = 'b'"), "x", 7).collect()[0].n == 1
    curve = A.survival(df, "x", ["g", "y"]).collect()
    assert sorted(r["rank"] for r in curve) == list(range(1, 31)) and max(r.survival for r in curve) == 1.0
    assert [r.x for r in sorted(curve, key=lambda r: r["rank"])] == sorted((r.x for r in curve), reverse=True)
    assert A.tail_fit(A.survival(df, "x", ["g", "y"])).first().tail_points == 10
    perfect = A.regression_metrics(df, F.col("y"), F.col("y")).first()
    assert tuple(perfect) == (0.0, 0.0, 1.0)
    report = {r["class"]: r for r in A.classification_report(spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "l int, p int"), "l", "p").collect()}
    assert report["accuracy"].f1 == 0.75 and report["1"].recall == 0.5 and report["0"].precision == pytest.approx(2 / 3)
