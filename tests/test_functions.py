"""Resolvers, path inference, sizes and scalar expressions."""

import pytest
from pyspark.sql import functions as F

from tideline.functions import columns as C
from tideline.functions import paths as P
from tideline.functions import scalars as S
from tideline.functions.sizes import format_size, parse_size, percent, scan_conf


@pytest.mark.parametrize("names,datetime,location", [
    (["VendorID", "tpep_pickup_datetime", "tpep_dropoff_datetime", "fare_amount"], "tpep_pickup_datetime", None),
    (["vendor_id", "pickup_datetime", "dropoff_datetime"], "pickup_datetime", None),
    (["vendor", "PickupDateTime", "Amount"], "PickupDateTime", None),
    (["pickup_time_date", "dropoff_time_date"], None, None),
    (["VendorID", "PULocationID", "DOLocationID", "fare_amount"], None, "PULocationID"),
    (["pu_location", "do_location", "trip_distance"], None, "pu_location"),
    (["pickup_zone", "dropoff_zone", "fare"], None, "pickup_zone"),
    (["vendor_id", "trip_distance", "fare_amount"], None, None),
    (["pickup_longitude", "pickup_latitude"], None, "pickup_longitude"),
    ([" PU Location ID ", 7, None], None, " PU Location ID "),
    (["pickup_zone", "pickup_location_id"], None, "pickup_zone"),
    (["pickup_zone", "PULocationID"], None, "PULocationID"),
    (["vendor", "pickup_place"], None, "pickup_place"),
    (["start_location_id"], None, "start_location_id"),
    (["trip_pickup_location"], None, "trip_pickup_location"),
    (["Start_Lat", "Start_Lon"], None, None),
    (["pickup_flat_rate", "pickup_latitude"], None, "pickup_latitude"),
])
def test_columns(names, datetime, location):
    assert C.find_datetime_column(names) == datetime
    assert C.find_location_column(names) == location
    if location in ("pickup_latitude", "pickup_longitude"):
        assert C.find_location_column(names, strict=True) is None


def test_common_schema_and_normalize(spark):
    found = C.common_schema({"a": ["x"], "b": ["pickup_datetime", "x"], "c": ["tpep_pickup_datetime", "PULocationID"]})
    assert found == {"datetime": "pickup_datetime", "location": "PULocationID", "taxi_type": None}
    df = spark.createDataFrame([("t", 1)], "tpep_pickup_datetime string, PULocationID int")
    assert C.normalize_trips(df, C.pivot_roles(df.columns)).columns == ["pickup_datetime", "pickup_location"]
    with pytest.raises(ValueError, match="taxi type"):
        C.normalize_trips(df, {"taxi_type": "kind"})
    fares = spark.createDataFrame([(1, 1, 1, 1, 1)], "lpep_pickup_datetime int, lpep_dropoff_datetime int, Trip_Distance int, fare_amount int, other int")
    assert C.normalize_fares(fares).columns == ["pickup_datetime", "dropoff_datetime", "trip_distance", "fare_amount"]
    other = spark.createDataFrame([(1,) * 9], "trip_pickup_datetime int, dropoff_datetime int, trip_dist int, fare_amt int, pax_count int, pickup_place int, surcharge_fare_x int, passenger_name int, fare int")
    assert C.normalize_fares(other).columns == ["pickup_datetime", "dropoff_datetime", "trip_distance", "fare_amount", "passenger_count", "pickup_location"]
    with pytest.raises(ValueError, match="fare_amount"):
        C.normalize_fares(fares.drop("fare_amount"))
    assert C.normalize_classifier(fares, 1).columns[:2] == ["raw_pickup_datetime", "raw_dropoff_datetime"]
    assert C.hour_columns(["hour_10", "hour_2", "x", "hour_x"]) == ["hour_2", "hour_10"]


@pytest.mark.parametrize("path,month,kind,legacy", [
    ("yellow_tripdata_2023-01.parquet", (2023, 1), "yellow", "yellow"),
    ("/data/2023-06/file.parquet", (2023, 6), None, None),
    ("s3://bucket/year=2023/month=05/data.parquet", (2023, 5), None, None),
    ("year=2023/month=5/x", (2023, 5), None, None),
    ("data_202312.parquet", (2023, 12), None, None),
    ("data_2023-13.parquet", None, None, None),
    ("data_2023-00.parquet", None, None, None),
    ("2022-12_data_2023-01.parquet", (2022, 12), None, None),
    ("YELLOW_data.parquet", None, "yellow", "yellow"),
    ("fhvhv_tripdata.parquet", None, "fhvhv", "fhv"),
    ("uber_data.parquet", None, None, None),
])
def test_paths(spark, path, month, kind, legacy):
    assert P.infer_month(path) == month and P.infer_taxi_type(path) == kind and P.infer_taxi_type(path, True) == legacy
    year, m = P.month_of(F.lit(path))
    row = spark.range(1).select(year, m, P.taxi_type_of(F.lit(path)), P.taxi_type_of(F.lit(path), True)).first()
    assert tuple(row) == (*(month or (None, None)), kind, legacy)


def test_path_kinds():
    assert P.is_s3_path("s3://b") and P.is_s3_path("S3://b") and P.is_s3_path("s3a://b") and not P.is_s3_path("C:\\x") and not P.is_s3_path("s3a://b", legacy=True)
    assert P.storage_options("s3://b")["anon"] is True and P.storage_options("/x") == {}
    assert P.hadoop_path("S3://b/c") == "s3a://b/c" and "Anonymous" in str(P.anonymous_conf("s3://b"))
    months = P.group_by_month(["x", "b_2023-02", "a_2023-01", "c_2023-02"])
    assert list(months) == [(2023, 1), (2023, 2), (None, None)] and months[2023, 2] == ["b_2023-02", "c_2023-02"]


@pytest.mark.parametrize("text,n", [("200MB", 200 << 20), ("1.5GB", 3 << 29), ("1024KB", 1 << 20), ("1000B", 1000), ("2tb", 2 << 40), ("0.5GB", 1 << 29), (" 200 MB ", 200 << 20)])
def test_sizes(text, n):
    assert parse_size(text) == n


@pytest.mark.parametrize("text", ["invalid", "200XX", "", "0MB", "-1MB"])
def test_bad_sizes(text):
    with pytest.raises(ValueError):
        parse_size(text)


def test_size_text():
    assert [format_size(n) for n in (0, 512, 1024, 1536, 3 << 40, 5000 << 40)] == ["0B", "512B", "1.00KB", "1.50KB", "3.00TB", "5000.00TB"]
    for s in ("50MB", "1GB", "1.5GB", "100KB"):
        assert abs(parse_size(format_size(parse_size(s))) - parse_size(s)) <= 10
    assert percent(1, 0) == "N/A" and percent(1, 4) == "25.00%"
    assert scan_conf("64MB")["spark.sql.files.maxPartitionBytes"] == str(64 << 20)


def test_scalars(spark):
    df = spark.createDataFrame([("2024-01-01 05:00:00", "7.5"), ("not_a_date", "x"), (None, "NaN")], "t string, v string")
    rows = df.select(S.to_datetime(F.col("t")).alias("t"), S.to_number(F.col("v")).alias("v")).select("t", "v", S.day_of_week(F.col("t")).alias("d"), S.day_name(S.day_of_week(F.col("t"))).alias("n")).collect()
    assert [r.v for r in rows] == [7.5, None, None] and [r.d for r in rows] == [0, None, None] and rows[0].n == "Mon"
    nums = spark.createDataFrame([(1.0,), (2.5,), (None,)], "x double")
    assert [r[0] for r in nums.select(S.location_id(F.col("x"))).collect()] == [1, None, None]
    assert [r[0] for r in nums.select(S.quantile_bin(F.col("x"), [1.0, 1.0, 2.0, 3.0])).collect()] == [0, 1, None]
    assert [r[0] for r in nums.select(S.fill_and_clip(F.col("x"), 0.5)).collect()] == [1.0, 2.5, 1.0]
    text, radius = S.colour(F.lit(5.0), F.lit(5.0), F.lit(5.0))
    assert tuple(nums.select(text, radius).first()) == ("#7f0080", 6.0)
    wide = S.proportions(spark.createDataFrame([(0, 0), (1, 3), (None, 2)], "a int, b int"), ["a", "b"]).collect()
    assert [tuple(r) for r in wide] == [(0.0, 0.0), (0.25, 0.75), (0.0, 1.0)]
