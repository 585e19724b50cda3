"""Files to wide table and reports, the component suite, streaming, and the driver's contract."""

import json
import os
import struct

import pyarrow as pa
import pytest

import __spark_entry__
from tideline.operators.joins import centroids
from tideline.plans import batch, catalogue, components
from tideline.sources import discovery, readers, shapes, sinks
from tideline.streaming import hourly


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("trips")
    a = [(f"2023-01-{1 + i % 3:02d} {i % 24:02d}:00:00", 1 + i % 2) for i in range(240)] + [("2023-02-01 00:00:00", 1), ("bad", 1)]
    spark.createDataFrame(a, "tpep_pickup_datetime string, PULocationID long").coalesce(1).write.parquet(str(d / "yellow_tripdata_2023-01.parquet"))
    b = [(f"2023-02-01 {i % 24:02d}:30:00", 7.0) for i in range(60)]
    spark.createDataFrame(b, "Pickup_DateTime string, pu_location double").coalesce(1).write.parquet(str(d / "sub" / "green_tripdata_2023-02.parquet"))
    spark.createDataFrame([(1,)], "a long").coalesce(1).write.parquet(str(d / "other_2023-03.parquet"))
    (d / "broken_2023-04.parquet").write_bytes(b"no parquet")
    return str(d)


def test_discovery(spark, files, tmp_path):
    found = discovery.discover(spark, files)
    assert len(found) == 4 and found == sorted(found) and all(os.path.isabs(p) for p in found)
    assert discovery.discover(spark, str(tmp_path)) == []
    with pytest.raises(ValueError, match="does not exist"):
        discovery.discover(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="not a directory"):
        discovery.discover(spark, found[0])
    with pytest.raises(ValueError):
        discovery.discover(spark, "")
    assert discovery.discover_any(spark, f"{found[1]}, {found[0]}") == [found[1], found[0]]
    assert len(discovery.sample_files(found, 2)) == 2 and discovery.sample_files(found, 2) == discovery.sample_files(found, 2)
    names = discovery.column_names(spark, found)
    assert [] in names.values() and ["a"] in names.values()


def test_batch(spark, files, tmp_path):
    out = str(tmp_path / "wide.parquet")
    report = batch.run(spark, files, out, min_rides=30, report_file=str(tmp_path / "report.json"))
    s = report["summary"]
    assert (s["files"], s["errors"], s["input_rows"], s["rows_after_filters"]) == (4, 2, 302, 300)
    assert report["discards"]["parse_fail"] == 1 and report["discards"]["mismatch"] == 1
    wide = spark.read.parquet(out)
    assert s["final_rows"] == wide.count() == 7 and {r.taxi_type for r in wide.collect()} == {"yellow", "green"}
    assert json.loads((tmp_path / "report.json").read_text())["summary"]["final_rows"] == 7
    assert "Month mismatches" in (tmp_path / "report_performance.md").read_text() and "- Output columns: 27" in (tmp_path / "report_performance.md").read_text() and not os.path.exists(out + "_intermediate")
    assert "\\item" in sinks.report_for("x.tex", report)
    assert "N/A" in sinks.summarize_report({})
    sinks.summarize_file(spark, str(tmp_path / "report.json"), str(tmp_path / "s.md"))
    assert "final rows: 7" in (tmp_path / "s.md").read_text()
    sinks.write_wide(wide, str(tmp_path / "months"), by_month=True)
    assert (tmp_path / "months" / "year=2023" / "month=1").exists()
    assert discovery.delete(spark, str(tmp_path / "months")) and not (tmp_path / "months").exists()


def test_components_suite(spark, sf, tmp_path):
    wide = catalogue.QUERIES["hourly_pivot_counts"](spark, sf).withColumnRenamed("place", "pickup_place")
    sinks.write_wide(wide, str(tmp_path / "wide"))
    (tmp_path / "zones.csv").write_text(" LocationID ,Latitude,Longitude\n0,40.1,-73.9\n1,40.2,-73.8\n2,,\n")
    found = components.run(spark, str(tmp_path / "wide"), str(tmp_path / "out"), 5, str(tmp_path / "zones.csv"))
    assert found["stability"]["B"] == 5 and (tmp_path / "out" / "diagnostics.json").exists()
    assert readers.read_csv(spark, str(tmp_path / "out" / "pc_scores")).count() == 5
    assert readers.read_csv(spark, str(tmp_path / "out" / "map_markers")).count() == 2


#: The projection of the public example that ``test_shapes`` recomputes.
TEXAS = 'PROJCS["NAD27 / Texas South Central",GEOGCS["NAD27",DATUM["D",SPHEROID["Clarke_1866",6378206.4,294.9786982]],PRIMEM["Greenwich",0],UNIT["Degree",0.0174532925199433]],PROJECTION["Lambert_Conformal_Conic_2SP"],PARAMETER["False_Easting",2000000],PARAMETER["False_Northing",0],PARAMETER["Central_Meridian",-99],PARAMETER["Standard_Parallel_1",28.383333333333333],PARAMETER["Standard_Parallel_2",30.283333333333333],PARAMETER["Latitude_Of_Origin",27.833333333333333],UNIT["Foot_US",0.3048006096012192]]'


def write_shapes(folder, zones, prj):
    """A shapefile of boxes (key, x0, y0, x1, y1); a box of None is a null shape."""
    records = b""
    for i, (_, *box) in enumerate(zones):
        body = struct.pack("<i", 0) if box[0] is None else struct.pack("<i4d2i", 5, *box, 1, 0) + struct.pack("<i", 0)
        records += struct.pack(">2i", i + 1, len(body) // 2) + body
    (folder / "zones.shp").write_bytes(bytes(100) + records)
    fields = b"".join(struct.pack("<11sc4xBB14x", n, b"C", w, 0) for n, w in ((b"zone", 6), (b"LocationID", 8)))
    rows = b"".join(b" " + b"name  " + str(k).rjust(8).encode() for k, *_ in zones)
    (folder / "zones.dbf").write_bytes(struct.pack("<4BIHH20x", 3, 124, 1, 1, len(zones), 32 + len(fields) + 1, 15) + fields + b"\r" + rows)
    if prj:
        (folder / "zones.prj").write_text(prj)


def test_shapes(spark, tmp_path):
    """The worked example of the projection's public description, null shapes, zones of two shapes, degrees, and what is refused."""
    x, y = 2963503.91, 254759.80
    write_shapes(tmp_path, [(1, x - 10, y - 20, x + 10, y + 20), (2, None), (3, x, y, x, y), (3, x + 100, y, x + 100, y), ("", x, y, x, y)], TEXAS)
    found = {r.LocationID: r for r in centroids(shapes.zone_centres(spark, str(tmp_path / "zones.shp"))).collect()}
    assert set(found) == {1, 3} and abs(found[1].latitude - 28.5) < 1e-6 and abs(found[1].longitude + 96) < 1e-6
    assert 0 < found[3].longitude + 96 < 0.001
    (tmp_path / "plain").mkdir()
    write_shapes(tmp_path / "plain", [(7, -74.0, 40.0, -73.0, 41.0)], 'GEOGCS["WGS84"]')
    assert [tuple(r) for r in shapes.zone_centres(spark, str(tmp_path / "plain" / "zones.shp")).collect()] == [(7, 40.5, -73.5)]
    for name, zones, prj in (("none", [], TEXAS), ("bare", [(1, 0, 0, 1, 1)], None), ("other", [(1, 0, 0, 1, 1)], TEXAS.replace("Lambert", "Albers"))):
        (tmp_path / name).mkdir()
        write_shapes(tmp_path / name, zones, prj)
        with pytest.raises(ValueError):
            shapes.zone_centres(spark, str(tmp_path / name / "zones.shp"))


def test_readers(spark, files):
    trips, errors = readers.read_trips(spark, discovery.discover(spark, files))
    assert trips.columns == readers.CANONICAL and len(errors) == 2 and trips.count() == 302
    assert readers.read_trips(spark, [])[0].collect() == []
    with pytest.raises(ValueError):
        readers.union_sources([("x", None)])
    one = readers.map_batches(trips.select("pickup_place"), lambda b: b, "pickup_place double")
    assert one.count() == 302
    sizes = readers.map_batches(spark.range(0, 1000, 1, 1), lambda b: pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]), "n long", batch_size=300)
    assert [r.n for r in sizes.collect()] == [300, 300, 300, 100]


def test_readers_of_differing_types(spark, tmp_path):
    """Files with the same names and other types are read together, and a damaged file's error doesn't stop the others."""
    rows = [("2023-01-05 10:00:00", 7), ("2023-01-06 11:00:00", 8)]
    df = spark.createDataFrame(rows, "tpep_pickup_datetime string, PULocationID long").coalesce(1)
    df.write.parquet(str(tmp_path / "in" / "yellow_2023-01.parquet"))
    df.selectExpr("cast(tpep_pickup_datetime as timestamp) tpep_pickup_datetime", "cast(PULocationID as double) PULocationID").coalesce(1).write.parquet(str(tmp_path / "in" / "yellow_2023-01b.parquet"))
    whole = next((tmp_path / "in" / "yellow_2023-01.parquet").glob("*.parquet")).read_bytes()
    (tmp_path / "in" / "green_2023-01.parquet").write_bytes(whole[:4] + bytes(40) + whole[44:])
    paths = discovery.discover(spark, str(tmp_path / "in"))
    trips, errors = readers.read_trips(spark, [p for p in paths if "green" not in p])
    assert sorted(r.pickup_place for r in trips.collect()) == [7.0, 7.0, 8.0, 8.0] and not errors
    report = batch.run(spark, str(tmp_path / "in"), str(tmp_path / "wide"), min_rides=1, intermediate_by_month=True)
    assert report["summary"]["input_rows"] >= 4 and report["summary"]["output_columns"][0] == "taxi_type" and len(report["per_file"]) + len(report["errors"]) >= 3


def test_streaming(spark, tmp_path):
    rows = [("a", f"2024-01-01 {h:02d}:{m:02d}:00") for h in (1, 2, 9) for m in (0, 30)] + [("b", "2024-01-01 01:10:00")]
    spark.createDataFrame(rows, "kind string, at string").selectExpr("kind", "cast(at as timestamp) at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("kind string, at timestamp").parquet(str(tmp_path / "in"))
    q = hourly.write_pivot(stream, ["kind"], "at", str(tmp_path / "out"), str(tmp_path / "check"), "1 hour")
    q.awaitTermination(60)
    got = {r.kind: r for r in hourly.widen(spark.read.parquet(str(tmp_path / "out")), ["kind"]).collect()}
    assert got["a"].hour_1 == 2 and got["a"].hour_2 == 2 and got["b"].hour_1 == 1 and got["a"].hour_9 == 0  # hour 9 is still open


def test_contract(spark, sf):
    names, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(names) and len(sql) > 35
    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and out.columns[:3] == ["event_type", "date", "place"]


SMALL = ["hourly_pivot_counts", "combine_wide_table", "fare_clean_p99", "stratified_split_rows", "covariance_matrix", "survival_curve", "classification_report"]


@pytest.mark.parametrize("name", SMALL)
def test_against_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("events", "lineitem", "orders", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = con.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    clean = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    want = sorted((tuple(clean(v) for v in r) for r in cursor.fetchall()), key=str)
    got = sorted((tuple(clean(r[c]) for c in columns) for r in catalogue.QUERIES[name](spark, sf).collect()), key=str)
    assert got == want


def _raw_trips(spark, sf, shift=0.0):
    """Line items as trips with the column names of trip files."""
    trips = catalogue._trips(spark, sf).where("l_shipdate > o_orderdate")
    return trips.selectExpr("o_orderdate as tpep_pickup_datetime", "l_shipdate as tpep_dropoff_datetime", f"l_quantity + {shift} as trip_distance", f"500 + 40 * l_quantity + l_extendedprice / 1000 + {shift} as fare_amount", "cast(l_linenumber as string) as passenger_count", "l_suppkey % 7 as PULocationID")


def test_fares(spark, sf):
    from tideline.plans import fares

    features = fares.fare_features(_raw_trips(spark, sf)).cache()
    assert features.where("fare_amount <= 0 or passenger_count < 1").count() == 0
    scores = spark.createDataFrame([(float(i), i * 0.1, -i * 0.2) for i in range(5)], "pickup_place double, pc1 double, pc2 double")
    scored, used = fares.add_scores(features, scores)
    assert used and scored.where("pc1 is null").count() == 0
    model, metrics, held = fares.fit_fares(scored, True, resamples=3)
    assert metrics.first().r2 > 0.5 and held.where("prediction is null").count() == 0
    zones = spark.createDataFrame([(i, b) for i, b in enumerate(["Manhattan", "Queens", "Bronx", "EWR"])], "locationid int, borough string")
    grid, models = fares.by_borough(fares.add_boroughs(scored, zones))
    assert "Unknown" not in {r.borough for r in grid.collect()} and set(models) == {"Manhattan", "Queens", "Bronx"}
    stats, trend, models = fares.compare_services([("yellow", _raw_trips(spark, sf)), ("green", _raw_trips(spark, sf, 5.0)), ("fhv", None)], 2000)
    assert {r.service for r in stats.collect()} == {r.service for r in trend.collect()} == set(models) == {"yellow", "green"}


def test_classes(spark, sf):
    from tideline.plans import classes

    found = classes.classify_trips({0: _raw_trips(spark, sf), 1: _raw_trips(spark, sf, 60.0)}, 400, trees=3)
    assert found["accuracy"] > 0.9 and found["importances"][0][0] == "trip_distance"
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet").selectExpr("ts as pickup_datetime", "user_id % 5 as pickup_place", "event_type")
    wide = classes.profiles({"yellow": events.where("event_type = 'click'"), "green": events.where("event_type <> 'click'")}, fraction=1.0, min_rides=10)
    found = classes.classify_profiles(wide, trees=2)
    assert 0 <= found["accuracy"] <= 1 and len(found["importances"]) == 10


def test_command_lines_of_fares_and_classes(spark, sf, tmp_path):
    """Both stages from files to files."""
    from tideline.plans import classes, fares

    green, yellow = str(tmp_path / "green"), str(tmp_path / "yellow")
    _raw_trips(spark, sf).write.parquet(green)
    _raw_trips(spark, sf, 60.0).write.parquet(yellow)
    spark.createDataFrame([(i, b) for i, b in enumerate(["Manhattan", "Queens", "Bronx", "EWR"])], "LocationID int, Borough string").write.csv(str(tmp_path / "zones"), header=True)
    fares.main(["--input", green, "--output-dir", str(tmp_path / "out"), "--resamples", "2", "--zones-csv", str(tmp_path / "zones")])
    found = json.loads((tmp_path / "out/fares.json").read_text())
    assert found["r2"] > 0.5 and set(found["bootstrap"]) == set(found["partial_dependence"]) >= {"trip_distance", "hour"} and not found["with_scores"]
    assert set(json.loads((tmp_path / "out/boroughs.json").read_text())) == {"Manhattan", "Queens", "Bronx"}
    assert "trip_distance" in {r["term"] for r in spark.read.csv(str(tmp_path / "out/breakdown"), header=True).collect()}
    classes.main(["--green", green, "--yellow", yellow, "--output-dir", str(tmp_path / "out"), "--rows-per-class", "200", "--trees", "2"])
    told = json.loads((tmp_path / "out/classes.json").read_text())
    assert told["accuracy"] > 0.9 and told["services"] == ["green", "yellow"]


def test_joins_are_made_once(spark, sf):
    """What the queries return doesn't read the tables again, and what they persisted meanwhile is released."""
    from tideline.plans import catalogue

    spark.catalog.clearCache()
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    for name in ("gam_breakdown", "services_compared"):
        out = catalogue.QUERIES[name](spark, sf)
        assert "parquet" not in out._jdf.queryExecution().optimizedPlan().toString().lower(), name
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before
