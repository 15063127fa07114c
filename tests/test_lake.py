import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from fareframe.operators import quality
from fareframe.plans import external, ingest, mart
from fareframe.sources import dims, lake

SCHEMA = """hvfhs_license_num string, pickup_datetime timestamp_ntz, dropoff_datetime timestamp_ntz, PULocationID int,
  DOLocationID int, trip_miles double, trip_time int, base_passenger_fare double, driver_pay double, tolls double"""


@pytest.fixture
def trips(spark):
    rows = []
    for m in (1, 2):
        for i in range(200):
            t = dt.datetime(2024, m, 1 + i % 28, i % 24, 0)
            code = " hv0003" if i % 10 else "HV0005"
            pay = 30.0 if i % 20 == 1 else 10.0 + i / 100
            rows.append((code, t, t + dt.timedelta(minutes=10), 1 + i % 3, 1 + i % 2, 2.0, 600, 20.0, pay, 0.5))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def zones(spark):
    return spark.createDataFrame(
        [(1, "Manhattan", "M", "Yellow"), (2, "Queens", "Q", "Airports"), (3, "Bronx", "B", "Boro")],
        "LocationID int, Borough string, Zone string, service_zone string",
    )


def test_partial_overwrite_keeps_other_months(spark, trips, tmp_path):
    path = str(tmp_path / "lake")
    df = ingest.prepare_trips(trips)
    lake.write_partitioned(df, path)
    lake.write_partitioned(df.where("month = 2").limit(5), path)
    counts = {r["month"]: r["count"] for r in spark.read.parquet(path).groupBy("month").count().collect()}
    assert counts == {1: 200, 2: 5}
    assert [tuple(r) for r in lake.list_partitions(spark, path).collect()] == [(2024, 1), (2024, 2)]
    plan = lake.read_lake(spark, path, [2024], [1])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "month" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_path_probes(spark, trips, tmp_path):
    base = str(tmp_path)
    trips.write.parquet(f"{base}/year=2024/month=7")
    assert lake.month_available(spark, base, 2024, 7) and not lake.month_available(spark, base, 2024, 8)
    assert lake.read_month(spark, base, 2024, 7).count() == 400
    assert lake.read_first_of(spark, [f"{base}/none", f"{base}/year=2024"]).count() == 400
    assert lake.feature_availability(spark, {"a": f"{base}/year=2024", "b": f"{base}/b"}) == {"a": True, "b": False}
    with pytest.raises(FileNotFoundError):
        lake.first_existing(spark, [f"{base}/none"])
    (tmp_path / "year=2024" / "notes.txt").write_text("not parquet")
    assert lake.read_parquet_tree(spark, base).count() == 400


def test_reports_and_thresholds(spark, trips, tmp_path):
    lake.write_report(trips.groupBy("PULocationID").count(), str(tmp_path / "r"))
    files = [f for f in os.listdir(tmp_path / "r_csv") if f.endswith(".csv")]
    assert len(files) == 1 and (tmp_path / "r_csv" / files[0]).read_text().startswith("PULocationID,count")
    table = quality.thresholds(trips, {"trip_miles": {"method": "iqr"}, "driver_pay": {"method": "percentile"}})
    lake.write_thresholds(table, str(tmp_path / "t"), generated_from="test")
    assert lake.read_thresholds(spark, str(tmp_path / "t")) == quality.threshold_values(table)
    part = next(f for f in os.listdir(tmp_path / "t") if f.endswith(".json"))
    assert json.loads((tmp_path / "t" / part).read_text())["generated_from"] == "test"


def test_feature_sets_and_backfill(spark, trips, tmp_path):
    base = str(tmp_path)
    trips.write.parquet(f"{base}/weather/year=2024/month=01")
    trips.limit(7).write.parquet(f"{base}/weather/year=2024/month=02")
    assert lake.load_features(spark, base, "weather").count() == 407
    assert lake.load_features(spark, base, "weather", 2024, 2).count() == 7
    sources = [f"{base}/weather/year=2024/month=0{m}" for m in (1, 2)]
    assert ingest.backfill(spark, sources, f"{base}/raw") == 407
    assert spark.read.parquet(f"{base}/raw").where("month = 2").count() >= 200


def test_schema_drift_over_paths(spark, trips, tmp_path):
    trips.write.parquet(str(tmp_path / "a"))
    trips.drop("tolls").write.parquet(str(tmp_path / "b"))
    got = lake.lake_schema_drift(spark, {"a": str(tmp_path / "a"), "b": str(tmp_path / "b")}, trips.columns).collect()
    assert [tuple(r) for r in got] == [("b", "tolls", "")]


def test_dimension_files(spark, tmp_path):
    (tmp_path / "z.csv").write_text("LocationID,Borough,Zone,service_zone\n1,A,a,x\n1,A,a,x\nx,B,b,y\n2,B,b,y\n")
    assert sorted(r["LocationID"] for r in dims.read_zone_dim(spark, str(tmp_path / "z.csv")).collect()) == [1, 2]
    (tmp_path / "c.csv").write_text("LocationID,in_cbd\n1,1\n2,0\n")
    assert [r["LocationID"] for r in dims.read_flag_dim(spark, str(tmp_path / "c.csv")).collect()] == [1]
    (tmp_path / "h.csv").write_text("date,holiday_name\n2024-01-01,New Year\n2024-01-01,Again\nbad,None\n")
    assert [tuple(r) for r in dims.read_holiday_dim(spark, str(tmp_path / "h.csv")).collect()] == [(dt.date(2024, 1, 1), "Again")]
    (tmp_path / "w.csv").write_text("STATION,DATE,TMAX\nS,2024-01-01,50\n")
    row = dims.read_weather_raw(spark, str(tmp_path / "w.csv")).first()
    assert (row["TMAX"], row["WT08"]) == ("50", None)


def test_ingest_counts_and_normalises(spark, trips, tmp_path):
    assert ingest.ingest_trips(trips, str(tmp_path / "raw")) == 400
    back = spark.read.parquet(str(tmp_path / "raw"))
    assert {r[0] for r in back.select("hvfhs_license_num").distinct().collect()} == {"HV0003", "HV0005"}
    nulled = {}
    text = trips.withColumn("driver_pay", F.when(F.col("driver_pay") > F.lit(0), F.lit("oops")).otherwise(F.col("driver_pay").cast("string")))
    want = trips.where("driver_pay > 0").count()
    ingest.ingest_trips(text, str(tmp_path / "bad"), nulled)
    assert nulled == {"driver_pay": want} and want > 0
    trips.write.parquet(str(tmp_path / "in"))
    states = ingest.ingest_each(spark, {(2024, 1): str(tmp_path / "in"), (2024, 9): str(tmp_path / "gone")}, str(tmp_path / "each"))
    assert [s["status"] for s in states] == ["success", "failed"]


def test_month_mart(spark, trips, zones, tmp_path):
    days = spark.createDataFrame([(dt.date(2024, 1, d), float(d)) for d in range(1, 29)], "weather_date date, temp_avg_calculated double")
    src = mart.Sources(ingest.prepare_trips(trips).drop("ingest_ts"), zones=zones, weather=days)
    built = mart.build_month(src, 2024, 1)
    got = built.trips
    assert got.count() == 170 and got.where("temp_avg_calculated is null or PU_Borough is null").count() == 0
    r = built.funnel.first()
    assert (r["raw_count"], r["provider_count"], r["quality_count"], r["final_rows"]) == (200, 180, 180, 170)
    low, high = built.bounds.select("winsor_low", "winsor_high").first()
    ends = got.agg(F.min("commission"), F.max("commission")).first()
    assert (ends[0], ends[1]) == (low, high) and r["winsor_low"] == low
    assert got.where("abs(commission_per_mile - commission / 2) > 1e-12").count() == 0
    assert "tolls" not in got.columns and built.joined["zones"]


def test_sampled_mart_agrees_with_its_funnel(spark, trips, zones):
    src = mart.Sources(ingest.prepare_trips(trips).drop("ingest_ts"), zones=zones)
    built = mart.build_month(src, 2024, 2, mart.Settings(sample_fraction=0.5))
    funnel = built.funnel.first()
    assert built.trips.count() == funnel["final_rows"] < 170


def test_batch_isolates_failures(spark, trips, zones, tmp_path):
    src = mart.Sources(ingest.prepare_trips(trips).drop("ingest_ts"), zones=zones)
    reports = str(tmp_path / "reports")
    states = mart.run_batch(src, [(2024, 1), (2023, 1), (2024, 2)], str(tmp_path / "mart"), reports=reports)
    assert [s["status"] for s in states] == ["success", "skipped", "success"]
    assert spark.read.parquet(str(tmp_path / "mart")).count() == 340
    cover = spark.read.parquet(f"{reports}/coverage").where("column = 'PU_Borough'").collect()
    assert [(r["year"], r["month"], r["coverage_pct"]) for r in cover] == [(2024, 1, 100.0), (2024, 2, 100.0)]
    assert spark.read.parquet(f"{reports}/removal_summary").count() == 2
    assert states[0]["bounds"] is not None and states[0]["rows"] == 170
    bad = mart.run_batch(src, [(2024, 1)], str(tmp_path / "mart2"), mart.Settings(require=["weather"]))
    assert bad[0]["status"] == "failed" and "weather" in bad[0]["error"]


def test_external_builds(spark, zones, tmp_path):
    cbd = spark.createDataFrame([(1,)], "LocationID int")
    assert external.build_spatial(zones, cbd, str(tmp_path / "od")).count() == 9
    manifest = spark.read.json(str(tmp_path / "od_manifest")).first()
    assert (manifest["rows"], manifest["feature_count"]) == (9, 14)
    with pytest.raises(Exception, match="repeated key"):
        external.build_spatial(zones.unionByName(zones), cbd, str(tmp_path / "od2"))
    holidays = spark.createDataFrame([(dt.date(2024, 1, 1), "New Year")], "holiday_date date, holiday_name string")
    grid = external.build_temporal(spark, "2024-01-30", "2024-02-02", holidays, str(tmp_path / "cal"))
    assert grid.count() == 96 and grid.where("month = 2").count() == 48
    raw = spark.createDataFrame(
        [("A", "2024-01-01", "50", "32"), ("B", "2024-01-01", "60", "40"), ("C", "2024-01-02", "60", "40")],
        "STATION string, DATE string, TMAX string, TMIN string",
    )
    (tmp_path / "w").mkdir()
    raw.write.option("header", True).csv(str(tmp_path / "w" / "csv"))
    full = dims.read_weather_raw(spark, str(tmp_path / "w" / "csv"))
    built = external.build_weather(full, str(tmp_path / "wx"), "imperial", ["A", "B"], [2024])
    assert built.count() == 1


def test_scratch_dir_uses_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    one, two = lake.scratch_dir(spark, "x"), lake.scratch_dir(spark, "x")
    assert one != two
    base = shared or f"{spark.conf.get('spark.sql.warehouse.dir')}/fareframe-scratch"
    assert one.startswith(f"{base.rstrip('/')}/x-")
