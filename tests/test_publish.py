import datetime as dt
import glob

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fareframe.plans import ingest, mart, publish
from fareframe.sources import footers, lake
from tests.test_lake import SCHEMA


def month_rows(month, n=120, code="HV0003"):
    start = dt.datetime(2024, month, 1)
    return [(code, start + dt.timedelta(hours=i), start + dt.timedelta(hours=i, minutes=10), 1 + i % 3, 1 + i % 2, 2.0, 600, 20.0, 10.0 + i / 100, 0.5) for i in range(n)]


@pytest.fixture
def folders(spark, tmp_path):
    """Month 1 is sound, 2 breaks off behind its footer, 3 has no footer, 4 lacks a column, 5 has other types and
    columns, 6 doesn't exist."""
    base = tmp_path / "source"
    for m in (1, 2, 3, 4, 5):
        df = spark.createDataFrame(month_rows(m), SCHEMA)
        if m == 4:
            df = df.drop("driver_pay")
        if m == 5:
            df = df.withColumn("trip_time", F.col("trip_time").cast("double")).withColumn("PULocationID", F.col("PULocationID").cast("bigint")).withColumn("more", F.lit("x")).drop("tolls")
        df.repartition(2).write.parquet(str(base / f"m{m}"))
    broken = sorted(glob.glob(str(base / "m2" / "*.parquet")))[0]
    with open(broken, "r+b") as f:
        f.seek(4)
        f.write(b"\xff" * 300)
    with open(sorted(glob.glob(str(base / "m3" / "*.parquet")))[0], "r+b") as f:
        f.truncate(200)
    return {(2024, m): str(base / f"m{m}") for m in range(1, 7)}


def counts(spark, path):
    return {(r.year, r.month): r["count"] for r in spark.read.parquet(path).groupBy("year", "month").count().collect()}


def test_a_bad_month_stops_no_other(spark, folders, tmp_path):
    path = str(tmp_path / "mart")
    old = spark.createDataFrame(month_rows(2, 7), SCHEMA).withColumns({"year": F.lit(2024), "month": F.lit(2)})
    lake.write_partitioned(old, path)
    states = {s["month"]: s for s in mart.run_months(spark, folders, path, reports=str(tmp_path / "reports"))}
    assert {m: s["status"] for m, s in states.items()} == {1: "success", 2: "failed", 3: "failed", 4: "failed", 5: "success", 6: "failed"}
    assert "of 120 rows could be read" in states[2]["error"] and "driver_pay" in states[4]["error"]
    assert counts(spark, path) == {(2024, 1): 120, (2024, 2): 7, (2024, 5): 120}
    assert "commission" not in spark.read.parquet(f"{path}/year=2024/month=2").columns
    told = {(r.month, r.status, r.rows) for r in publish.publications(spark, path).collect()}
    assert told == {(1, "success", 120), (5, "success", 120), *[(m, "failed", None) for m in (2, 3, 4, 6)]}
    assert {r.month for r in spark.read.parquet(str(tmp_path / "reports" / "coverage")).collect()} == {1, 5}
    assert not glob.glob(f"{path}/_staging/*") and not glob.glob(f"{path}/_replaced/*")
    again = mart.run_months(spark, {(2024, 1): folders[2024, 5]}, path)  # its pickups are of May: all count as January's
    assert again[0]["status"] == "success" and counts(spark, path)[2024, 1] == 120


def test_jobs_run_for_all_months_at_once(spark, folders, tmp_path):
    good = {m: folders[m] for m in ((2024, 1), (2024, 5))}
    counter = spark.sparkContext.statusTracker()

    def jobs(months, name):
        spark.sparkContext.setJobGroup(name, name)
        mart.run_months(spark, months, str(tmp_path / name), settings=mart.Settings(winsorize=False))
        return len(counter.getJobIdsForGroup(name))

    one, both = jobs({(2024, 1): folders[2024, 1]}, "one"), jobs(good, "both")
    spark.sparkContext.setJobGroup("rest", "rest")
    assert both <= one + 6  # listing and schema of one more folder, no job per month of the mart


def test_a_month_that_breaks_the_job_is_found(spark, tmp_path):
    df = spark.createDataFrame([r for m in (1, 2, 3, 4) for r in month_rows(m, 20)], SCHEMA)
    df = df.withColumns({"year": F.year("pickup_datetime"), "month": F.month("pickup_datetime")})
    bad = F.when(F.col("month") == 3, F.raise_error(F.lit("broken month")).cast("double")).otherwise(F.col("driver_pay"))
    states = mart.run_batch(mart.Sources(df.withColumn("driver_pay", bad)), [(2024, m) for m in (1, 2, 3, 4)], str(tmp_path / "mart"))
    assert [s["status"] for s in states] == ["success", "success", "failed", "success"]
    assert counts(spark, str(tmp_path / "mart")) == {(2024, m): 20 for m in (1, 2, 4)}


def test_ingest_sets_bad_months_aside(spark, folders, tmp_path):
    path = str(tmp_path / "raw")
    stray = spark.createDataFrame([*month_rows(5, 3), *month_rows(9, 2)], SCHEMA)
    stray.write.mode("append").parquet(folders[2024, 1])
    states = {s["month"]: s for s in ingest.ingest_each(spark, folders, path)}
    assert {m: s["status"] for m, s in states.items()} == {1: "success", 2: "failed", 3: "failed", 4: "success", 5: "success", 6: "failed"}
    assert (states[1]["rows"], states[1]["strays"], states[5]["rows"]) == (120, 2, 123)
    assert counts(spark, path) == {(2024, 1): 120, (2024, 4): 120, (2024, 5): 123}
    assert spark.read.parquet(path).where("month = 5 and trip_time = 600").count() == 123
    assert ingest.ingest_each(spark, {(2024, 6): folders[2024, 6]}, path)[0]["status"] == "failed"


def test_recovery_between_the_two_moves(spark, tmp_path):
    path = str(tmp_path / "lake")
    df = spark.createDataFrame(month_rows(1, 5) + month_rows(2, 5), SCHEMA).withColumns({"year": F.lit(2024), "month": F.month("pickup_datetime")})
    lake.write_partitioned(df, path)
    run = publish.Run(spark, path)
    run.stage(df.unionByName(df))
    assert run.staged_rows() == {(2024, 1): 10, (2024, 2): 10}
    run._record(2024, 1, "publishing", 10)
    run._files.move(f"{path}/year=2024/month=1", f"{path}/_replaced/{run.name}/year=2024/month=1")  # and there it broke off
    assert publish.recover(spark, path) == [(2024, 1)] and publish.recover(spark, path) == []
    assert counts(spark, path) == {(2024, 1): 10, (2024, 2): 5}


def test_footer_table(spark, folders, tmp_path):
    table = footers.read_footers(spark, {str(m[1]): p for m, p in folders.items()})
    parts = {r.part: r for r in footers.part_rows(table).collect()}
    assert {p: r.rows for p, r in parts.items()} == {"1": 120, "2": 120, "3": parts["3"].rows, "4": 120, "5": 120, "6": 0}
    assert parts["3"].rows < 120 and parts["3"].error and parts["6"].error and parts["6"].files == 0 and parts["1"].error is None
    assert footers.available(table, "126") == {"1": True, "2": True, "6": False}
    wanted = [c.split()[0] for c in SCHEMA.split(",")]
    got = {r.part: (r.missing, r.extra, r.retyped) for r in footers.drift(table, wanted).collect()}
    assert got == {"4": ("driver_pay", "", ""), "5": ("tolls", "more", "")}
    typed = footers.drift(table, {"trip_time": "int32", "PULocationID": "int32"}).where("part = '5'").first()
    assert typed.retyped == "PULocationID,trip_time"
    stats = {(r.part, r.column): r for r in footers.column_stats(table).collect()}
    assert stats["1", "trip_time"].rows == 120 and stats["1", "trip_time"].nulls == 0 and stats["1", "trip_time"].type == "int32"
    row = table.where("part = '1'").select(F.inline("columns")).where("name = 'driver_pay'").agg(F.min(F.col("low").cast("double")), F.max(F.col("high").cast("double"))).first()
    assert tuple(row) == (10.0, 11.19)


def test_footers_of_a_root_with_odd_files(spark, tmp_path):
    root = tmp_path / "a b" / "lake"
    spark.range(10).selectExpr("id", "id % 2 as year", "'ä' as t").write.partitionBy("year").parquet(str(root))
    pq.write_table(pa.table({"x": [[1, 2], None], "s": [{"a": 1}, None]}), root / "year=1" / "nested.parquet")
    (root / "notes.txt").write_text("no")
    (root / "year=0" / "bad.parquet").write_text("no")
    table = footers.read_footers(spark, str(root))
    rows = {r.part: r for r in footers.part_rows(table).collect()}
    assert {p: (r.rows, r.error is None) for p, r in rows.items()} == {"year=0": (5, False), "year=1": (7, True)}
    assert [tuple(r) for r in footers.partition_values(table, ["year"]).collect()] == [(0, 2, 5), (1, 2, 7)] or rows["year=0"].files > 2
    names = {r.column for r in footers.column_stats(table).collect()}
    assert names == {"id", "t", "x", "s"}
