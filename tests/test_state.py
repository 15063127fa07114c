import datetime as dt
import random
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fareframe.operators import features, halo, profile
from fareframe.operators.order_stats import quantiles
from fareframe.plans.state import MonthState


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def trips(spark):
    r = random.Random(3)
    rows = [(2023 + m // 12, 1 + m % 12, r.choice([0.1, 2.5, round(r.gauss(10, 8), 2), None]), r.randint(-5, 70_000), r.choice(["a", None])) for m in range(18) for _ in range(150)]
    return spark.createDataFrame(rows, "year int, month int, fare double, k long, zone string")


def test_state_equals_the_trips(spark, trips, tmp_path):
    state = MonthState(spark, str(tmp_path / "state"))
    asked = {"columns": ["fare", "k"], "groups": {"g": ["zone", "absent"]}, "whole": ["k"]}
    state.add(trips.where("year = 2023"), **asked)
    state.add(trips.where("year = 2024"), **asked)
    state.add(trips.where("year = 2024 and month = 2"), **asked)  # again: it replaces itself
    months = (F.col("year") * 100 + F.col("month")).between(202305, 202403)
    own = trips.where(months)
    for cols, by in ((["fare", "k"], []), (["fare"], ["year"])):
        want = {tuple(r) for r in quantiles(own, cols, [0, 0.013, 0.5, 1], by=by).collect()}
        assert {tuple(r) for r in state.quantiles(cols, [0, 0.013, 0.5, 1], months, by).collect()} == want
    stats = {r["column"]: r for r in state.basic_stats(months).collect()}
    fares = [Decimal(repr(r[0])) for r in own.select("fare").collect() if r[0] is not None]
    assert stats["fare"].total == sum(fares) and stats["fare"].n == len(fares) and stats["fare"].min == float(min(fares))
    cover = {r["column"]: (r.present, r.non_null, r.total) for r in state.coverage(months).collect()}
    assert cover == {"zone": (1, own.where("zone is not null").count(), own.count()), "absent": (0, 0, own.count())}
    want = {r[0]: r[1] for r in own.groupBy("year").agg(F.count_distinct("k")).collect()}
    assert {r.year: r.n_distinct for r in state.distinct(months, ["year"]).collect()} == want
    with pytest.raises(FileNotFoundError):
        state.funnel_by_year()


def test_one_added_month_reads_one_month(spark, trips, tmp_path):
    state = MonthState(spark, str(tmp_path / "state"))
    trips.write.partitionBy("year", "month").parquet(str(tmp_path / "trips"))
    stored = spark.read.parquet(str(tmp_path / "trips"))
    state.add(stored.where("year = 2023"), columns=["fare"])
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "state").rglob("*.parquet")}
    state.add(stored.where("year = 2024 and month = 1"), columns=["fare"])
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "state").rglob("*.parquet")}
    assert all(after.get(p) == t for p, t in before.items())
    assert all("year=2024/month=1" in str(p) for p in after.keys() - before.keys())
    assert "PartitionFilters: [isnotnull(year" in plan_of(state.read("values", F.col("year") == 2024))


def test_grouped_quantiles_shuffle_no_fact_rows(spark, trips):
    plan = plan_of(quantiles(trips, ["fare"], [0.01, 0.99], by=["year", "month"]))
    assert "SortMergeJoin" not in plan.split("Scan ExistingRDD")[-1].split("\n")[0] and plan.count("BroadcastHashJoin") >= 1
    joins = [line for line in plan.split("\n") if "Join" in line and "cell" in line and "sub" not in line]
    assert joins and all("BroadcastHashJoin" in line for line in joins)


@pytest.mark.parametrize(("n", "width", "block"), [(1000, 30, 40), (1000, 7, 7), (1000, 1, 10), (25, 30, 10), (3, 2, 1), (0, 3, 5)])
def test_blocks_carry_their_borders(spark, n, width, block):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    r = random.Random(n)
    rows = [(d, None if r.random() < 0.02 else r.random()) for d in days]
    df = spark.createDataFrame(r.sample(rows, n), "d date, v double").repartition(6)
    got = profile.centred_mean(df, "d", "v", width=width, block=block).orderBy("d").collect()
    v = pd.Series([x for _, x in rows], dtype=float)
    back, ahead = width // 2, (width - 1) // 2
    want = [v[i - back : i + ahead + 1].mean() if i >= back and i + ahead < n and v[i - back : i + ahead + 1].notna().all() else None for i in range(n)]
    assert [g.d for g in got] == days
    assert all((g.v_rolling is None) == (w is None) and (w is None or abs(g.v_rolling - w) < 1e-12) for g, w in zip(got, want, strict=True))


def test_series_windows_run_in_many_tasks(spark):
    df = spark.range(20_000).select("id", F.rand(1).alias("v"))
    out = profile.centred_mean(df, "id", "v", width=5, block=500)
    assert "Window" in plan_of(out) and "SinglePartition" not in plan_of(out).split("BroadcastExchange")[0]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables else end in one task
    try:
        per_task = {r.p: r["count"] for r in out.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(per_task.values()) == 20_000 and len(per_task) > 4 and max(per_task.values()) < 10_000
    single = plan_of(profile.pct_vs_baseline(df.select((F.col("id") % 24).alias("pickup_hour"), F.col("v").alias("mean"))))
    assert "Window" not in single


def test_places_of_ties_nulls_and_times(spark):
    rows = [(None, 1), (float("nan"), 2), (1.0, 3), (1.0, 4), (-5.0, 5), (7.5, 6)]
    df = spark.createDataFrame(rows, "k double, i int")
    got = {r.i: r._at for r in halo.placed(df, "k", halo.range_bounds(df, "k", 4)).collect()}
    assert (got[1], got[5], {got[3], got[4]}, got[6], got[2]) == (0, 1, {2, 3}, 4, 5)
    times = spark.createDataFrame([(dt.datetime(2020, 1, 1, h), h) for h in range(10)], "t timestamp_ntz, i int")
    assert {r.i: r._at for r in halo.placed(times, "t", halo.range_bounds(times, "t")).collect()} == {h: h for h in range(10)}
    with pytest.raises(ValueError, match="ordered by"):
        halo.range_bounds(spark.createDataFrame([("a",)], "s string"), "s")


def test_moments_merge_in_a_tree(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(1e6, 1, 40_000)
    y = 0.5 * x + rng.normal(0, 1, 40_000)
    rows = []
    for task, (a, b) in enumerate(zip(np.array_split(x, 3000), np.array_split(y, 3000), strict=True)):
        rows.append(("x", "y", task, float(len(a)), a.mean(), b.mean(), ((a - a.mean()) ** 2).sum(), ((b - b.mean()) ** 2).sum(), ((a - a.mean()) * (b - b.mean())).sum()))
    parts = spark.createDataFrame([tuple(v.item() if hasattr(v, "item") else v for v in r) for r in rows], "a string, b string, task long, n double, ma double, mb double, va double, vb double, c double")
    r = features.merge_moments(parts).first()
    assert r.n == 40_000 and abs(r.c / np.sqrt(r.va * r.vb) - np.corrcoef(x, y)[0, 1]) < 1e-9
    assert "Window" not in plan_of(features.merge_moments(parts))


def test_distinct_zeros_and_bitmaps(spark):
    df = spark.createDataFrame([(0.0, 1, "a"), (-0.0, -40_000, "a"), (1.0, 1, "b"), (float("nan"), None, "b"), (float("nan"), 2**40, "b")], "f double, k long, g string")
    assert {r["column"]: r.n_distinct for r in profile.n_distinct(df, ["f", "k"]).collect()} == {"f": 3, "k": 3}
    maps = profile.value_bitmaps(df, ["k"], by=["g"])
    assert profile.distinct_of_bitmaps(maps).first().n_distinct == 3
    assert {r.g: r.n_distinct for r in profile.distinct_of_bitmaps(maps, ["g"]).collect()} == {"a": 2, "b": 2}
