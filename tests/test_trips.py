import datetime as dt

import pytest
from pyspark.sql import functions as F

from fareframe.operators import clean, features, metrics, quality, sampling, setops

T0 = dt.datetime(2024, 1, 3, 8, 0)
BASE = {
    "trip_id": 0, "hvfhs_license_num": "HV0003", "pickup_datetime": T0, "dropoff_datetime": T0 + dt.timedelta(minutes=10),
    "PULocationID": 1, "DOLocationID": 2, "trip_miles": 2.0, "trip_time": 600, "base_passenger_fare": 20.0,
    "driver_pay": 15.0, "tolls": 1.0, "revenue_per_mile": 9.0,
}
SCHEMA = """trip_id int, hvfhs_license_num string, pickup_datetime timestamp_ntz, dropoff_datetime timestamp_ntz,
  PULocationID int, DOLocationID int, trip_miles double, trip_time int, base_passenger_fare double, driver_pay double,
  tolls double, revenue_per_mile double"""


def make(spark, *changes):
    rows = [tuple({**BASE, "trip_id": i, **c}.values()) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, SCHEMA)


def ids(df):
    return sorted(r["trip_id"] for r in df.select("trip_id").collect())


def test_provider(spark):
    df = make(spark, {}, {"hvfhs_license_num": " hv0003 "}, {"hvfhs_license_num": "HV0005"}, {"hvfhs_license_num": None})
    assert ids(clean.filter_provider(df, "hvfhs_license_num", "HV0003")) == [0, 1]
    assert ids(clean.filter_provider(df, "hvfhs_license_num", "HV0003", normalised=True)) == [0]


def test_each_required_column(spark):
    required = list(clean.REQUIRED_TRIP_COLUMNS)
    df = make(spark, {}, *[{c: None} for c in required])
    assert ids(clean.require_not_null(df)) == [0]
    assert ids(clean.require_not_null(df, required[:-1])) == [0, len(required)]


def test_each_validity_rule(spark):
    df = make(
        spark, {}, {"trip_miles": -1.0}, {"trip_time": 0}, {"base_passenger_fare": -0.1}, {"driver_pay": -1.0},
        {"dropoff_datetime": T0 - dt.timedelta(seconds=1)}, {"dropoff_datetime": T0}, {"trip_miles": 0.0},
    )
    assert ids(clean.valid_trips(df)) == [0, 6, 7]
    assert ids(clean.valid_trips(df, with_pay=False)) == [0, 4, 6, 7]


def test_extract_and_clock_duration(spark):
    df = make(spark, {}, {"trip_time": None}, {"trip_time": 0}, {"trip_miles": None})
    got = clean.analysis_extract(df).collect()
    assert [(r["trip_id"], r["duration_sec"], r["mph"]) for r in got] == [(0, 600, 12.0)]
    assert clean.with_clock_duration(make(spark, {})).first()["duration_sec"] == 600


def test_metrics_and_zero_denominators(spark):
    df = metrics.commission_metrics(make(spark, {}, {"base_passenger_fare": 0.0}, {"trip_miles": 0.0})).orderBy("trip_id")
    a, b, c = df.collect()
    assert (a["commission"], a["take_rate"], a["commission_per_mile"]) == (5.0, 25.0, 2.5)
    assert (a["commission_per_minute"], a["driver_efficiency"], a["avg_speed_mph"]) == (0.5, 1.5, 12.0)
    assert a["pickup_date"] == T0.date()
    assert b["take_rate"] == 0.0 and c["commission_per_mile"] == 0.0
    named = metrics.commission_metrics(make(spark, {}), {"commission": "margin"})
    assert "margin" in named.columns and "commission" not in named.columns


def test_cpm_modes(spark):
    df = metrics.commission_metrics(
        make(spark, {"trip_miles": 0.0}, {"trip_miles": 0.1}, {"trip_miles": 0.1001}, {"trip_miles": None})
    )
    assert ids(metrics.with_cpm(df)) == [2]
    nulls = {r["trip_id"]: r["y_cpm"] for r in metrics.with_cpm(df, mode="null").collect()}
    assert nulls[0] is None and nulls[1] is None and nulls[3] is None and nulls[2] == pytest.approx(5 / 0.1001)


def test_winsorize_recomputes_ratios(spark):
    df = spark.createDataFrame(
        [(float(i), float(i), 10.0, 2.0, 60) for i in range(101)],
        "id double, commission double, base_passenger_fare double, trip_miles double, trip_time int",
    )
    got = metrics.winsorize(df, "commission", 0.05, 0.95).agg(F.min("commission"), F.max("commission"), F.count("*")).first()
    assert tuple(got) == (5.0, 95.0, 101)
    top = metrics.winsorize_commission(df, (5.0, 95.0)).where("id = 100").first()
    assert (top["commission"], top["commission_raw"], top["commission_per_mile"]) == (95.0, 100.0, 47.5)
    nulls = spark.createDataFrame([(None,), (1.0,)], "commission double")
    assert {r[0] for r in metrics.winsorize(nulls, "commission").collect()} == {None, 1.0}


def test_na_zones_and_ranges(spark):
    df = spark.createDataFrame([("A", "B"), ("N/A", "B"), ("A", None)], "PU_Borough string, DO_Borough string")
    assert clean.drop_na_zones(df).count() == 1
    trips = make(spark, {"trip_miles": 1.0}, {"trip_miles": 2.0}, {"trip_miles": 3.0}, {"trip_miles": None})
    assert ids(clean.within(trips, {"trip_miles": (1.0, 2.0)})) == [0, 1]
    assert ids(clean.within(trips, {"trip_miles": (None, 1.5)})) == [0]


def test_early_prune(spark):
    assert not {"tolls", "revenue_per_mile", "hvfhs_license_num"} & set(clean.drop_existing(make(spark, {})).columns)


def test_funnel_is_monotone_and_adds_up(spark):
    df = make(
        spark, {}, {"hvfhs_license_num": "HV0005"}, {"trip_time": 0}, {"driver_pay": 30.0}, {"driver_pay": None},
        {"PULocationID": 9},
    ).withColumns({"year": F.lit(2024), "month": F.lit(1)})
    r = quality.removal_funnel(df, "hvfhs_license_num", "HV0003", sampled=F.col("PULocationID") != 9).first()
    assert (r["raw_count"], r["provider_count"], r["quality_count"], r["sampled_count"], r["final_rows"]) == (6, 5, 3, 2, 1)
    removed = r["removed_other_provider"] + r["removed_quality"] + r["removed_sampling"] + r["removed_neg_commission"]
    assert r["raw_count"] - removed == r["final_rows"]


def test_funnel_by_year(spark):
    rows = [(2023, 1, 100, 50, 40, 40, 30), (2023, 2, 0, 0, 0, 0, 0), (2024, 1, 10, 0, 0, 0, 0)]
    names = ["year", "month", "raw_count", "provider_count", "quality_count", "sampled_count", "final_rows"]
    df = spark.createDataFrame(rows, names).withColumns(
        {
            "removed_other_provider": F.col("raw_count") - F.col("provider_count"),
            "removed_quality": F.col("provider_count") - F.col("quality_count"),
            "removed_sampling": F.lit(0),
            "removed_neg_commission": F.col("sampled_count") - F.col("final_rows"),
        }
    )
    got = quality.funnel_by_year(df).collect()
    assert [r["year"] for r in got] == ["2023", "2024", "ALL"]
    assert (got[0]["ret_after_provider_pct"], got[0]["ret_final_vs_raw_pct"]) == (50.0, 30.0)
    assert got[1]["ret_after_quality_pct"] is None
    assert got[2]["raw"] == 110


def test_thresholds(spark):
    df = spark.createDataFrame([(float(i), 5.0, None) for i in range(101)], "a double, flat double, gone double")
    table = quality.thresholds(
        df,
        {
            "a": {"method": "percentile", "lower": 5, "upper": 95},
            "flat": {"method": "z_score"},
            "gone": {"method": "iqr"},
        },
    )
    assert quality.threshold_values(table) == {"a": (5.0, 95.0)}
    iqr = quality.threshold_values(quality.thresholds(df, {"a": {"method": "iqr"}, "flat": {"method": "iqr"}}))
    assert iqr == {"a": (0.0, 150.0), "flat": (5.0, 5.0)}
    z = quality.threshold_values(quality.thresholds(df, {"a": {"method": "z_score"}}))
    assert z["a"][0] == 0.0 and z["a"][1] == pytest.approx(50 + 3 * 29.3002, rel=1e-4)


def test_retention_and_tail(spark):
    df = spark.createDataFrame([(1.0, 1.0), (5.0, 1.0), (9.0, 99.0), (None, 1.0)], "a double, b double")
    rows = {r["rule"]: (r["kept"], r["below"], r["above"]) for r in quality.retention(df, {"a": (2, 8), "b": (0, 10)}).collect()}
    assert rows == {"a": (1, 1, 1), "b": (3, 0, 1), "combined": (1, 1, 1)}
    assert quality.tail_share(df, "a", 5.0).first()[0] == pytest.approx(200 / 3)
    assert quality.tail_share(df.where("a is null"), "a", 5.0).first()[0] == 0.0


def test_coverage_reports_unknown_columns(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    rows = {r["column"]: (r["present"], r["non_null"], r["coverage_pct"]) for r in quality.coverage(df, {"g": ["a", "b", "z"]}).collect()}
    assert rows == {"a": (1, 2, 100.0), "b": (1, 1, 50.0), "z": (0, 0, 0.0)}
    assert {r["column"]: r["null_pct"] for r in quality.null_rates(df, ["a", "b", "z"]).collect()} == {"a": 0.0, "b": 50.0}


def test_unions_dedupe_and_keys(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, None)], "k int, v string")
    assert setops.union_years(a, a.drop("v")).where("v is null").count() == 4
    assert sorted(setops.dedupe_key(a, ["k"], ["v"]).collect()) == [(1, "x"), (2, None)]
    assert sorted(setops.first_per_key(a, ["k"], ["v"]).collect()) == [(1, "x"), (2, None)]
    assert [tuple(r) for r in setops.duplicate_keys(a, ["k"]).collect()] == [(1, 2)]
    with pytest.raises(Exception, match="repeated key"):
        setops.require_unique(a, ["k"]).collect()
    assert setops.require_unique(a.where("v = 'x'"), ["k"]).collect() == [(1, "x")]
    blank = spark.createDataFrame([(None, "x"), (None, "y"), (2, "z")], "k int, v string")
    assert sorted(r.v for r in setops.require_unique(blank, ["k"]).collect() if r.k is not None) == ["z"]


def test_dedupe_hot_key_matches_brute_force(spark):
    df = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("k"), F.xxhash64("id").alias("o"), "id"
    )
    rows = {}
    for r in df.collect():
        rows[r["k"]] = min(rows.get(r["k"], (r["o"], r["id"])), (r["o"], r["id"]))
    got = setops.dedupe_key(df.repartition(5), ["k"], ["o"]).collect()
    assert {r["k"]: (r["o"], r["id"]) for r in got} == rows


def test_date_overlap_without_common_dates(spark):
    a = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 1),)], "d date")
    b = spark.createDataFrame([(dt.date(2024, 2, 1),), (None,)], "e date")
    assert tuple(setops.date_overlap(a, "d", b, "e").first()) == (1, 1, 0)


def test_schema_drift(spark):
    got = setops.schema_drift(spark, {"m1": ["a", "b"], "m2": ["a", "c"]}, ["a", "b"]).collect()
    assert [tuple(r) for r in got] == [("m2", "b", "c")]


def test_hash_sample_is_stable(spark):
    df = spark.range(20000)
    one = {r[0] for r in sampling.hash_sample(df, ["id"], 0.3, 7).collect()}
    two = {r[0] for r in sampling.hash_sample(df.repartition(11), ["id"], 0.3, 7).collect()}
    assert one == two and 5500 < len(one) < 6500
    assert {r[0] for r in sampling.hash_sample(df, ["id"], 0.3, 8).collect()} != one
    assert sampling.hash_sample(df, ["id"], 1.0).count() == 20000
    assert sampling.month_seed(2024, 3) == 202403


def test_stratified(spark):
    df = spark.range(30000).withColumn("s", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    n = {r["s"]: r["count"] for r in sampling.stratified_hash(df, "s", {"a": 0.5}, ["id"]).groupBy("s").count().collect()}
    assert set(n) == {"a"} and 4700 < n["a"] < 5300
    assert 13000 < sampling.stratified(df, "s", 0.5).count() < 17000
    assert sampling.stratified(df, "s", {"b": 1.0}).count() == 20000
    assert {r["id"] for r in sampling.sample_n(df, 100, ["id"]).collect()} == {r["id"] for r in sampling.sample_n(df.repartition(9), 100, ["id"]).collect()}
    assert sampling.hash_sample(df, ["id"], 1e-9).count() <= 1


def test_feature_pruning(spark):
    rows = [("morning", "morning_rush", 1, 0, 3.0), ("evening", "evening_rush", None, 1, 4.0)]
    df = spark.createDataFrame(rows, "time_period string, rush_hour_label string, fog_mist int, heavy_fog int, tmax_c double")
    pruned = features.prune_features(df, ["time_period"])
    assert pruned.columns == ["rush_hour_label", "fog_flag"]
    # The schema never depends on the rows.
    assert features.prune_features(df).columns == features.prune_features(df.limit(0)).columns
    assert features.is_redundant_label(df, "time_period", "rush_hour_label")
    assert [r["fog_flag"] for r in pruned.collect()] == [1, 1]
    both = df.unionByName(df.withColumn("time_period", F.lit("night")))
    assert not features.is_redundant_label(both, "time_period", "rush_hour_label")


def test_correlation_rules(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, -1.0 * i, 1.0, None if i else 1.0) for i in range(20)],
                               "trip_time double, duration_minutes double, revenue_per_x double, flat double, gap double")
    table = features.suggest_removals(features.correlation_pairs(df, threshold=0.9))
    got = {(r["a"], r["b"]): (round(r["r"], 6), r["remove"]) for r in table.collect()}
    assert got == {
        ("trip_time", "duration_minutes"): (1.0, "duration_minutes"),
        ("trip_time", "revenue_per_x"): (-1.0, "revenue_per_x"),
        ("duration_minutes", "revenue_per_x"): (-1.0, "revenue_per_x"),
    }
    assert features.numeric_features(df, ["flat"]) == ["trip_time", "duration_minutes", "revenue_per_x", "gap"]


def test_correlations_match_pandas(spark):
    df = spark.range(3000).select(
        *[(F.xxhash64("id", F.lit(i)) % 1000 / 10 + 1e6 * i).alias(f"c{i}") for i in range(4)],
        F.when(F.col("id") % 3 > 0, F.col("id") / 7 + F.xxhash64("id") % 50).alias("gaps"),
        F.lit(0.1).alias("flat"), F.lit(None).cast("double").alias("empty"),
    )
    want = df.toPandas().astype(float).corr()
    got = {(r["a"], r["b"]): r["r"] for r in features.correlations(df.repartition(9)).collect()}
    assert all(r is None for (a, b), r in got.items() if "flat" in (a, b))
    known = {k: v for k, v in got.items() if "flat" not in k}
    assert len(known) == 10
    for (a, b), r in known.items():
        assert r == pytest.approx(want.loc[a, b], abs=1e-9)


def test_outlier_profile_and_indicators(spark):
    df = make(spark, {}, {"trip_miles": 0.0}, {"trip_miles": 150.0}, {"dropoff_datetime": T0}, {"trip_miles": -1.0})
    got = {r["metric"]: r["value"] for r in quality.outlier_profile(df).collect()}
    assert (got["over_100_miles"], got["zero_miles"], got["negative_miles"], got["zero_or_negative"]) == (1, 1, 1, 1)
    assert (got["trip_miles_n"], got["mph_n"], got["trip_miles_p50"]) == (5, 4, 2.0)
    rows = {r["indicator"]: r["n"] for r in quality.quality_indicators(clean.analysis_extract(df)).collect()}
    assert (rows["very_short"], rows["very_long"], rows["zero_distance"], rows["quick"]) == (2, 1, 1, 0)


def test_summaries_and_contract(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    both = quality.compare_summaries(quality.summary(df, "v"), quality.summary(df.where("v < 51"), "v"))
    assert {r["percentile"]: (r["value_train"], r["value_test"]) for r in both.collect()}["p50"] == (50.0, 25.0)
    assert quality.check_mart(df, ["v", "w"], ["v"]) == {"missing": ["w"], "unwanted": ["v"]}
    stats = quality.basic_stats(df, ["v"]).first()
    assert (stats["n"], stats["mean"], stats["min"], stats["max"]) == (101, 50.0, 0.0, 100.0)
    assert tuple(quality.extent(df, "v").first()) == (0.0, 100.0, 101)


def test_exact_sample_sizes(spark):
    df = spark.range(5000).selectExpr("id", "case when id % 50 = 0 then null when id % 7 = 0 then 'a' else 'b' end as g").repartition(5)
    one = sampling.sample_n(df, 137, ["id"])
    assert one.columns == df.columns and one.distinct().count() == 137
    ordered = df.orderBy(sampling.sample_hash(["id"], 42), "id").limit(137)
    assert {r.id for r in one.collect()} == {r.id for r in ordered.collect()}
    sizes = {r.g: r["count"] for r in sampling.sample_n_by(df, 150, "g", ["id"]).groupBy("g").count().collect()}
    assert sizes == {None: 100, "a": 150, "b": 150}
    assert {r.g: r["count"] for r in sampling.sample_n_by(df, {"a": 9, "z": 4}, "g", ["id"]).groupBy("g").count().collect()} == {"a": 9}
    assert sampling.sample_n(df, 0, ["id"]).count() == 0 and sampling.sample_n(df.limit(0), 5, ["id"]).count() == 0
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan
