import datetime as dt

import pytest
from pyspark.sql import functions as F

from fareframe.operators import calendar, joins, sizing, weather, zones

ZONES = [(1, "Manhattan", "Midtown", "Yellow Zone"), (2, "Queens", "JFK", "Airports"), (3, "Queens", "Astoria", "Boro Zone")]


@pytest.fixture
def dim(spark):
    return spark.createDataFrame(ZONES, "LocationID int, Borough string, Zone string, service_zone string")


@pytest.fixture
def trips(spark):
    rows = [
        (0, 1, 2, dt.datetime(2024, 1, 1, 8, 30)), (1, 2, 3, dt.datetime(2024, 1, 1, 23, 0)),
        (2, 3, 9, dt.datetime(2024, 1, 6, 17, 15)), (3, None, 1, dt.datetime(2024, 1, 8, 0, 0)),
    ]
    return spark.createDataFrame(rows, "trip int, PULocationID int, DOLocationID int, pickup_datetime timestamp_ntz")


def test_zone_roles_keep_every_trip(trips, dim):
    got = {r["trip"]: (r["PU_Borough"], r["DO_Zone"]) for r in joins.join_zone_roles(trips, dim).collect()}
    assert got == {0: ("Manhattan", "JFK"), 1: ("Queens", "Astoria"), 2: ("Queens", None), 3: (None, "Midtown")}
    other = joins.join_zone_roles(trips, dim.withColumnRenamed("LocationID", "zone_id"), ("pickup_", "dropoff_"))
    assert "pickup_Borough" in other.columns
    with pytest.raises(ValueError):
        joins.detect_key(dim.drop("LocationID"), joins.ZONE_KEYS)


def test_duplicate_zone_keys_fail(trips, dim):
    with pytest.raises(Exception, match="repeated key"):
        joins.join_zone_roles(trips, dim.unionByName(dim)).collect()


def test_membership_paths_agree(spark, trips):
    members = spark.createDataFrame([(1,), (3,), (3,), (None,)], "LocationID int")
    a = joins.flag_membership(trips, "PULocationID", members, "LocationID", "f")
    b = joins.flag_in_list(trips, "PULocationID", [1, 3], "f")
    want = {0: 1, 1: 0, 2: 1, 3: 0}
    assert {r["trip"]: r["f"] for r in a.collect()} == want
    assert {r["trip"]: r["f"] for r in b.collect()} == want


def test_od_lookup_equals_direct_labels(spark, trips, dim):
    cbd = spark.createDataFrame([(1,)], "LocationID int")
    od = zones.build_od_features(dim, cbd, airports=[2])
    assert od.count() == 9
    via_od = joins.join_od(trips.where("DOLocationID < 9 and PULocationID is not null"), od)
    direct = zones.label_trips(trips.where("DOLocationID < 9 and PULocationID is not null"), dim, cbd, airports=[2])
    cols = ["trip", "trip_cbd_type", "PU_Zone", "DO_Borough", "is_cross_borough", "involves_manhattan", "involves_airport"]
    assert sorted(via_od.select(cols).collect()) == sorted(direct.select(cols).collect())
    unknown = zones.add_cbd_flags(trips, None).first()
    assert (unknown["trip_cbd_type"], unknown["PU_in_cbd"]) == ("unknown", 0)


def test_calendar_join_uses_the_hour(spark, trips):
    holidays = spark.createDataFrame([(dt.date(2024, 1, 1), "New Year")], "holiday_date date, holiday_name string")
    grid = calendar.add_calendar(calendar.hour_grid(spark, "2024-01-01", "2024-01-08"), holidays=holidays)
    assert grid.count() == 8 * 24
    got = {r["trip"]: r["rush_hour_label"] for r in joins.join_calendar(trips, grid).collect()}
    assert got == {0: "morning_rush", 1: "late_night", 2: "weekend", 3: "late_night"}
    by_day = {r["trip"]: (r["is_holiday"], r["is_weekend"]) for r in joins.join_calendar(trips, grid, grain="day").collect()}
    assert by_day == {0: (True, False), 1: (True, False), 2: (False, True), 3: (False, False)}
    exact = joins.join_temporal_exact(trips, grid.select("pickup_datetime", "time_period"))
    assert {r["trip"]: r["time_period"] for r in exact.collect()} == {0: None, 1: "night", 2: None, 3: "night"}
    assert calendar.month_grid(spark, 2024, 2).count() == 29 * 24


def test_weather_join_and_coverage(spark, trips):
    days = spark.createDataFrame([(dt.date(2024, 1, 1), 3.0), (dt.date(2024, 1, 6), None)], "weather_date date, t double")
    joined = joins.join_weather(trips, days)
    assert joined.count() == 4
    assert tuple(joins.join_coverage(joined, "t").first()) == (2, 4, 50.0, 0)
    assert joins.join_coverage(joined.where("trip = 3"), "t").first()["no_match"] == 1
    with pytest.raises(Exception, match="repeated key"):
        joins.join_weather(trips, days.unionByName(days)).collect()


def test_enrich_status(spark, trips, dim):
    df, joined = joins.enrich(trips, zones=dim)
    assert joined == {"zones": True, "od": False, "calendar": False, "weather": False, "holidays": False}
    assert df.count() == 4
    with pytest.raises(ValueError):
        joins.enrich(trips, require=["weather"])
    assert joins.enrich(trips, require=["weather"], on_missing="skip")[1]["weather"] is False


def test_conflicting_columns_stay_left(spark, trips):
    right = spark.createDataFrame([(1, 99, "x")], "PULocationID int, trip int, extra string")
    got = joins.left_enrich(trips, right, ["PULocationID"]).where("PULocationID = 1").first()
    assert (got["trip"], got["extra"]) == (0, "x")


def test_broadcast_is_checked(spark, dim):
    big = spark.range(1000).select(F.col("id"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("x"))
    assert sizing.planned_bytes(big) is None
    assert sizing.is_small(big, max_rows=5000) and not sizing.is_small(big, max_rows=4999)
    assert sizing.is_small(dim)
    plan = dim.join(sizing.small_side(big, max_rows=10), dim["LocationID"] == big["id"])._jdf.queryExecution().analyzed()
    assert "broadcast" not in plan.toString()
    wide = spark.range(3000).select(F.explode(F.sequence(F.lit(1), F.lit(2))).alias("x"), F.repeat(F.lit("y"), 20000).alias("ring"))
    assert not sizing.is_small(wide) and sizing.is_small(wide.select("x"))


RAW = [
    ("A", "2024-01-01", "50", "32", None, "T", "1", "0", "10", "1", None),
    ("B", "2024-01-01", "68", " 41 ", "55", "0.5", "", "T", "", None, None),
    ("A", "2024-07-02", "95", "77", None, "", None, None, "250", None, "1"),
    ("A", "2024-07-03", "30", "40", None, "-1", "T", None, None, None, None),
    ("A", "not a date", "30", "40", None, "0", None, None, None, None, None),
]
COLS = "STATION string, DATE string, TMAX string, TMIN string, TAVG string, PRCP string, SNOW string, SNWD string, AWND string, WT01 string, WT02 string"


@pytest.fixture
def raw(spark):
    df = spark.createDataFrame(RAW, COLS)
    return df.withColumns({c: F.lit(None).cast("string") for c in ("WT03", "WT04", "WT05", "WT06", "WT08")})


def test_imperial_cleaning(raw):
    rows = {(r["STATION"], str(r["weather_date"])): r for r in weather.clean_imperial(raw).collect()}
    assert len(rows) == 4
    a = rows["A", "2024-01-01"]
    assert (a["tmax_c"], a["tmin_c"], a["is_freezing"], a["is_snow"], a["fog_flag"]) == (10.0, 0.0, 1, 1, 1)
    assert a["precipitation_mm"] == pytest.approx(0.254) and a["wind_speed_kmh"] == pytest.approx(16.0934)
    b = rows["B", "2024-01-01"]
    assert b["temp_avg_calculated"] == pytest.approx((55 - 32) * 5 / 9) and b["wind_speed_kmh"] is None
    hot = rows["A", "2024-07-02"]
    assert (hot["is_hot"], hot["is_extreme_heat"], hot["season"], hot["wind_speed_kmh"]) == (1, 1, "summer", None)
    assert rows["A", "2024-07-03"]["precipitation_mm"] == 0.0


def test_day_rollup_is_one_row_a_day(raw):
    days = weather.station_to_day(weather.clean_imperial(raw))
    assert days.count() == 3
    first = days.where("weather_date = '2024-01-01'").first()
    assert (first["is_snow"], first["precipitation_mm"], first["season"]) == (1, pytest.approx(12.7), "winter")
    assert weather.day_rollup_min(raw).where("weather_date = '2024-01-01'").first()["station_count"] == 2


def test_tenths_cleaning_drops_implausible(raw):
    got = {str(r["weather_date"]) for r in weather.clean_weather(raw, "tenths").collect()}
    assert got == {"2024-01-01", "2024-07-02"}
    published = weather.clean_tenths(raw, wind_factor=0.036).where("STATION = 'A' and weather_date = '2024-01-01'").first()
    assert published["wind_speed_kmh"] == pytest.approx(0.36)
    with pytest.raises(ValueError):
        weather.clean_weather(raw, "kelvin")


def test_stations_and_quality(raw):
    assert weather.pick_stations(raw, ["B", "Z"]) == ["B"]
    assert weather.pick_stations(raw, ["Z"], 1) == ["A"] and weather.pick_stations(raw, ["Z"]) == []
    q = {r["metric"]: r["value"] for r in weather.weather_quality(raw).collect()}
    assert (q["total_records"], q["station_count"], q["valid_dates"], q["max_below_min"]) == (5, 2, 4, 2)
    assert (q["PRCP_present"], q["PRCP_missing"], q["negative_precipitation"]) == (3, 1, 1)
    best = weather.station_completeness(raw).where("is_best = 1").first()
    assert best["STATION"] == "A"
    # The most complete station is shown even beside larger ones, and the name is kept.
    sparse = [("BIG", "Big", "", "1")] * 5 + [("FULL", "Full", "1", "1")]
    df = raw.sparkSession.createDataFrame(sparse, "STATION string, NAME string, TMAX string, TMIN string")
    got = {r["STATION"]: (r["NAME"], r["is_best"]) for r in weather.station_completeness(df, 1).collect()}
    assert got == {"BIG": ("Big", 0), "FULL": ("Full", 1)}


def test_days_are_counted_once(spark):
    rows = [("A", "2024-01-01", "50", "32", "0.05"), ("B", "2024-01-01", "60", "40", "0.5"), ("A", "2024-07-02", "99", "80", "0")]
    raw = spark.createDataFrame(rows, "STATION string, DATE string, TMAX string, TMIN string, PRCP string")
    for c in ("TAVG", "SNOW", "SNWD", "AWND", "WT01", "WT02", "WT03", "WT04", "WT05", "WT06", "WT08"):
        raw = raw.withColumn(c, F.lit(None).cast("string"))
    days = weather.day_classes(weather.clean_imperial(raw))
    assert sum(r["days"] for r in weather.season_profile(days).collect()) == 2
    counts = {r["condition"]: r["days"] for r in weather.rain_intensity_counts(days).collect()}
    assert counts == {"no_rain": 1, "heavy_rain": 1}


def test_core_columns(raw):
    df = weather.clean_imperial(raw).drop("fog_flag")
    assert weather.select_weather_core(df).columns == list(weather.WEATHER_CORE)
