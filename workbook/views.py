"""Trip, zone, calendar and weather tables derived from the given star schema, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareframe.operators.calendar import add_calendar, hours_of
from fareframe.operators.clean import filter_provider, require_not_null, valid_trips
from fareframe.operators.joins import join_weather
from fareframe.operators.metrics import commission_metrics, with_cpm
from fareframe.operators.weather import clean_imperial, day_classes, station_to_day
from fareframe.operators.zones import label_trips

PROVIDER = "N"
AIRPORTS = (1, 13, 18)
BOROUGH = "ASIA"
HOLIDAYS = [
    ("1995-01-02", "New Year"), ("1995-07-04", "Summer Day"), ("1996-01-01", "New Year"),
    ("1996-11-28", "Harvest Day"), ("1997-01-01", "New Year"), ("1997-07-04", "Summer Day"),
    ("1998-05-25", "Spring Day"), ("1998-12-25", "Winter Day"), ("1999-07-05", "Summer Day"),
    ("2000-01-01", "New Year"), ("2000-11-23", "Harvest Day"), ("2001-01-01", "New Year"),
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def zones(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("LocationID"),
        F.col("r_name").alias("Borough"),
        F.col("n_name").alias("Zone"),
        F.when(F.col("n_nationkey").isin(*AIRPORTS), "Airports").otherwise("Zone").alias("service_zone"),
    )


def cbd_zones(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").where("n_nationkey % 4 = 0").select(F.col("n_nationkey").alias("LocationID"))


ZONES_SQL = """zones AS (
  SELECT n_nationkey AS LocationID, r_name AS Borough, n_name AS Zone,
         CASE WHEN n_nationkey IN (1, 13, 18) THEN 'Airports' ELSE 'Zone' END AS service_zone,
         CASE WHEN n_nationkey % 4 = 0 THEN 1 ELSE 0 END AS in_cbd
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def raw_trips(spark: SparkSession, sf: str) -> DataFrame:
    """Trips of all providers; fares and pay derive from price and discount."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    # Orders meet their customers first, so that the far larger line items move once less.
    placed = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    rows = li.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).join(
        s, F.col("l_suppkey") == F.col("s_suppkey")
    )
    fare = F.col("l_extendedprice") / 1000
    trips = rows.select(
        F.col("l_orderkey").alias("trip_key"),
        F.col("l_linenumber").alias("trip_part"),
        F.col("l_returnflag").alias("provider_code"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("l_partkey") % 24).cast("int"))).alias(
            "pickup_datetime"
        ),
        F.col("s_nationkey").alias("PULocationID"),
        F.col("c_nationkey").alias("DOLocationID"),
        (F.col("l_quantity") * 0.5).alias("trip_miles"),
        (F.col("l_quantity") * 60 + F.col("l_linenumber") * 30).cast("int").alias("trip_time"),
        fare.alias("base_passenger_fare"),
        (fare * (0.75 + 3 * F.col("l_discount"))).alias("driver_pay"),
        (F.col("l_linestatus") == "F").alias("shared_match_flag"),
        F.when(F.col("l_linestatus") == "F", "Y").otherwise("n").alias("shared_request_flag"),
        F.col("l_tax").alias("tolls"),
    )
    return trips.withColumn(
        "dropoff_datetime",
        F.col("pickup_datetime") + F.make_dt_interval(secs=F.col("trip_time").cast("decimal(18,6)")),
    )


RAW_SQL = """raw AS (
  SELECT l_orderkey AS trip_key, l_linenumber AS trip_part, l_returnflag AS provider_code,
         o_orderdate + to_hours(l_partkey % 24) AS pickup_datetime,
         s_nationkey AS PULocationID, c_nationkey AS DOLocationID,
         l_quantity * 0.5::DOUBLE AS trip_miles,
         CAST(l_quantity * 60 + l_linenumber * 30 AS INTEGER) AS trip_time,
         l_extendedprice / 1000 AS base_passenger_fare,
         l_extendedprice / 1000 * (0.75::DOUBLE + 3 * l_discount) AS driver_pay,
         l_linestatus = 'F' AS shared_match_flag,
         CASE WHEN l_linestatus = 'F' THEN 'Y' ELSE 'n' END AS shared_request_flag, l_tax AS tolls
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey)"""


def trips(spark: SparkSession, sf: str) -> DataFrame:
    """Valid trips of one provider with commission metrics and response."""
    df = filter_provider(raw_trips(spark, sf), "provider_code", PROVIDER)
    df = df.transform(require_not_null).transform(valid_trips).transform(commission_metrics)
    return with_cpm(df, mode="null")


TRIPS_SQL = (
    RAW_SQL
    + """,
trips AS (
  SELECT *, trip_time / 60.0::DOUBLE AS trip_duration_minutes,
         trip_miles * 3600.0::DOUBLE / trip_time AS avg_speed_mph,
         base_passenger_fare - driver_pay AS commission,
         CASE WHEN base_passenger_fare > 0
              THEN (base_passenger_fare - driver_pay) / base_passenger_fare * 100 ELSE 0 END AS take_rate,
         CASE WHEN trip_miles > 0
              THEN (base_passenger_fare - driver_pay) / trip_miles ELSE 0 END AS commission_per_mile,
         (base_passenger_fare - driver_pay) * 60.0::DOUBLE / trip_time AS commission_per_minute,
         driver_pay * 60.0::DOUBLE / trip_time AS driver_efficiency,
         CASE WHEN trip_miles > 0.1 THEN (base_passenger_fare - driver_pay) / trip_miles END AS y_cpm,
         CAST(pickup_datetime AS DATE) AS pickup_date, CAST(hour(pickup_datetime) AS INTEGER) AS pickup_hour
  FROM raw
  WHERE upper(trim(provider_code)) = 'N' AND trip_miles >= 0 AND trip_time > 0
    AND base_passenger_fare >= 0 AND driver_pay >= 0)"""
)


def holidays(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HOLIDAYS, "d string, holiday_name string").select(
        F.col("d").cast("date").alias("holiday_date"), "holiday_name"
    )


HOLIDAYS_SQL = (
    "holidays AS (SELECT CAST(d AS DATE) AS holiday_date, holiday_name FROM (VALUES "
    + ", ".join(f"('{d}', '{n}')" for d, n in HOLIDAYS)
    + ") v(d, holiday_name))"
)


def calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly calendar of the days on which orders exist."""
    days = hours_of(table(spark, sf, "orders"), "o_orderdate")
    return add_calendar(days, holidays=holidays(spark))


LABELS_SQL = """
         CASE WHEN dayofweek({t}) NOT IN (0, 6) AND hour({t}) BETWEEN 7 AND 9 THEN 'morning_rush'
              WHEN dayofweek({t}) NOT IN (0, 6) AND hour({t}) BETWEEN 17 AND 19 THEN 'evening_rush'
              WHEN dayofweek({t}) NOT IN (0, 6) AND hour({t}) BETWEEN 9 AND 17 THEN 'business_hours'
              WHEN hour({t}) >= 22 OR hour({t}) <= 5 THEN 'late_night'
              WHEN dayofweek({t}) IN (0, 6) THEN 'weekend' ELSE 'off_peak' END AS rush_hour_label,
         CASE WHEN hour({t}) BETWEEN 5 AND 11 THEN 'morning' WHEN hour({t}) BETWEEN 12 AND 17 THEN 'afternoon'
              WHEN hour({t}) BETWEEN 18 AND 21 THEN 'evening' ELSE 'night' END AS time_period,
         dayofweek({t}) IN (0, 6) AS is_weekend"""


def labelled_trips(spark: SparkSession, sf: str) -> DataFrame:
    """Trips with calendar and zone labels."""
    df = add_calendar(trips(spark, sf), holidays=holidays(spark))
    return label_trips(df, zones(spark, sf), cbd_zones(spark, sf), airports=None, borough=BOROUGH)


LABELLED_SQL = (
    TRIPS_SQL
    + ",\n"
    + ZONES_SQL
    + ",\n"
    + HOLIDAYS_SQL
    + """,
labelled AS (
  SELECT t.*, p.Borough AS PU_Borough, p.Zone AS PU_Zone, p.service_zone AS PU_service_zone,
         d.Borough AS DO_Borough, d.Zone AS DO_Zone, d.service_zone AS DO_service_zone,
         p.in_cbd AS PU_in_cbd, d.in_cbd AS DO_in_cbd,
         CASE WHEN p.in_cbd = 1 AND d.in_cbd = 1 THEN 'intra_cbd' WHEN p.in_cbd = 1 THEN 'outbound_cbd'
              WHEN d.in_cbd = 1 THEN 'inbound_cbd' ELSE 'non_cbd' END AS trip_cbd_type,
         p.Borough <> d.Borough AS is_cross_borough,
         p.Borough = 'ASIA' OR d.Borough = 'ASIA' AS involves_manhattan,
         p.service_zone = 'Airports' OR d.service_zone = 'Airports' AS involves_airport,
         h.holiday_name, h.holiday_name IS NOT NULL AS is_holiday,"""
    + LABELS_SQL.format(t="t.pickup_datetime")
    + """
  FROM trips t JOIN zones p ON t.PULocationID = p.LocationID JOIN zones d ON t.DOLocationID = d.LocationID
  LEFT JOIN holidays h ON t.pickup_date = h.holiday_date)"""
)


def station_records(spark: SparkSession, sf: str) -> DataFrame:
    """Raw station-day text: stations are order priorities, measurements derive from prices and keys."""
    daily = (
        table(spark, sf, "orders")
        .groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day"))
        .agg(
            F.max("o_totalprice").alias("hi"),
            F.min("o_totalprice").alias("lo"),
            F.sum("o_orderkey").alias("k"),
            F.sum("o_custkey").alias("w"),
        )
    )

    def when(mod: int, **cases):
        slot = F.col("k") % mod
        chain = F
        for value, text in cases.items():
            chain = chain.when(slot == int(value[1:]), F.lit(text).cast("string"))
        return chain

    return daily.select(
        F.col("o_orderpriority").alias("STATION"),
        F.col("o_orderpriority").alias("NAME"),
        F.col("day").cast("string").alias("DATE"),
        F.when(F.col("k") % 41 != 0, (F.col("hi") / 5000).cast("string")).otherwise("").alias("TMAX"),
        F.when(F.col("k") % 43 != 0, (F.col("lo") / 10000).cast("string")).alias("TMIN"),
        F.when(F.col("k") % 3 == 0, (F.col("hi") / 7500).cast("string")).alias("TAVG"),
        when(7, _0="T", _1="", _2=" 0.05 ", _3="0.3", _4="0.9", _5="1.5", _6=None).alias("PRCP"),
        when(11, _0="2.0", _1="0.5", _2="T", _3="").alias("SNOW"),
        when(13, _0="4.0", _1="T").alias("SNWD"),
        F.when(F.col("w") % 17 == 0, "").otherwise((F.col("w") % 31).cast("string")).alias("AWND"),
        when(5, _0="1").alias("WT01"),
        when(19, _0="1").alias("WT02"),
        when(23, _0="1").alias("WT03"),
        when(29, _0="1").alias("WT04"),
        when(31, _0="1").alias("WT05"),
        when(37, _0="1").alias("WT06"),
        when(47, _0="1").alias("WT08"),
    )


STATIONS_SQL = """station AS (
  SELECT o_orderpriority AS STATION, CAST(o_orderdate AS DATE) AS weather_date,
         max(o_totalprice) / 5000 AS hi, min(o_totalprice) / 10000 AS lo, max(o_totalprice) / 7500 AS av,
         CAST(sum(o_orderkey) AS BIGINT) AS k, CAST(sum(o_custkey) AS BIGINT) AS w
  FROM orders GROUP BY ALL)"""

IMPERIAL_SQL = (
    STATIONS_SQL
    + """,
metric AS (
  SELECT STATION, weather_date, k,
         CASE WHEN k % 41 <> 0 AND hi BETWEEN -50 AND 120 THEN (hi - 32) * 5 / 9 END AS tmax_c,
         CASE WHEN k % 43 <> 0 AND lo BETWEEN -60 AND 100 THEN (lo - 32) * 5 / 9 END AS tmin_c,
         CASE WHEN k % 3 = 0 AND av BETWEEN -55 AND 110 THEN (av - 32) * 5 / 9 END AS tavg_c,
         CASE k % 7 WHEN 0 THEN 0.01 WHEN 2 THEN 0.05 WHEN 3 THEN 0.3 WHEN 4 THEN 0.9 WHEN 5 THEN 1.5
              ELSE 0 END::DOUBLE * 25.4::DOUBLE AS precipitation_mm,
         CASE k % 11 WHEN 0 THEN 2.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.01 ELSE 0 END::DOUBLE * 2.54::DOUBLE AS snow_cm,
         CASE k % 13 WHEN 0 THEN 4.0 WHEN 1 THEN 0.01 ELSE 0 END::DOUBLE * 2.54::DOUBLE AS snow_depth_cm,
         CASE WHEN w % 17 <> 0 THEN (w % 31)::DOUBLE * 1.60934::DOUBLE END AS wind_speed_kmh,
         CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS fog_mist, CASE WHEN k % 19 = 0 THEN 1 ELSE 0 END AS heavy_fog
  FROM station),
imperial AS (
  SELECT *, coalesce(tavg_c, (tmax_c + tmin_c) / 2) AS temp_avg_calculated, tmax_c - tmin_c AS temp_range_c,
         CASE WHEN fog_mist = 1 OR heavy_fog = 1 THEN 1 ELSE 0 END AS fog_flag,
         CASE WHEN precipitation_mm > 0 THEN 1 ELSE 0 END AS is_precipitation,
         CASE WHEN precipitation_mm > 0 AND precipitation_mm <= 2.5 THEN 1 ELSE 0 END AS is_light_rain,
         CASE WHEN precipitation_mm > 2.5 AND precipitation_mm <= 10 THEN 1 ELSE 0 END AS is_moderate_rain,
         CASE WHEN precipitation_mm > 10 AND precipitation_mm <= 25 THEN 1 ELSE 0 END AS is_heavy_rain,
         CASE WHEN precipitation_mm > 25 THEN 1 ELSE 0 END AS is_extreme_rain,
         CASE WHEN snow_cm > 0 THEN 1 ELSE 0 END AS is_snow,
         CASE WHEN snow_cm > 0 AND snow_cm <= 2.5 THEN 1 ELSE 0 END AS is_light_snow,
         CASE WHEN snow_cm > 2.5 THEN 1 ELSE 0 END AS is_heavy_snow,
         CASE WHEN tmin_c <= 0 THEN 1 ELSE 0 END AS is_freezing,
         CASE WHEN tmax_c > -5 AND tmax_c <= 0 THEN 1 ELSE 0 END AS is_very_cold,
         CASE WHEN tmax_c > 0 AND tmax_c <= 5 THEN 1 ELSE 0 END AS is_cold,
         CASE WHEN tmax_c > 5 AND tmax_c <= 15 THEN 1 ELSE 0 END AS is_cool,
         CASE WHEN tmax_c > 15 AND tmax_c <= 20 THEN 1 ELSE 0 END AS is_mild,
         CASE WHEN tmax_c > 20 AND tmax_c <= 25 THEN 1 ELSE 0 END AS is_warm,
         CASE WHEN tmax_c >= 30 THEN 1 ELSE 0 END AS is_hot,
         CASE WHEN tmax_c >= 35 THEN 1 ELSE 0 END AS is_extreme_heat,
         CASE WHEN month(weather_date) IN (12, 1, 2) THEN 'winter' WHEN month(weather_date) IN (3, 4, 5) THEN 'spring'
              WHEN month(weather_date) IN (6, 7, 8) THEN 'summer' ELSE 'fall' END AS season
  FROM metric),
weather AS (
  SELECT *, CASE
      WHEN temp_avg_calculated BETWEEN 18 AND 24 AND precipitation_mm = 0 THEN 5
      WHEN temp_avg_calculated BETWEEN 15 AND 27 AND precipitation_mm <= 1 THEN 4
      WHEN temp_avg_calculated BETWEEN 10 AND 30 AND precipitation_mm <= 5 THEN 3
      WHEN temp_avg_calculated BETWEEN 0 AND 35 AND precipitation_mm <= 20 THEN 2 ELSE 1 END AS weather_comfort_index
  FROM imperial)"""
)

DAY_SQL = (
    IMPERIAL_SQL
    + """,
day AS (
  SELECT weather_date, avg(temp_avg_calculated) AS temp_avg_calculated, max(is_freezing) AS is_freezing,
         max(is_hot) AS is_hot, max(precipitation_mm) AS precipitation_mm, max(is_snow) AS is_snow,
         avg(wind_speed_kmh) AS wind_speed_kmh, max(fog_flag) AS fog_flag,
         avg(weather_comfort_index) AS weather_comfort_index, max(season) AS season
  FROM weather GROUP BY weather_date)"""
)


# One row per date with the classes that the profiles of days count.
CLASSES_SQL = (
    IMPERIAL_SQL
    + """,
classes AS (
  SELECT weather_date, avg(tmax_c) AS tmax_c, avg(tmin_c) AS tmin_c, avg(temp_avg_calculated) AS temp_avg_calculated,
         max(precipitation_mm) AS precipitation_mm, avg(weather_comfort_index) AS weather_comfort_index,
         max(is_precipitation) AS is_precipitation, max(is_snow) AS is_snow, max(fog_mist) AS fog_mist,
         max(is_very_cold) AS is_very_cold, max(is_extreme_heat) AS is_extreme_heat, max(season) AS season
  FROM weather GROUP BY weather_date),
days AS (
  SELECT *, CASE WHEN precipitation_mm > 0 AND precipitation_mm <= 2.5 THEN 1 ELSE 0 END AS is_light_rain,
         CASE WHEN precipitation_mm > 2.5 AND precipitation_mm <= 10 THEN 1 ELSE 0 END AS is_moderate_rain,
         CASE WHEN precipitation_mm > 10 AND precipitation_mm <= 25 THEN 1 ELSE 0 END AS is_heavy_rain,
         CASE WHEN precipitation_mm > 25 THEN 1 ELSE 0 END AS is_extreme_rain FROM classes)"""
)


def station_weather(spark: SparkSession, sf: str) -> DataFrame:
    return clean_imperial(station_records(spark, sf))


def daily_weather(spark: SparkSession, sf: str) -> DataFrame:
    return station_to_day(station_weather(spark, sf))


def profiled_days(spark: SparkSession, sf: str) -> DataFrame:
    return day_classes(station_weather(spark, sf))


def weather_trips(spark: SparkSession, sf: str) -> DataFrame:
    """Trips with the weather of their pickup date."""
    return join_weather(trips(spark, sf), daily_weather(spark, sf), unique=False)


WEATHER_TRIPS_SQL = (
    TRIPS_SQL
    + ",\n"
    + DAY_SQL
    + """,
wtrips AS (SELECT t.*, d.* EXCLUDE (weather_date) FROM trips t LEFT JOIN day d ON t.pickup_date = d.weather_date)"""
)
