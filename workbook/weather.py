"""Station cleaning, day rollups, weather quality and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from fareframe.functions import weather as U
from fareframe.operators import joins, profile
from fareframe.operators import weather as W
from fareframe.operators.profile import centred_mean
from workbook import views as V
from workbook.registry import query, rounded

IMPERIAL_OUT = """STATION, CAST(weather_date AS VARCHAR) AS weather_date, season, tmax_c, tmin_c, tavg_c, temp_avg_calculated,
    temp_range_c, precipitation_mm, snow_cm, snow_depth_cm, wind_speed_kmh, is_precipitation, is_light_rain,
    is_moderate_rain, is_heavy_rain, is_extreme_rain, is_snow, is_light_snow, is_heavy_snow, is_freezing, is_very_cold,
    is_cold, is_cool, is_mild, is_warm, is_hot, is_extreme_heat, fog_mist, heavy_fog, fog_flag, weather_comfort_index"""


def date_text():
    return F.col("weather_date").cast("string").alias("weather_date")



@query("q_weather_clean_f", f"WITH {V.IMPERIAL_SQL} SELECT {IMPERIAL_OUT} FROM weather")
def clean_f(spark, sf):
    cols = [c.strip() for c in IMPERIAL_OUT.replace("CAST(weather_date AS VARCHAR) AS weather_date", "weather_date").split(",")]
    return V.station_weather(spark, sf).select([date_text() if c == "weather_date" else c for c in cols])


def tenths_sql(factor: float, heavy: str) -> str:
    return (
        V.STATIONS_SQL
        + f""",
tenth AS (
  SELECT STATION, weather_date, CASE WHEN k % 41 <> 0 THEN hi / 10 END AS tmax_c, CASE WHEN k % 43 <> 0 THEN lo / 10 END AS tmin_c,
         CASE k % 7 WHEN 2 THEN 0.05 WHEN 3 THEN 0.3 WHEN 4 THEN 0.9 WHEN 5 THEN 1.5 ELSE 0 END::DOUBLE / 10
           AS precipitation_mm,
         CASE WHEN k % 11 IN (0, 1) THEN 1 ELSE 0 END AS is_snow,
         CASE WHEN w % 17 <> 0 THEN (w % 31)::DOUBLE * {factor}::DOUBLE ELSE 0 END AS wind_speed_kmh,
         CASE WHEN k % 5 = 0 OR {heavy} THEN 1 ELSE 0 END AS fog_flag
  FROM station),
scored AS (
  SELECT *, (tmax_c + tmin_c) / 2 AS t FROM tenth
  WHERE (tmax_c IS NULL OR tmin_c IS NULL OR tmax_c >= tmin_c)
    AND (tmax_c IS NULL OR tmax_c BETWEEN -30 AND 45) AND (tmin_c IS NULL OR tmin_c BETWEEN -35 AND 35)),
tenths AS (
  SELECT STATION, weather_date, t AS temp_avg_calculated, precipitation_mm, is_snow, wind_speed_kmh, fog_flag,
         CASE WHEN tmin_c <= 0 THEN 1 ELSE 0 END AS is_freezing, CASE WHEN tmax_c >= 30 THEN 1 ELSE 0 END AS is_hot,
         CASE WHEN t BETWEEN 15 AND 25 AND precipitation_mm = 0 AND wind_speed_kmh < 20 THEN 5
              WHEN t BETWEEN 10 AND 30 AND precipitation_mm < 5 AND wind_speed_kmh < 30 THEN 4
              WHEN t BETWEEN 0 AND 35 AND precipitation_mm < 10 THEN 3
              WHEN t BETWEEN -10 AND 40 THEN 2 ELSE 1 END AS weather_comfort_index
  FROM scored)"""
    )


TENTHS_OUT = """STATION, CAST(weather_date AS VARCHAR) AS weather_date, temp_avg_calculated, precipitation_mm, is_snow,
    wind_speed_kmh, fog_flag, is_freezing, is_hot, weather_comfort_index"""


def _tenths(df):
    cols = ["STATION", date_text(), "temp_avg_calculated", "precipitation_mm", "is_snow", "wind_speed_kmh", "fog_flag",
            "is_freezing", "is_hot", "weather_comfort_index"]
    return df.select(cols)


@query("q_weather_clean_tenths", f"WITH {tenths_sql(0.36, 'k % 19 = 0')} SELECT {TENTHS_OUT} FROM tenths")
def clean_tenths(spark, sf):
    return _tenths(W.clean_weather(V.station_records(spark, sf), "tenths"))


@query("q_weather_tenths_published", f"WITH {tenths_sql(0.036, 'k % 31 = 0')} SELECT {TENTHS_OUT} FROM tenths")
def clean_published(spark, sf):
    options = {"wind_factor": U.KMH_PER_TENTH_MPS_PUBLISHED, "heavy_fog": "WT05"}
    return _tenths(W.clean_weather(V.station_records(spark, sf), "tenths", **options))


DAY_MEANS = ["temp_avg_calculated", "wind_speed_kmh", "weather_comfort_index"]
DAY_OUT = """CAST(weather_date AS VARCHAR) AS weather_date, round(temp_avg_calculated, 9) AS temp_avg_calculated, is_freezing,
    is_hot, precipitation_mm, is_snow, round(wind_speed_kmh, 9) AS wind_speed_kmh, fog_flag,
    round(weather_comfort_index, 9) AS weather_comfort_index, season"""


@query("q_station_to_day", f"WITH {V.DAY_SQL} SELECT {DAY_OUT} FROM day")
def station_day(spark, sf):
    return rounded(V.daily_weather(spark, sf), DAY_MEANS, 9).drop("year", "month").withColumn("weather_date", date_text())


@query(
    "q_weather_core",
    f"""WITH {V.IMPERIAL_SQL} SELECT CAST(weather_date AS VARCHAR) AS weather_date,
    CAST(year(weather_date) AS INTEGER) AS year, CAST(month(weather_date) AS INTEGER) AS month, season,
    temp_avg_calculated, is_freezing, is_hot, precipitation_mm, is_snow, wind_speed_kmh, weather_comfort_index, fog_flag
    FROM weather""",
)
def core(spark, sf):
    stations = V.station_weather(spark, sf).drop("fog_flag")
    return W.select_weather_core(stations).withColumn("weather_date", date_text())


@query(
    "q_day_rollup_min",
    f"""WITH {V.STATIONS_SQL} SELECT CAST(weather_date AS VARCHAR) AS weather_date, count(*) AS station_count,
    CASE WHEN month(weather_date) IN (12, 1, 2) THEN 'winter' WHEN month(weather_date) IN (3, 4, 5) THEN 'spring'
         WHEN month(weather_date) IN (6, 7, 8) THEN 'summer' ELSE 'fall' END AS season FROM station GROUP BY weather_date""",
)
def rollup_min(spark, sf):
    return W.day_rollup_min(V.station_records(spark, sf)).select(date_text(), "station_count", "season")


@query(
    "q_pick_stations",
    f"""WITH {V.STATIONS_SQL}, top AS (SELECT STATION FROM station GROUP BY 1 ORDER BY count(*) DESC, STATION LIMIT 3)
    SELECT STATION, count(*) AS n FROM station WHERE STATION IN (SELECT STATION FROM top) GROUP BY 1""",
)
def pick(spark, sf):
    raw = V.station_records(spark, sf)
    chosen = W.pick_stations(raw, ["NOT-A-STATION"], fallback=3)
    return profile.value_counts(W.only_stations(raw, chosen), "STATION")


@query(
    "q_join_weather",
    f"""WITH {V.WEATHER_TRIPS_SQL} SELECT season, is_snow, fog_flag, count(*) AS n,
    round(avg(commission), 6) AS avg_commission, round(avg(temp_avg_calculated), 6) AS temp FROM wtrips GROUP BY 1, 2, 3""",
)
def join_weather(spark, sf):
    g = V.weather_trips(spark, sf).groupBy("season", "is_snow", "fog_flag")
    return rounded(
        g.agg(F.count(F.lit(1)).alias("n"), F.avg("commission").alias("avg_commission"), F.avg("temp_avg_calculated").alias("temp")),
        ["avg_commission", "temp"],
    )


@query(
    "q_join_coverage",
    f"""WITH {V.TRIPS_SQL}, {V.DAY_SQL}, cool AS (SELECT * FROM day WHERE is_freezing = 1)
    SELECT count(is_freezing) AS matched, count(*) AS total, count(is_freezing) / count(*) * 100 AS coverage_pct, 0 AS no_match
    FROM trips LEFT JOIN cool ON pickup_date = weather_date""",
)
def coverage(spark, sf):
    cold = V.daily_weather(spark, sf).where("is_freezing = 1")
    return joins.join_coverage(joins.join_weather(V.trips(spark, sf), cold), "is_freezing")


# The same figures, counted straight from the rules that shape the raw text.
QUALITY_SQL = f"""WITH {V.STATIONS_SQL}, f AS (
  SELECT count(*) AS n, count(DISTINCT STATION) AS stations, max(weather_date) - min(weather_date) AS span,
    count(*) FILTER (k % 41 <> 0) AS tmax, count(*) FILTER (k % 43 <> 0) AS tmin, count(*) FILTER (k % 3 = 0) AS tavg,
    count(*) FILTER (k % 7 BETWEEN 2 AND 5) AS prcp, count(*) FILTER (k % 7 IN (1, 6)) AS prcp_gone,
    count(*) FILTER (k % 11 IN (0, 1)) AS snow, count(*) FILTER (k % 11 NOT IN (0, 1, 2)) AS snow_gone,
    count(*) FILTER (w % 17 <> 0) AS awnd,
    count(*) FILTER (k % 41 <> 0 AND (hi > 120 OR hi < -50) OR k % 43 <> 0 AND (lo > 100 OR lo < -60)) AS extreme,
    count(*) FILTER (k % 41 <> 0 AND k % 43 <> 0 AND hi < lo) AS crossed FROM station)
SELECT metric, value::DOUBLE AS value FROM (
  SELECT unnest([
    {{'metric': 'total_records', 'value': n::DOUBLE}}, {{'metric': 'station_count', 'value': stations}},
    {{'metric': 'valid_dates', 'value': n}}, {{'metric': 'date_span_days', 'value': span}},
    {{'metric': 'TMAX_present', 'value': tmax}}, {{'metric': 'TMIN_present', 'value': tmin}},
    {{'metric': 'TAVG_present', 'value': tavg}}, {{'metric': 'PRCP_present', 'value': prcp}},
    {{'metric': 'SNOW_present', 'value': snow}}, {{'metric': 'AWND_present', 'value': awnd}},
    {{'metric': 'TMAX_missing', 'value': n - tmax}}, {{'metric': 'TMIN_missing', 'value': n - tmin}},
    {{'metric': 'TAVG_missing', 'value': n - tavg}}, {{'metric': 'PRCP_missing', 'value': prcp_gone}},
    {{'metric': 'SNOW_missing', 'value': snow_gone}}, {{'metric': 'AWND_missing', 'value': n - awnd}},
    {{'metric': 'extreme_temperature', 'value': extreme}}, {{'metric': 'negative_precipitation', 'value': 0}},
    {{'metric': 'max_below_min', 'value': crossed}},
    {{'metric': 'TMAX_present_pct', 'value': tmax / n * 100}}, {{'metric': 'TMIN_present_pct', 'value': tmin / n * 100}},
    {{'metric': 'TAVG_present_pct', 'value': tavg / n * 100}}, {{'metric': 'PRCP_present_pct', 'value': prcp / n * 100}},
    {{'metric': 'SNOW_present_pct', 'value': snow / n * 100}}, {{'metric': 'AWND_present_pct', 'value': awnd / n * 100}},
    {{'metric': 'advise_interpolation', 'value': CASE WHEN tmax / n * 100 < 80 THEN 1 ELSE 0 END}},
    {{'metric': 'precipitation_sufficient', 'value': CASE WHEN prcp / n * 100 > 70 THEN 1 ELSE 0 END}}
  ], recursive := true) FROM f)"""


@query("q_weather_quality", QUALITY_SQL)
def quality(spark, sf):
    return W.weather_quality(V.station_records(spark, sf))


@query(
    "q_weather_by_year",
    f"WITH {V.STATIONS_SQL} SELECT CAST(year(weather_date) AS INTEGER) AS year, count(*) AS n FROM station GROUP BY 1",
)
def by_year(spark, sf):
    return W.records_by_year(V.station_records(spark, sf))


@query(
    "q_station_completeness",
    f"""WITH {V.STATIONS_SQL}, s AS (
      SELECT STATION, count(*) AS records, count(*) FILTER (k % 41 <> 0 OR k % 43 <> 0) AS a,
             count(*) FILTER (k % 41 <> 0 AND k % 43 <> 0) AS b FROM station GROUP BY 1),
    top AS (SELECT * FROM s ORDER BY records DESC, STATION LIMIT 4),
    best AS (SELECT * FROM s ORDER BY b / records DESC, records DESC, STATION DESC LIMIT 1)
    SELECT STATION, STATION AS NAME, records, a / records * 100 AS any_temp_pct, b / records * 100 AS both_temp_pct,
           CASE WHEN STATION = (SELECT STATION FROM best) THEN 1 ELSE 0 END AS is_best
    FROM (SELECT * FROM top UNION SELECT * FROM best)""",
)
def completeness(spark, sf):
    return W.station_completeness(V.station_records(spark, sf), 4)


@query(
    "q_monthly_weather",
    f"""WITH {V.CLASSES_SQL} SELECT strftime(weather_date, '%Y-%m') AS ym, round(avg(tmax_c), 9) AS tmax_c,
    round(avg(tmin_c), 9) AS tmin_c, round(avg(temp_avg_calculated), 9) AS temp_avg,
    round(sum(precipitation_mm), 9) AS precipitation_mm, round(avg(weather_comfort_index), 9) AS comfort,
    CAST(sum(is_snow) AS BIGINT) AS snow_days FROM days GROUP BY 1""",
)
def monthly(spark, sf):
    df = W.monthly_weather(V.profiled_days(spark, sf))
    return rounded(df, ["tmax_c", "tmin_c", "temp_avg", "precipitation_mm", "comfort"], 9)


@query(
    "q_monthly_extremes",
    f"""WITH {V.CLASSES_SQL} SELECT CAST(month(weather_date) AS INTEGER) AS month, round(min(tmax_c), 9) AS tmax_min,
    round(max(tmax_c), 9) AS tmax_max, round(min(tmin_c), 9) AS tmin_min, round(max(tmin_c), 9) AS tmin_max FROM days GROUP BY 1""",
)
def extremes(spark, sf):
    return rounded(W.monthly_extremes(V.profiled_days(spark, sf)), ["tmax_min", "tmax_max", "tmin_min", "tmin_max"], 9)


@query(
    "q_season_profile",
    f"""WITH {V.CLASSES_SQL} SELECT season, count(*) AS days, round(sum(precipitation_mm), 6) AS precip_sum,
    round(avg(precipitation_mm), 6) AS precip_mean, round(avg(weather_comfort_index), 6) AS comfort_mean
    FROM days GROUP BY 1""",
)
def seasons(spark, sf):
    return rounded(W.season_profile(V.profiled_days(spark, sf)), ["precip_sum", "precip_mean", "comfort_mean"])


def _union(cases: dict[str, str]) -> str:
    parts = [f"SELECT '{n}' AS condition, count(*) AS days FROM days WHERE {w}" for n, w in cases.items()]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE days > 0"


@query(
    "q_condition_counts",
    f"WITH {V.CLASSES_SQL} "
    + _union(
        {
            "clear": "is_precipitation = 0", "light_rain": "is_light_rain = 1", "moderate_rain": "is_moderate_rain = 1",
            "heavy_rain": "is_heavy_rain = 1", "snow": "is_snow = 1",
        }
    ),
)
def conditions(spark, sf):
    return W.condition_counts(V.profiled_days(spark, sf))


@query(
    "q_rain_intensity",
    f"WITH {V.CLASSES_SQL} "
    + _union(
        {
            "no_rain": "precipitation_mm = 0", "light_rain": "is_light_rain = 1", "moderate_rain": "is_moderate_rain = 1",
            "heavy_rain": "is_heavy_rain = 1", "extreme_rain": "is_extreme_rain = 1",
        }
    ),
)
def intensity(spark, sf):
    return W.rain_intensity_counts(V.profiled_days(spark, sf))


@query(
    "q_weather_impact",
    f"WITH {V.CLASSES_SQL} "
    + _union(
        {
            "heavy_precipitation": "is_heavy_rain = 1 OR is_extreme_rain = 1", "snow": "is_snow = 1",
            "extreme_cold": "is_very_cold = 1", "extreme_heat": "is_extreme_heat = 1", "fog": "fog_mist = 1",
        }
    ),
)
def impact(spark, sf):
    return W.impact_counts(V.profiled_days(spark, sf))


@query(
    "q_comfort_counts",
    f"WITH {V.CLASSES_SQL} SELECT round(weather_comfort_index) AS comfort, count(*) AS n FROM days GROUP BY 1",
)
def comfort(spark, sf):
    days = V.profiled_days(spark, sf).withColumn("comfort", F.round("weather_comfort_index"))
    return profile.value_counts(days, "comfort")


@query(
    "q_weather_insights",
    f"""WITH {V.CLASSES_SQL} SELECT round(avg(is_precipitation) * 100, 6) AS rainy_pct,
    round(sum(is_extreme_heat + is_very_cold + is_heavy_rain + is_snow) / count(*) * 100, 6) AS extreme_pct,
    round(avg(CASE WHEN weather_comfort_index = 5 THEN 1 ELSE 0 END) * 100, 6) AS perfect_pct,
    round(avg(weather_comfort_index) FILTER (season = 'summer')
        - avg(weather_comfort_index) FILTER (season = 'winter'), 6) AS summer_winter_gap FROM days""",
)
def insights(spark, sf):
    df = W.weather_insights(V.profiled_days(spark, sf))
    return rounded(df, df.columns)


@query(
    "q_group_means",
    f"""WITH {V.WEATHER_TRIPS_SQL} SELECT CAST(floor(weather_comfort_index) AS BIGINT) AS comfort,
    round(avg(trip_miles), 2) AS avg_trip_miles, round(avg(trip_time), 2) AS avg_trip_time FROM wtrips GROUP BY 1""",
)
def comfort_means(spark, sf):
    df = V.weather_trips(spark, sf).withColumn("comfort", F.floor("weather_comfort_index"))
    return profile.group_means(df, ["comfort"], ["trip_miles", "trip_time"])


@query(
    "q_centred_mean",
    f"""WITH {V.DAY_SQL}, r AS (SELECT weather_date,
      count(temp_avg_calculated) OVER w AS c, avg(temp_avg_calculated) OVER w AS m FROM day
      WINDOW w AS (ORDER BY weather_date ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING))
    SELECT CAST(weather_date AS VARCHAR) AS weather_date, CASE WHEN c = 30 THEN round(m, 6) END AS temp_rolling FROM r""",
)
def rolling(spark, sf):
    days = V.daily_weather(spark, sf).select("weather_date", F.col("temp_avg_calculated").alias("temp"))
    return rounded(centred_mean(days, "weather_date", "temp"), ["temp_rolling"]).select(date_text(), "temp_rolling")


def _weather_means(spark, sf, fn, **kw):
    return rounded(fn(V.weather_trips(spark, sf), **kw), ["avg_commission", "avg_cpm"])


MEANS_SQL = "round(avg(commission), 6) AS avg_commission, round(avg(y_cpm), 6) AS avg_cpm, count(*) AS trips"


@query(
    "q_temp_bins",
    f"""WITH {V.WEATHER_TRIPS_SQL} SELECT CAST(floor(temp_avg_calculated / 5) * 5 AS INTEGER) AS temp_bin, {MEANS_SQL}
    FROM wtrips GROUP BY 1""",
)
def temp_bins(spark, sf):
    return _weather_means(spark, sf, profile.temperature_profile)


@query(
    "q_precip_bins",
    f"""WITH {V.WEATHER_TRIPS_SQL} SELECT CASE WHEN precipitation_mm <= 0 THEN '0' WHEN precipitation_mm <= 2 THEN '0-2'
    WHEN precipitation_mm <= 5 THEN '2-5' WHEN precipitation_mm <= 10 THEN '5-10' WHEN precipitation_mm > 10 THEN '10+' END
    AS precip_bin, {MEANS_SQL} FROM wtrips GROUP BY 1""",
)
def precip_bins(spark, sf):
    return _weather_means(spark, sf, profile.precipitation_profile)


CPM_SQL = "round(avg(y_cpm), 6) AS avg_cpm, count(*) AS trips FROM wtrips WHERE y_cpm > 0"


@query(
    "q_temp_response",
    f"WITH {V.WEATHER_TRIPS_SQL} SELECT round(temp_avg_calculated / 5.0::DOUBLE) * 5 AS temp_bin, {CPM_SQL} GROUP BY 1",
)
def temp_response(spark, sf):
    return rounded(profile.weather_response(V.weather_trips(spark, sf), "temperature"), ["avg_cpm"])


@query(
    "q_precip_response",
    f"""WITH {V.WEATHER_TRIPS_SQL} SELECT CASE WHEN precipitation_mm <= 0 THEN '0' WHEN precipitation_mm <= 1 THEN '0-1'
    WHEN precipitation_mm <= 3 THEN '1-3' WHEN precipitation_mm <= 10 THEN '3-10' WHEN precipitation_mm > 10 THEN '>10' END
    AS precip_bin, is_snow, {CPM_SQL} GROUP BY 1, 2""",
)
def precip_response(spark, sf):
    return rounded(profile.weather_response(V.weather_trips(spark, sf), "precipitation"), ["avg_cpm"])


@query(
    "q_wind_bins",
    f"""WITH {V.WEATHER_TRIPS_SQL} SELECT CASE WHEN wind_speed_kmh <= 5 THEN '0-5' WHEN wind_speed_kmh <= 10 THEN '5-10'
    WHEN wind_speed_kmh <= 20 THEN '10-20' WHEN wind_speed_kmh > 20 THEN '>20' END AS wind_bin, {CPM_SQL} GROUP BY 1""",
)
def wind_response(spark, sf):
    return rounded(profile.weather_response(V.weather_trips(spark, sf), "wind"), ["avg_cpm"])


FLAGS = ["is_hot", "is_freezing", "is_snow", "fog_flag"]


@query(
    "q_flag_profiles",
    f"WITH {V.WEATHER_TRIPS_SQL} "
    + " UNION ALL ".join(f"SELECT '{f}' AS flag, {f} AS level, {MEANS_SQL} FROM wtrips GROUP BY 2" for f in FLAGS),
)
def flags(spark, sf):
    df = profile.flag_profiles(V.weather_trips(spark, sf), FLAGS)
    return rounded(df, ["avg_commission", "avg_cpm"])
