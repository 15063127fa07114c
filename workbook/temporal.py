"""Calendar grids, time labels and calendar joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from fareframe.functions import calendar as C
from fareframe.operators import calendar, joins, profile, quality
from workbook import views as V
from workbook.registry import query, rounded

DAYS_SQL = """days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders),
hours AS (SELECT d + to_hours(h) AS ts FROM days, (SELECT unnest(range(24)) AS h))"""
GRID_SQL = (
    f"{DAYS_SQL}, {V.HOLIDAYS_SQL}, grid AS (SELECT ts, holiday_name, holiday_name IS NOT NULL AS is_holiday,"
    + V.LABELS_SQL.format(t="ts")
    + ", CAST(hour(ts) AS INTEGER) AS pickup_hour FROM hours LEFT JOIN holidays ON CAST(ts AS DATE) = holiday_date)"
)


@query(
    "q_calendar_grid",
    f"""WITH {GRID_SQL} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, pickup_hour,
    CAST(dayofweek(ts) AS INTEGER) AS pickup_day_of_week, CAST(month(ts) AS INTEGER) AS pickup_month,
    CAST(year(ts) AS INTEGER) AS pickup_year, is_weekend, holiday_name, is_holiday, rush_hour_label,
    rush_hour_label IN ('morning_rush', 'evening_rush') AS is_rush_hour, time_period FROM grid""",
)
def grid(spark, sf):
    df = V.calendar(spark, sf).withColumn("ts", F.date_format("pickup_datetime", "yyyy-MM-dd HH:mm:ss"))
    return df.drop("pickup_datetime", "pickup_date")


@query(
    "q_time_parts",
    """SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS pickup_date, CAST(hour(ts) AS INTEGER) AS pickup_hour,
    CAST(dayofweek(ts) AS INTEGER) AS pickup_day_of_week, CAST(month(ts) AS INTEGER) AS pickup_month,
    CAST(year(ts) AS INTEGER) AS pickup_year, strftime(ts, '%Y-%m') AS ym, dayofweek(ts) IN (0, 6) AS is_weekend FROM events""",
)
def parts(spark, sf):
    df = calendar.year_month(calendar.add_calendar(V.table(spark, sf, "events"), "ts"))
    return df.select(
        "event_id", F.col("pickup_date").cast("string").alias("pickup_date"), "pickup_hour", "pickup_day_of_week",
        "pickup_month", "pickup_year", "ym", "is_weekend",
    )


@query(
    "q_rush_labels",
    f"""WITH {V.TRIPS_SQL}, l AS (SELECT {V.LABELS_SQL.format(t="pickup_datetime")}, commission FROM trips)
    SELECT rush_hour_label, time_period, is_weekend, count(*) AS n, round(avg(commission), 6) AS mean FROM l GROUP BY 1, 2, 3""",
)
def rush(spark, sf):
    df = calendar.add_calendar(V.trips(spark, sf))
    out = df.groupBy("rush_hour_label", "time_period", "is_weekend").agg(
        F.count(F.lit(1)).alias("n"), F.avg("commission").alias("mean")
    )
    return rounded(out, ["mean"])


@query(
    "q_season_labels",
    """SELECT CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'spring'
    WHEN month(o_orderdate) IN (6, 7, 8) THEN 'summer' ELSE 'fall' END AS season, count(*) AS n FROM orders GROUP BY 1""",
)
def season(spark, sf):
    df = V.table(spark, sf, "orders").withColumn("season", C.season(F.col("o_orderdate")))
    return profile.value_counts(df, "season")


@query(
    "q_month_bounds",
    """SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
    WHERE o_orderdate >= DATE '1996-02-01' AND o_orderdate < DATE '1996-03-01'""",
)
def month(spark, sf):
    o = V.table(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate"))
    return o.where(C.in_month(F.col("d"), 1996, 2)).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query(
    "q_join_calendar",
    f"""WITH {V.TRIPS_SQL}, {GRID_SQL} SELECT rush_hour_label, is_holiday, count(*) AS n, round(avg(commission), 6) AS mean
    FROM trips LEFT JOIN grid ON date_trunc('hour', pickup_datetime) = ts GROUP BY 1, 2""",
)
def by_hour(spark, sf):
    df = joins.join_calendar(V.trips(spark, sf), V.calendar(spark, sf))
    out = df.groupBy("rush_hour_label", "is_holiday").agg(F.count(F.lit(1)).alias("n"), F.avg("commission").alias("mean"))
    return rounded(out, ["mean"])


@query(
    "q_join_calendar_day",
    f"""WITH {V.TRIPS_SQL}, {GRID_SQL} SELECT is_weekend, holiday_name, count(*) AS n
    FROM trips LEFT JOIN (SELECT * FROM grid WHERE hour(ts) = 0) ON pickup_date = CAST(ts AS DATE) GROUP BY 1, 2""",
)
def by_day(spark, sf):
    df = joins.join_calendar(V.trips(spark, sf), V.calendar(spark, sf), grain="day")
    return df.groupBy("is_weekend", "holiday_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q_join_temporal_exact",
    f"""WITH {V.TRIPS_SQL}, {GRID_SQL} SELECT time_period, count(*) AS n
    FROM trips LEFT JOIN grid ON pickup_datetime = ts AND hour(ts) < 12 GROUP BY 1""",
)
def exact(spark, sf):
    mornings = V.calendar(spark, sf).where("pickup_hour < 12").select("pickup_datetime", "time_period")
    df = joins.join_temporal_exact(V.trips(spark, sf), mornings)
    return df.groupBy("time_period").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q_join_holidays",
    f"""WITH {V.TRIPS_SQL}, {V.HOLIDAYS_SQL} SELECT holiday_name, holiday_name IS NOT NULL AS is_holiday, count(*) AS n,
    round(avg(commission), 6) AS mean FROM trips LEFT JOIN holidays ON pickup_date = holiday_date GROUP BY 1, 2""",
)
def with_holidays(spark, sf):
    df = joins.join_holidays(V.trips(spark, sf), V.holidays(spark))
    out = df.groupBy("holiday_name", "is_holiday").agg(F.count(F.lit(1)).alias("n"), F.avg("commission").alias("mean"))
    return rounded(out, ["mean"])


@query(
    "q_extent",
    """SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last,
    count(*) AS n FROM events""",
)
def extent(spark, sf):
    df = quality.extent(V.table(spark, sf, "events"), "ts")
    return df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first", "last")], "n")


@query(
    "q_temporal_insights",
    f"""WITH {V.LABELLED_SQL}, h AS (
      SELECT pickup_hour, count(*) AS n, nullif(count(*) FILTER (is_weekend), 0) AS we,
             nullif(count(*) FILTER (NOT is_weekend), 0) AS wd FROM labelled GROUP BY 1)
    SELECT (SELECT pickup_hour FROM h ORDER BY n DESC, pickup_hour LIMIT 1) AS peak_hour,
      (SELECT round(avg(we), 6) FROM h) AS weekend_hourly_mean, (SELECT round(avg(wd), 6) FROM h) AS weekday_hourly_mean,
      round(avg(trip_miles) FILTER (rush_hour_label IN ('morning_rush', 'evening_rush')), 6) AS rush_miles,
      round(avg(trip_miles) FILTER (rush_hour_label = 'off_peak'), 6) AS off_peak_miles,
      round(count(*) FILTER (is_holiday) / count(*) * 100, 6) AS holiday_pct,
      round(count(*) FILTER (pickup_hour >= 22 OR pickup_hour <= 5) / count(*) * 100, 6) AS late_night_pct
    FROM labelled""",
)
def insights(spark, sf):
    df = calendar.add_calendar(V.trips(spark, sf), holidays=V.holidays(spark))
    out = profile.temporal_insights(df)
    return rounded(out, [c for c in out.columns if c != "peak_hour"])
