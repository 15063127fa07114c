"""Hour grids and the calendar features of each hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareframe.functions import calendar as C
from fareframe.operators.joins import join_holidays


def add_calendar(df: DataFrame, ts: str = "pickup_datetime", holidays: DataFrame | None = None) -> DataFrame:
    """Date, hour, weekday, month, year, weekend, rush and time-of-day features of a timestamp."""
    at = F.col(ts)
    df = df.withColumns(
        {
            "pickup_date": F.to_date(at),
            "pickup_hour": F.hour(at),
            "pickup_day_of_week": C.day_of_week(at),
            "pickup_month": F.month(at),
            "pickup_year": F.year(at),
            "is_weekend": C.weekend(C.day_of_week(at)),
        }
    )
    if holidays is not None:
        df = join_holidays(df, holidays)
    label = C.rush_label(F.col("pickup_hour"), F.col("is_weekend"))
    return df.withColumns(
        {"rush_hour_label": label, "is_rush_hour": C.is_rush(label), "time_period": C.time_period(F.col("pickup_hour"))}
    )


def year_month(df: DataFrame, date: str = "pickup_date") -> DataFrame:
    return df.withColumns({"year": F.year(date), "ym": F.date_format(date, "yyyy-MM")})


def hours_of(days: DataFrame, date: str, out: str = "pickup_datetime") -> DataFrame:
    """24 rows per distinct date."""
    hours = F.explode(F.sequence(F.lit(0), F.lit(23)))
    grid = days.select(F.col(date).cast("date").alias("_day")).where("_day is not null").distinct()
    return grid.select("_day", hours.alias("_hour")).select(
        (F.col("_day").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("_hour"))).alias(out)
    )


def hour_grid(spark: SparkSession, start: str, end: str, out: str = "pickup_datetime") -> DataFrame:
    """Every hour of the dates ``start`` to ``end`` (inclusive, ISO text)."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")
    )
    return hours_of(days, "day", out)


def month_grid(spark: SparkSession, year: int, month: int, out: str = "pickup_datetime") -> DataFrame:
    """Every hour of one month."""
    first, following = C.month_bounds(year, month)
    days = spark.range(1).select(F.explode(F.sequence(first, F.date_sub(following, 1))).alias("day"))
    return hours_of(days, "day", out)
