"""Calendar rules: time parts, rush labels, seasons, month bounds, durations.

Day-of-week runs 0 = Sunday .. 6 = Saturday throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label names of the published calendar features.
RUSH_LABELS = ("morning_rush", "evening_rush", "business_hours", "late_night", "weekend", "off_peak")
TIME_PERIODS = ("morning", "afternoon", "evening", "night")
SEASONS = ("winter", "spring", "summer", "fall")


def day_of_week(ts: Column) -> Column:
    return F.dayofweek(ts) - 1


def weekend(dow: Column) -> Column:
    return dow.isin(0, 6)


def rush_label(hour: Column, is_weekend: Column) -> Column:
    """First match wins, so 9h on a weekday is still the morning rush and 17h the evening rush."""
    weekday = ~is_weekend
    return (
        F.when(weekday & hour.between(7, 9), "morning_rush")
        .when(weekday & hour.between(17, 19), "evening_rush")
        .when(weekday & hour.between(9, 17), "business_hours")
        .when((hour >= 22) | (hour <= 5), "late_night")
        .when(is_weekend, "weekend")
        .otherwise("off_peak")
    )


def is_rush(label: Column) -> Column:
    return label.isin("morning_rush", "evening_rush")


def time_period(hour: Column) -> Column:
    return (
        F.when(hour.between(5, 11), "morning")
        .when(hour.between(12, 17), "afternoon")
        .when(hour.between(18, 21), "evening")
        .otherwise("night")
    )


def season(date: Column) -> Column:
    month = F.month(date)
    return (
        F.when(month.isin(12, 1, 2), "winter")
        .when(month.between(3, 5), "spring")
        .when(month.between(6, 8), "summer")
        .when(month.isNotNull(), "fall")
    )


def month_bounds(year: int, month: int) -> tuple[Column, Column]:
    """Half-open ``[first day, first day of next month)``."""
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    return first, F.add_months(first, 1)


def in_month(date: Column, year: int, month: int) -> Column:
    first, following = month_bounds(year, month)
    return (date >= first) & (date < following)


def duration_seconds(start: Column, end: Column) -> Column:
    """Whole seconds between two timestamps, with or without a time zone (session zone must be UTC)."""
    return F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))


def speed_mph(miles: Column, seconds: Column) -> Column:
    """Miles per hour, null when no time passed."""
    return F.when(seconds > 0, miles / (seconds / 3600.0))
