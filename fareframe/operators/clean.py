"""Row filters and early column pruning for trip records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareframe.functions.calendar import duration_seconds, speed_mph
from fareframe.schemas import FARE_METRIC_COLUMNS, FEE_COLUMNS, ID_COLUMNS, REQUIRED_TRIP_COLUMNS


def provider_is(col: str, code: str) -> Column:
    """Code match after trimming and upper-casing."""
    return F.upper(F.trim(F.col(col).cast("string"))) == code


def filter_provider(df: DataFrame, col: str, code: str, normalised: bool = False) -> DataFrame:
    """Keep one provider. Codes normalised on ingest allow a plain, pushed-down equality."""
    return df.where(F.col(col) == code if normalised else provider_is(col, code))


def all_present(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def require_not_null(df: DataFrame, cols: Sequence[str] = REQUIRED_TRIP_COLUMNS) -> DataFrame:
    return df.where(all_present(cols))


def trip_is_valid(with_pay: bool = True) -> Column:
    """Non-negative distance and money, positive duration, pickup not after dropoff."""
    rule = (
        (F.col("trip_miles") >= 0)
        & (F.col("trip_time") > 0)
        & (F.col("base_passenger_fare") >= 0)
        & (F.col("pickup_datetime") <= F.col("dropoff_datetime"))
    )
    return rule & (F.col("driver_pay") >= 0) if with_pay else rule


def valid_trips(df: DataFrame, with_pay: bool = True) -> DataFrame:
    return df.where(trip_is_valid(with_pay))


def analysis_extract(df: DataFrame) -> DataFrame:
    """Timed trips plus ``duration_sec`` (the recorded trip time), ``duration_hours`` and ``mph``."""
    required = ("pickup_datetime", "dropoff_datetime", "trip_miles", "trip_time")
    return df.where(all_present(required) & (F.col("trip_time") > 0)).withColumns(
        {
            "duration_sec": F.col("trip_time"),
            "duration_hours": F.col("trip_time") / 3600.0,
            "mph": speed_mph(F.col("trip_miles"), F.col("trip_time")),
        }
    )


def with_clock_duration(df: DataFrame) -> DataFrame:
    """Duration and speed from the two timestamps; ``mph`` is null when no time passed."""
    seconds = duration_seconds(F.col("pickup_datetime"), F.col("dropoff_datetime"))
    return df.withColumn("duration_sec", seconds).withColumn(
        "mph", speed_mph(F.col("trip_miles"), F.col("duration_sec"))
    )


def drop_existing(df: DataFrame, cols: Sequence[str] = (*ID_COLUMNS, *FEE_COLUMNS, *FARE_METRIC_COLUMNS)) -> DataFrame:
    """Drop identifiers, pass-through fees and superseded ratios where present."""
    return df.drop(*cols)


def drop_negative(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col) >= 0)


def positive(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col) > 0)


def in_ranges(ranges: dict[str, tuple[float | None, float | None]]) -> Column:
    """Conjunction of inclusive ranges; ``None`` leaves an end open."""
    rule = F.lit(True)
    for col, (lo, hi) in ranges.items():
        if lo is not None:
            rule = rule & (F.col(col) >= lo)
        if hi is not None:
            rule = rule & (F.col(col) <= hi)
    return rule


def within(df: DataFrame, ranges: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    return df.where(in_ranges(ranges))


def where_sql(df: DataFrame, predicate: str) -> DataFrame:
    """Filter by a SQL text predicate."""
    return df.where(predicate)


def drop_na_zones(df: DataFrame, cols: Sequence[str] = ("PU_Borough", "DO_Borough"), marker: str = "N/A") -> DataFrame:
    """Drop rows whose borough is the marker text, or null."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c) != marker for c in cols]))
