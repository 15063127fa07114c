"""Enrichment joins. Every join is an equi left join that keeps the trip rows one to one.

The dimension side is broadcast only when it is checked small (see ``sizing``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareframe.operators.setops import first_per_key, require_unique
from fareframe.operators.sizing import small_side

# Key names recognised in a zone table and date names recognised in a daily table.
ZONE_KEYS = ("LocationID", "location_id", "zone_id", "id", "LOCATIONID")
DATE_KEYS = ("weather_date", "pickup_date", "date")
HOUR_KEYS = ("pickup_hour", "hour", "hr")
OD_KEYS = ("PULocationID", "DOLocationID")


def detect_key(df: DataFrame, candidates: Sequence[str]) -> str:
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"none of {list(candidates)} in {df.columns}")


def detect_date_key(df: DataFrame) -> str:
    """A known date column name, else the first column whose name holds ``date``."""
    dated = [c for c in df.columns if "date" in c.lower()]
    return detect_key(df, (*DATE_KEYS, *dated))


def non_conflicting(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The right side's keys plus the columns the left side does not have."""
    return right.select([c for c in right.columns if c in keys or c not in left.columns])


def left_enrich(df: DataFrame, dim: DataFrame, keys: Sequence[str], unique: bool = True) -> DataFrame:
    """Left join that adds the dimension's new columns. Repeated keys fail rather than fan out."""
    added = non_conflicting(df, dim, keys)
    if len(added.columns) == len(keys):
        return df
    if unique:
        added = require_unique(added, keys)
    return df.join(small_side(added), list(keys), "left")


def join_od(df: DataFrame, od: DataFrame) -> DataFrame:
    """Origin-destination features on the zone pair."""
    return left_enrich(df, od, OD_KEYS)


def join_zone_roles(
    df: DataFrame, dim: DataFrame, prefixes: tuple[str, str] = ("PU_", "DO_"), keys: tuple[str, str] = OD_KEYS
) -> DataFrame:
    """Zone attributes for both trip ends, each under its prefix. The zone key is detected."""
    key = detect_key(dim, ZONE_KEYS)
    features = [c for c in dim.columns if c != key]
    # Checked once; both roles read the same exchange.
    dim = require_unique(dim, [key])
    for prefix, trip_key in zip(prefixes, keys):
        role = dim.select(F.col(key).alias(trip_key), *[F.col(c).alias(f"{prefix}{c}") for c in features])
        df = left_enrich(df, role, [trip_key], unique=False)
    return df


def flag_membership(df: DataFrame, key: str, members: DataFrame, member_key: str, out: str) -> DataFrame:
    """1 where the key is among the members, else 0."""
    present = members.select(F.col(member_key).alias(key)).where(F.col(key).isNotNull()).distinct()
    marked = small_side(present.withColumn("_member", F.lit(1)))
    return df.join(marked, key, "left").withColumn(out, F.coalesce("_member", F.lit(0))).drop("_member")


def flag_in_list(df: DataFrame, key: str, members: Sequence, out: str) -> DataFrame:
    """Membership in a short literal list; null is not a member."""
    return df.withColumn(out, F.when(F.col(key).isin(*members), F.lit(1)).otherwise(F.lit(0)))


def join_calendar(df: DataFrame, calendar: DataFrame, ts: str = "pickup_datetime", grain: str = "hour") -> DataFrame:
    """Calendar features per (date, hour) taken from the trip's own timestamp, or per date.

    At day grain an hourly calendar first collapses to each day's first non-null values.
    """
    calendar = calendar.drop("year", "month", *([ts] if ts in calendar.columns else []))
    date_key = detect_date_key(calendar)
    calendar = calendar.withColumnRenamed(date_key, "pickup_date")
    df = df.withColumn("pickup_date", F.to_date(ts))
    hour_key = next((c for c in HOUR_KEYS if c in calendar.columns), None)
    if grain == "hour":
        if hour_key is None:
            raise ValueError("calendar has no hour column")
        calendar = calendar.withColumnRenamed(hour_key, "pickup_hour")
        df = df.withColumn("pickup_hour", F.hour(ts))
        return left_enrich(df, calendar, ["pickup_date", "pickup_hour"])
    if grain != "day":
        raise ValueError(f"unknown grain {grain!r}")
    if hour_key is not None:
        calendar = first_per_key(calendar, ["pickup_date"], [hour_key])
        return left_enrich(df, calendar, ["pickup_date"], unique=False)
    return left_enrich(df, calendar, ["pickup_date"])


def join_temporal_exact(df: DataFrame, calendar: DataFrame, ts: str = "pickup_datetime") -> DataFrame:
    """Calendar features on the exact timestamp; only trips starting on the hour match."""
    return left_enrich(df, calendar, [ts])


def join_weather(df: DataFrame, weather: DataFrame, ts: str = "pickup_datetime", unique: bool = True) -> DataFrame:
    """Daily weather on the pickup date. ``unique=False`` skips the check for data already one row a day."""
    key = detect_date_key(weather)
    daily = weather.drop("year", "month").withColumnRenamed(key, "pickup_date")
    return left_enrich(df.withColumn("pickup_date", F.to_date(ts)), daily, ["pickup_date"], unique)


def join_holidays(df: DataFrame, holidays: DataFrame, date: str = "pickup_date") -> DataFrame:
    """``holiday_name`` and boolean ``is_holiday``."""
    dim = holidays.select(F.col("holiday_date").alias(date), "holiday_name")
    return left_enrich(df, dim, [date]).withColumn("is_holiday", F.col("holiday_name").isNotNull())


def join_coverage(df: DataFrame, col: str) -> DataFrame:
    """One row: matched rows, all rows, percentage and a zero-coverage warning flag."""
    return df.agg(F.count(col).alias("matched"), F.count(F.lit(1)).alias("total")).select(
        "matched",
        "total",
        F.when(F.col("total") > 0, F.col("matched") / F.col("total") * 100).otherwise(F.lit(0.0)).alias("coverage_pct"),
        F.when((F.col("total") > 0) & (F.col("matched") == 0), F.lit(1)).otherwise(F.lit(0)).alias("no_match"),
    )


def dim_left_profile(dim: DataFrame, profile: DataFrame, key: str) -> DataFrame:
    """Every dimension row, with nulls where the profile has no such key."""
    return dim.join(profile, key, "left")


def enrich(
    df: DataFrame,
    zones: DataFrame | None = None,
    od: DataFrame | None = None,
    calendar: DataFrame | None = None,
    weather: DataFrame | None = None,
    holidays: DataFrame | None = None,
    on_missing: str = "raise",
    require: Sequence[str] = (),
) -> tuple[DataFrame, dict[str, bool]]:
    """All external features that are given, with a map of what was joined.

    A source named in ``require`` but not given raises, or is skipped with ``on_missing='skip'``.
    """
    given = {"zones": zones, "od": od, "calendar": calendar, "weather": weather, "holidays": holidays}
    absent = [name for name in require if given[name] is None]
    if absent and on_missing != "skip":
        raise ValueError(f"missing external features: {absent}")
    if od is not None:
        df = join_od(df, od)
    if zones is not None:
        df = join_zone_roles(df, zones)
    if calendar is not None:
        df = join_calendar(df, calendar)
    if weather is not None:
        df = join_weather(df, weather)
    if holidays is not None:
        df = join_holidays(df.withColumn("pickup_date", F.to_date("pickup_datetime")), holidays)
    return df, {name: frame is not None for name, frame in given.items()}
