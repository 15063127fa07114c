"""Builds of the external feature sets: origin-destination lookup, calendar and daily weather."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareframe.operators.calendar import add_calendar, hour_grid
from fareframe.operators.setops import require_unique
from fareframe.operators.weather import clean_weather, only_stations, pick_stations, select_weather_core, station_to_day
from fareframe.operators.zones import build_od_features
from fareframe.sources.lake import write_build_manifest, write_partitioned


def _finish(spark: SparkSession, path: str, months: bool) -> DataFrame:
    """Reads the written features back and describes them in ``<path>_manifest``."""
    built = spark.read.parquet(path)
    features = [c for c in built.columns if c not in ("year", "month")]
    counts = built.select(
        F.count(F.lit(1)).alias("rows"),
        (F.count_distinct("year", "month") if months else F.lit(0).cast("bigint")).alias("months"),
    ).first()
    write_build_manifest(
        spark,
        f"{path}_manifest",
        location=path,
        features=",".join(features),
        feature_count=len(features),
        rows=counts["rows"],
        months=counts["months"],
    )
    return built


def build_spatial(zones: DataFrame, cbd: DataFrame | None, path: str, **flags) -> DataFrame:
    """Write the zone-pair lookup once; it does not change by month."""
    od = build_od_features(require_unique(zones, ["LocationID"]), cbd, **flags)
    od.write.mode("overwrite").parquet(path)
    return _finish(zones.sparkSession, path, months=False)


def build_temporal(spark: SparkSession, start: str, end: str, holidays: DataFrame, path: str) -> DataFrame:
    """Write the hourly calendar of a date range, partitioned by year and month."""
    grid = add_calendar(hour_grid(spark, start, end), holidays=holidays)
    grid = grid.withColumns({"year": F.col("pickup_year"), "month": F.col("pickup_month")})
    write_partitioned(grid, path)
    return _finish(spark, path, months=True)


def build_weather(
    raw: DataFrame, path: str, units: str, stations: Sequence[str] = (), years: Sequence[int] | None = None, **options
) -> DataFrame:
    """Clean the chosen stations, roll up to one row per date and write the core columns."""
    if stations:
        raw = only_stations(raw, pick_stations(raw, stations, fallback=3))
    daily = station_to_day(clean_weather(raw, units, **options))
    if years is not None:
        daily = daily.where(F.col("year").isin(*years))
    core = select_weather_core(daily)
    write_partitioned(core, path)
    return _finish(raw.sparkSession, path, months=True)
