"""Dimension files: zones, CBD mapping, holidays and raw station records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareframe.operators.setops import dedupe_key
from fareframe.schemas import STATION_SCHEMA, ZONE_SCHEMA


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def keyed(df: DataFrame, key: str) -> DataFrame:
    """Rows with a key, one per key (the first by the remaining columns)."""
    others = [c for c in df.columns if c != key]
    present = df.where(F.col(key).isNotNull())
    return dedupe_key(present, [key], others) if others else present.distinct()


def read_zone_dim(spark: SparkSession, path: str) -> DataFrame:
    raw = _csv(spark, path)
    cols = [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in ZONE_SCHEMA if f.name in raw.columns]
    return keyed(raw.select(cols), "LocationID")


def read_flag_dim(spark: SparkSession, path: str, keep: int | None = 1) -> DataFrame:
    """Zone to 0/1 mapping; ``keep`` retains only the zones with that flag."""
    raw = _csv(spark, path).select(
        F.col("LocationID").try_cast("int").alias("LocationID"), F.col("in_cbd").try_cast("int").alias("in_cbd")
    )
    dim = keyed(raw, "LocationID")
    return dim if keep is None else dim.where(F.col("in_cbd") == keep)


def read_holiday_dim(spark: SparkSession, path: str) -> DataFrame:
    raw = _csv(spark, path).select(F.col("date").try_cast("date").alias("holiday_date"), "holiday_name")
    return keyed(raw, "holiday_date")


def read_weather_raw(spark: SparkSession, path: str) -> DataFrame:
    """Station records, every column as text; columns the file lacks come back null."""
    raw = _csv(spark, path)
    cols = [
        F.col(f.name) if f.name in raw.columns else F.lit(None).cast(T.StringType()).alias(f.name)
        for f in STATION_SCHEMA
    ]
    return raw.select(cols)
