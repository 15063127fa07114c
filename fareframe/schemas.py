"""Column types per layer, casting and the fixed column lists of the trip tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Public trip-record column names and the types they are cast to on ingest.
TRIP_TYPES = {
    "PULocationID": "int",
    "DOLocationID": "int",
    "trip_miles": "double",
    "trip_time": "int",
    "base_passenger_fare": "double",
    "tolls": "double",
    "bcf": "double",
    "sales_tax": "double",
    "congestion_surcharge": "double",
    "airport_fee": "double",
    "tips": "double",
    "driver_pay": "double",
}
REQUIRED_TRIP_COLUMNS = (
    "pickup_datetime",
    "dropoff_datetime",
    "PULocationID",
    "DOLocationID",
    "trip_miles",
    "trip_time",
    "base_passenger_fare",
    "driver_pay",
)
ID_COLUMNS = ("hvfhs_license_num", "dispatching_base_num", "originating_base_num", "request_datetime")
FEE_COLUMNS = ("tolls", "bcf", "sales_tax", "congestion_surcharge", "airport_fee", "tips")
FARE_METRIC_COLUMNS = ("revenue_per_mile", "revenue_per_minute")

ZONE_SCHEMA = T.StructType(
    [
        T.StructField("LocationID", T.IntegerType()),
        T.StructField("Borough", T.StringType()),
        T.StructField("Zone", T.StringType()),
        T.StructField("service_zone", T.StringType()),
    ]
)
# Columns of the daily station records, all read as text.
STATION_COLUMNS = (
    "STATION", "NAME", "DATE", "TMAX", "TMIN", "TAVG", "PRCP", "SNOW", "SNWD", "AWND",
    "WT01", "WT02", "WT03", "WT04", "WT05", "WT06", "WT08",
)
STATION_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in STATION_COLUMNS])

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def conform(df: DataFrame, types: dict[str, str], strict: bool = False) -> DataFrame:
    """Cast the named columns. ``strict`` raises on malformed values, otherwise they become null."""
    present = {c: t for c, t in types.items() if c in df.columns}
    return df.withColumns(
        {c: F.col(c).cast(t) if strict else F.col(c).try_cast(t) for c, t in present.items()}
    )


def malformed(df: DataFrame, types: dict[str, str]) -> dict[str, Column]:
    """Per named column, the count of values that ``conform`` turns into null."""
    present = {c: t for c, t in types.items() if c in df.columns}
    return {c: F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()) for c, t in present.items()}


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC_TYPES or t.startswith("decimal")]
