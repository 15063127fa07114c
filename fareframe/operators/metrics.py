"""Commission, ratio and response columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareframe.functions.numbers import ratio
from fareframe.operators.order_stats import quantile_pair

# Names of the derived money columns; pass your own mapping to keep an existing naming scheme.
METRIC_NAMES = {
    "commission": "commission",
    "take_rate": "take_rate",
    "per_mile": "commission_per_mile",
    "per_minute": "commission_per_minute",
}


def _ratios(commission: Column, n: dict[str, str]) -> dict[str, Column]:
    return {
        n["take_rate"]: ratio(commission, F.col("base_passenger_fare")) * 100,
        n["per_mile"]: ratio(commission, F.col("trip_miles")),
        n["per_minute"]: ratio(commission * 60.0, F.col("trip_time")),
    }


def commission_metrics(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Duration, speed, commission, its ratios, driver earnings per minute and pickup date.

    A zero denominator gives 0, not null.
    """
    n = {**METRIC_NAMES, **(names or {})}
    commission = F.col("base_passenger_fare") - F.col("driver_pay")
    return df.withColumns(
        {
            "trip_duration_minutes": F.col("trip_time") / 60.0,
            "avg_speed_mph": ratio(F.col("trip_miles") * 3600.0, F.col("trip_time")),
            n["commission"]: commission,
            **_ratios(commission, n),
            "driver_efficiency": ratio(F.col("driver_pay") * 60.0, F.col("trip_time")),
            "pickup_date": F.to_date("pickup_datetime"),
        }
    )


def fare_metrics(df: DataFrame) -> DataFrame:
    """Superseded fare-based ratios."""
    return df.withColumns(
        {
            "revenue_per_mile": ratio(F.col("base_passenger_fare"), F.col("trip_miles")),
            "revenue_per_minute": ratio(F.col("base_passenger_fare") * 60.0, F.col("trip_time")),
        }
    )


def clip(value: Column, lo: Column, hi: Column) -> Column:
    """Values outside ``[lo, hi]`` move to the bound; null stays null, null bounds do nothing."""
    return F.when(value < lo, lo).when(value > hi, hi).otherwise(value)


def winsorize(df: DataFrame, col: str, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Clip a column to its exact quantiles, in one lazy plan."""
    # One subquery column, so that the bounds are planned once however often they are read.
    bounded = df.withColumn("_bounds", quantile_pair(df, col, lo, hi))
    return bounded.withColumn(col, clip(F.col(col), F.col("_bounds.lo"), F.col("_bounds.hi"))).drop("_bounds")


def winsorize_commission(
    df: DataFrame, bounds: tuple[float, float] | Column, names: dict[str, str] | None = None
) -> DataFrame:
    """Clip the commission and derive its ratios from the clipped value.

    The unclipped commission stays as ``<commission>_raw``.
    """
    n = {**METRIC_NAMES, **(names or {})}
    if not isinstance(bounds, Column):
        bounds = F.struct(F.lit(float(bounds[0])).alias("lo"), F.lit(float(bounds[1])).alias("hi"))
    raw = F.col(n["commission"])
    bounded = df.withColumn("_bounds", bounds)
    clipped = bounded.withColumns(
        {f"{n['commission']}_raw": raw, n["commission"]: clip(raw, F.col("_bounds.lo"), F.col("_bounds.hi"))}
    ).drop("_bounds")
    return clipped.withColumns(_ratios(F.col(n["commission"]), n))


def with_cpm(
    df: DataFrame, min_miles: float = 0.1, mode: str = "filter", commission: str = "commission", out: str = "y_cpm"
) -> DataFrame:
    """Commission per mile and log distance. Trips at or below ``min_miles`` drop out, or get null."""
    miles = F.col("trip_miles")
    kept = miles > min_miles
    if mode == "filter":
        df, response = df.where(kept), F.col(commission) / miles
    elif mode == "null":
        response = F.when(kept, F.col(commission) / miles)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return df.withColumns({out: response, "log_trip_miles": F.log(miles + F.lit(1e-6))})
