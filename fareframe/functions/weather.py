"""Unit conversions, class flags and comfort scores for daily station records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fareframe.functions.numbers import flag, measure

# Unit factors.
MM_PER_INCH = 25.4
CM_PER_INCH = 2.54
KMH_PER_MPH = 1.60934
TRACE_INCHES = 0.01
# Tenths of m/s to km/h. The published pipeline uses 0.036, a tenth of the physical factor.
KMH_PER_TENTH_MPS = 0.36
KMH_PER_TENTH_MPS_PUBLISHED = 0.036
# Plausible raw Fahrenheit ranges.
FAHRENHEIT_RANGE = {"TMAX": (-50, 120), "TMIN": (-60, 100), "TAVG": (-55, 110)}
# Plausible Celsius ranges of the tenths variant.
CELSIUS_RANGE = {"tmax_c": (-30, 45), "tmin_c": (-35, 35)}
# Weather-type code columns.
WEATHER_TYPES = {
    "fog_mist": "WT01",
    "heavy_fog": "WT02",
    "thunder": "WT03",
    "ice_pellets": "WT04",
    "hail": "WT05",
    "glaze_rime": "WT06",
    "smoke_haze": "WT08",
}


def fahrenheit_to_c(raw: Column, valid: tuple[float, float]) -> Column:
    value = measure(raw)
    return (F.when(value.between(*valid), value) - 32) * 5 / 9


def inches(raw: Column, factor: float) -> Column:
    """Depth in inches to a metric depth: trace is 0.01 in, missing or negative is 0."""
    value = F.coalesce(measure(raw, TRACE_INCHES), F.lit(0.0))
    return F.when(value >= 0, value * factor).otherwise(F.lit(0.0))


def mph_to_kmh(raw: Column) -> Column:
    value = measure(raw)
    return F.when(value.between(0, 200), value * KMH_PER_MPH)


def tenths(raw: Column) -> Column:
    return measure(raw) / 10.0


def rain_flags(mm: Column) -> dict[str, Column]:
    return {
        "is_precipitation": flag(mm > 0),
        "is_light_rain": flag((mm > 0) & (mm <= 2.5)),
        "is_moderate_rain": flag((mm > 2.5) & (mm <= 10)),
        "is_heavy_rain": flag((mm > 10) & (mm <= 25)),
        "is_extreme_rain": flag(mm > 25),
    }


def snow_flags(cm: Column) -> dict[str, Column]:
    return {
        "is_snow": flag(cm > 0),
        "is_light_snow": flag((cm > 0) & (cm <= 2.5)),
        "is_heavy_snow": flag(cm > 2.5),
    }


def temperature_flags(tmax: Column, tmin: Column) -> dict[str, Column]:
    """Class flags. 25 < tmax < 30 deliberately falls in no class."""
    return {
        "is_freezing": flag(tmin <= 0),
        "is_very_cold": flag((tmax > -5) & (tmax <= 0)),
        "is_cold": flag((tmax > 0) & (tmax <= 5)),
        "is_cool": flag((tmax > 5) & (tmax <= 15)),
        "is_mild": flag((tmax > 15) & (tmax <= 20)),
        "is_warm": flag((tmax > 20) & (tmax <= 25)),
        "is_hot": flag(tmax >= 30),
        "is_extreme_heat": flag(tmax >= 35),
    }


def mean_temp(tmax: Column, tmin: Column, tavg: Column | None = None) -> Column:
    middle = (tmax + tmin) / 2.0
    return middle if tavg is None else F.coalesce(tavg, middle)


def comfort_index(temp: Column, mm: Column, kmh: Column | None = None) -> Column:
    """Comfort 5 (best) .. 1. With wind the wider thresholds of the tenths variant apply."""
    if kmh is None:
        steps = [
            (5, temp.between(18, 24) & (mm == 0)),
            (4, temp.between(15, 27) & (mm <= 1)),
            (3, temp.between(10, 30) & (mm <= 5)),
            (2, temp.between(0, 35) & (mm <= 20)),
        ]
    else:
        steps = [
            (5, temp.between(15, 25) & (mm == 0) & (kmh < 20)),
            (4, temp.between(10, 30) & (mm < 5) & (kmh < 30)),
            (3, temp.between(0, 35) & (mm < 10)),
            (2, temp.between(-10, 40)),
        ]
    chain = F
    for score, condition in steps:
        chain = chain.when(condition, F.lit(score))
    return chain.otherwise(F.lit(1))


def fog_flag(*flags: Column) -> Column:
    """1 when any of the given flags is positive; null counts as no fog."""
    any_fog = F.lit(False)
    for one in flags:
        any_fog = any_fog | F.coalesce(one.cast("int") > 0, F.lit(False))
    return any_fog.cast("int")


def code_has_one(raw: Column) -> Column:
    """Weather-type column of the tenths variant: any ``1`` in the text."""
    return flag(F.contains(F.coalesce(raw.cast("string"), F.lit("")), F.lit("1")))
