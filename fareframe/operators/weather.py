"""Station records to clean daily weather, their quality and their profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareframe.functions import weather as W
from fareframe.functions.calendar import season
from fareframe.functions.numbers import flag, is_present, measure

# The columns kept in the daily weather table.
WEATHER_CORE = (
    "weather_date", "year", "month", "season", "temp_avg_calculated", "is_freezing", "is_hot",
    "precipitation_mm", "is_snow", "wind_speed_kmh", "weather_comfort_index", "fog_flag",
)
QUALITY_COLUMNS = ("TMAX", "TMIN", "TAVG", "PRCP", "SNOW", "AWND")


def pick_stations(df: DataFrame, preferred: Sequence[str], fallback: int = 0) -> list[str]:
    """Action: the preferred stations that are present, else the ``fallback`` ones with most rows, if asked for."""
    found = {r[0] for r in df.where(F.col("STATION").isin(*preferred)).select("STATION").distinct().collect()}
    if found:
        return [s for s in preferred if s in found]
    top = df.groupBy("STATION").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "STATION").limit(fallback)
    return [r["STATION"] for r in top.collect()]


def only_stations(df: DataFrame, stations: Sequence[str]) -> DataFrame:
    return df.where(F.col("STATION").isin(*stations))


def _dated(df: DataFrame) -> DataFrame:
    parsed = F.col("DATE").cast("string").try_cast("date")
    return df.withColumn("weather_date", parsed).where(F.col("weather_date").isNotNull())


def _date_parts(df: DataFrame) -> DataFrame:
    date = F.col("weather_date")
    return df.withColumns({"year": F.year(date), "month": F.month(date), "season": season(date)})


def clean_imperial(df: DataFrame) -> DataFrame:
    """Fahrenheit / inch / mph station text to metric columns, class flags and a comfort index."""
    df = _dated(df).withColumns(
        {
            "tmax_c": W.fahrenheit_to_c(F.col("TMAX"), W.FAHRENHEIT_RANGE["TMAX"]),
            "tmin_c": W.fahrenheit_to_c(F.col("TMIN"), W.FAHRENHEIT_RANGE["TMIN"]),
            "tavg_c": W.fahrenheit_to_c(F.col("TAVG"), W.FAHRENHEIT_RANGE["TAVG"]),
            "precipitation_mm": W.inches(F.col("PRCP"), W.MM_PER_INCH),
            "snow_cm": W.inches(F.col("SNOW"), W.CM_PER_INCH),
            "snow_depth_cm": W.inches(F.col("SNWD"), W.CM_PER_INCH),
            "wind_speed_kmh": W.mph_to_kmh(F.col("AWND")),
            **{name: flag(F.col(code).isNotNull()) for name, code in W.WEATHER_TYPES.items()},
        }
    )
    df = df.withColumns(
        {
            **W.rain_flags(F.col("precipitation_mm")),
            **W.snow_flags(F.col("snow_cm")),
            **W.temperature_flags(F.col("tmax_c"), F.col("tmin_c")),
            "temp_avg_calculated": W.mean_temp(F.col("tmax_c"), F.col("tmin_c"), F.col("tavg_c")),
            "temp_range_c": F.col("tmax_c") - F.col("tmin_c"),
            "fog_flag": W.fog_flag(F.col("fog_mist"), F.col("heavy_fog")),
        }
    )
    df = df.withColumn(
        "weather_comfort_index", W.comfort_index(F.col("temp_avg_calculated"), F.col("precipitation_mm"))
    )
    raw = [c for c in ("DATE", "TMAX", "TMIN", "TAVG", "PRCP", "SNOW", "SNWD", "AWND") if c in df.columns]
    return _date_parts(df).drop(*raw, *W.WEATHER_TYPES.values())


def plausible_weather(df: DataFrame) -> DataFrame:
    """Drop rows with max below min or a temperature out of range; missing values pass."""
    rule = F.col("tmax_c").isNull() | F.col("tmin_c").isNull() | (F.col("tmax_c") >= F.col("tmin_c"))
    for col, (lo, hi) in W.CELSIUS_RANGE.items():
        rule = rule & (F.col(col).isNull() | F.col(col).between(lo, hi))
    return df.where(rule)


def clean_tenths(
    df: DataFrame, wind_factor: float = W.KMH_PER_TENTH_MPS, heavy_fog: str = "WT02"
) -> DataFrame:
    """Station text in tenths (deg C, mm, m/s) to the core daily columns, implausible rows dropped.

    ``wind_factor=KMH_PER_TENTH_MPS_PUBLISHED, heavy_fog='WT05'`` reproduces the published tables.
    """
    df = _dated(df).where(F.col("TMAX").isNotNull() | F.col("TMIN").isNotNull())
    df = df.withColumns(
        {
            "tmax_c": W.tenths(F.col("TMAX")),
            "tmin_c": W.tenths(F.col("TMIN")),
            "precipitation_mm": F.coalesce(W.tenths(F.col("PRCP")), F.lit(0.0)),
            "is_snow": flag(measure(F.col("SNOW")) > 0),
            "wind_speed_kmh": F.coalesce(measure(F.col("AWND")) * wind_factor, F.lit(0.0)),
            "fog_flag": W.fog_flag(W.code_has_one(F.col("WT01")), W.code_has_one(F.col(heavy_fog))),
        }
    )
    df = df.withColumns(
        {
            "temp_avg_calculated": W.mean_temp(F.col("tmax_c"), F.col("tmin_c")),
            "is_freezing": flag(F.col("tmin_c") <= 0),
            "is_hot": flag(F.col("tmax_c") >= 30),
        }
    )
    df = df.withColumn(
        "weather_comfort_index",
        W.comfort_index(F.col("temp_avg_calculated"), F.col("precipitation_mm"), F.col("wind_speed_kmh")),
    )
    keep = ["STATION", *WEATHER_CORE, "tmax_c", "tmin_c"]
    return _date_parts(df).transform(plausible_weather).select(*keep)


def clean_weather(df: DataFrame, units: str, **options) -> DataFrame:
    if units == "imperial":
        return clean_imperial(df)
    if units == "tenths":
        return clean_tenths(df, **options)
    raise ValueError(f"unknown units {units!r}")


def station_to_day(df: DataFrame) -> DataFrame:
    """One row per date: mean temperature, wind and comfort; strongest flags and precipitation."""
    daily = df.groupBy("weather_date").agg(
        F.avg("temp_avg_calculated").alias("temp_avg_calculated"),
        F.max("is_freezing").alias("is_freezing"),
        F.max("is_hot").alias("is_hot"),
        F.max("precipitation_mm").alias("precipitation_mm"),
        F.max("is_snow").alias("is_snow"),
        F.avg("wind_speed_kmh").alias("wind_speed_kmh"),
        F.max("fog_flag").alias("fog_flag"),
        F.avg("weather_comfort_index").alias("weather_comfort_index"),
    )
    return _date_parts(daily)


def day_classes(df: DataFrame) -> DataFrame:
    """One row per date for profiles of days: mean temperatures and comfort, strongest flags, one rain class.

    Takes cleaned station records. Counting these rows counts days, however many stations report.
    """
    daily = df.groupBy("weather_date").agg(
        *[F.avg(c).alias(c) for c in ("tmax_c", "tmin_c", "temp_avg_calculated", "weather_comfort_index")],
        F.max("precipitation_mm").alias("precipitation_mm"),
        *[F.max(c).alias(c) for c in ("is_precipitation", "is_snow", "fog_mist", "is_very_cold", "is_extreme_heat")],
    )
    rain = {k: v for k, v in W.rain_flags(F.col("precipitation_mm")).items() if k != "is_precipitation"}
    return _date_parts(daily.withColumns(rain))


def day_rollup_min(df: DataFrame) -> DataFrame:
    """Dates present, with the number of station records."""
    return _date_parts(_dated(df).groupBy("weather_date").agg(F.count(F.lit(1)).alias("station_count")))


def select_weather_core(df: DataFrame) -> DataFrame:
    """The kept daily columns that are present; ``fog_flag`` is derived when absent."""
    if "fog_flag" not in df.columns:
        parts = [F.col(c) for c in ("fog_mist", "heavy_fog") if c in df.columns]
        if parts:
            df = df.withColumn("fog_flag", W.fog_flag(*parts))
    return df.select([c for c in WEATHER_CORE if c in df.columns])


def weather_quality(df: DataFrame) -> DataFrame:
    """Quality figures of raw station text as ``(metric, value)`` rows, from one aggregate."""
    date = F.col("DATE").cast("string").try_cast("date")
    high, low = measure(F.col("TMAX")), measure(F.col("TMIN"))
    cols = [c for c in QUALITY_COLUMNS if c in df.columns]
    stats = df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.countDistinct("STATION").alias("station_count"),
        F.count(date).alias("valid_dates"),
        F.datediff(F.max(date), F.min(date)).alias("date_span_days"),
        *[F.count_if(is_present(F.col(c))).alias(f"{c}_present") for c in cols],
        *[F.count_if(F.coalesce(F.col(c) == "", F.lit(True))).alias(f"{c}_missing") for c in cols],
        F.count_if((high > 120) | (high < -50) | (low > 100) | (low < -60)).alias("extreme_temperature"),
        F.count_if(measure(F.col("PRCP")) < 0).alias("negative_precipitation"),
        F.count_if(high < low).alias("max_below_min"),
    )
    total = F.col("total_records")

    def pct(c: str):
        return F.when(total > 0, F.col(c) / total * 100)

    stats = stats.withColumns({f"{c}_present_pct": pct(f"{c}_present") for c in cols}).withColumns(
        {
            "advise_interpolation": flag(F.col("TMAX_present_pct") < 80),
            "precipitation_sufficient": flag(F.col("PRCP_present_pct") > 70),
        }
    )
    wide = stats.select([F.col(c).cast("double").alias(c) for c in stats.columns])
    return wide.unpivot([], wide.columns, "metric", "value")


def records_by_year(df: DataFrame) -> DataFrame:
    return _dated(df).groupBy(F.year("weather_date").alias("year")).agg(F.count(F.lit(1)).alias("n"))


def station_completeness(df: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` stations with most rows and the most complete of all, which carries ``is_best``.

    Gives the share of rows with any and with both temperatures, and the name where there is one.
    """

    def filled(c: str):
        return F.coalesce(F.col(c) != "", F.lit(False))

    names = [F.max("NAME").alias("NAME")] if "NAME" in df.columns else []
    stations = df.groupBy("STATION").agg(
        *names,
        F.count(F.lit(1)).alias("records"),
        F.count_if(filled("TMAX") | filled("TMIN")).alias("any_temp"),
        F.count_if(filled("TMAX") & filled("TMIN")).alias("both_temp"),
    )
    complete = F.col("both_temp") / F.col("records")
    best = stations.orderBy(complete.desc(), F.desc("records"), F.desc("STATION")).limit(1)
    best = best.withColumn("best", F.lit(1))
    top = stations.orderBy(F.desc("records"), "STATION").limit(k).withColumn("best", F.lit(0))
    # At most k + 1 rows.
    shown = top.unionByName(best).groupBy("STATION").agg(*[F.max(c).alias(c) for c in best.columns if c != "STATION"])
    return shown.select(
        "STATION",
        *[c for c in ("NAME",) if names],
        "records",
        (F.col("any_temp") / F.col("records") * 100).alias("any_temp_pct"),
        (F.col("both_temp") / F.col("records") * 100).alias("both_temp_pct"),
        F.col("best").alias("is_best"),
    )


def monthly_weather(df: DataFrame) -> DataFrame:
    """Per calendar month: mean temperatures and comfort, total precipitation, flagged days."""
    return df.groupBy(F.date_format("weather_date", "yyyy-MM").alias("ym")).agg(
        F.avg("tmax_c").alias("tmax_c"),
        F.avg("tmin_c").alias("tmin_c"),
        F.avg("temp_avg_calculated").alias("temp_avg"),
        F.sum("precipitation_mm").alias("precipitation_mm"),
        F.avg("weather_comfort_index").alias("comfort"),
        F.sum("is_snow").cast("bigint").alias("snow_days"),
    )


def monthly_extremes(df: DataFrame) -> DataFrame:
    """Lowest and highest daily extremes by month of the year."""
    return df.groupBy(F.month("weather_date").alias("month")).agg(
        F.min("tmax_c").alias("tmax_min"),
        F.max("tmax_c").alias("tmax_max"),
        F.min("tmin_c").alias("tmin_min"),
        F.max("tmin_c").alias("tmin_max"),
    )


def season_profile(df: DataFrame) -> DataFrame:
    """Per season: days, total and mean precipitation, mean comfort."""
    return df.groupBy("season").agg(
        F.count(F.lit(1)).alias("days"),
        F.sum("precipitation_mm").alias("precip_sum"),
        F.avg("precipitation_mm").alias("precip_mean"),
        F.avg("weather_comfort_index").alias("comfort_mean"),
    )


def _day_counts(df: DataFrame, conditions: dict) -> DataFrame:
    """(condition, days) rows from one aggregate; conditions that never occur drop out."""
    row = df.agg(*[F.count_if(rule).alias(name) for name, rule in conditions.items()])
    return row.unpivot([], list(conditions), "condition", "days").where(F.col("days") > 0)


def condition_counts(df: DataFrame) -> DataFrame:
    """Days per weather condition."""
    return _day_counts(
        df,
        {
            "clear": F.col("is_precipitation") == 0,
            "light_rain": F.col("is_light_rain") == 1,
            "moderate_rain": F.col("is_moderate_rain") == 1,
            "heavy_rain": F.col("is_heavy_rain") == 1,
            "snow": F.col("is_snow") == 1,
        },
    )


def rain_intensity_counts(df: DataFrame) -> DataFrame:
    return _day_counts(
        df,
        {
            "no_rain": F.col("precipitation_mm") == 0,
            "light_rain": F.col("is_light_rain") == 1,
            "moderate_rain": F.col("is_moderate_rain") == 1,
            "heavy_rain": F.col("is_heavy_rain") == 1,
            "extreme_rain": F.col("is_extreme_rain") == 1,
        },
    )


def impact_counts(df: DataFrame) -> DataFrame:
    """Days with conditions that disturb traffic."""
    return _day_counts(
        df,
        {
            "heavy_precipitation": (F.col("is_heavy_rain") == 1) | (F.col("is_extreme_rain") == 1),
            "snow": F.col("is_snow") == 1,
            "extreme_cold": F.col("is_very_cold") == 1,
            "extreme_heat": F.col("is_extreme_heat") == 1,
            "fog": F.col("fog_mist") == 1,
        },
    )


def weather_insights(df: DataFrame) -> DataFrame:
    """One row: rainy, extreme and perfect day percentages and the seasonal comfort gap."""
    extreme = F.col("is_extreme_heat") + F.col("is_very_cold") + F.col("is_heavy_rain") + F.col("is_snow")
    return df.agg(
        (F.avg("is_precipitation") * 100).alias("rainy_pct"),
        (F.sum(extreme) / F.count(F.lit(1)) * 100).alias("extreme_pct"),
        (F.avg(flag(F.col("weather_comfort_index") == 5)) * 100).alias("perfect_pct"),
        (
            F.avg(F.when(F.col("season") == "summer", F.col("weather_comfort_index")))
            - F.avg(F.when(F.col("season") == "winter", F.col("weather_comfort_index")))
        ).alias("summer_winter_gap"),
    )
