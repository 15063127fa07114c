"""Grouped profiles, interaction tables, uplift and smoothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fareframe.functions.calendar import is_rush
from fareframe.functions.numbers import distance_band, flag, precip_bin, temp_bin, wind_bin
from fareframe.operators import halo

Z95 = 1.96


def _with_ci(df: DataFrame, mean: str = "mean") -> DataFrame:
    df = df.withColumn("se", F.col("sd") / F.sqrt("n"))
    return df.withColumns(
        {"lo": F.col(mean) - F.lit(Z95) * F.col("se"), "hi": F.col(mean) + F.lit(Z95) * F.col("se")}
    )


def agg_with_ci(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, sample deviation, row count, standard error and 95 % bounds per group."""
    return _with_ci(
        df.groupBy(*keys).agg(
            F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(F.lit(1)).alias("n")
        )
    )


def zone_profile(df: DataFrame, key: str, prefix: str, value: str = "y_cpm") -> DataFrame:
    """Trips and mean positive response per zone."""
    valid = df.where(F.col(key).isNotNull() & (F.col(value) > 0))
    return valid.groupBy(key).agg(
        F.count(F.lit(1)).alias(f"{prefix}_n_trips"), F.avg(value).alias(f"{prefix}_avg_cpm")
    )


def _means(df: DataFrame, keys: Sequence, commission: str, cpm: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(commission).alias("avg_commission"), F.avg(cpm).alias("avg_cpm"), F.count(F.lit(1)).alias("trips")
    )


def band_profile(
    df: DataFrame, by: str = "shared_match_flag", commission: str = "commission", cpm: str = "y_cpm", suffix: str = "mi"
) -> DataFrame:
    """Mean commission, mean response and trips per distance band and ``by``."""
    banded = df.withColumn("dist_band", distance_band(F.col("trip_miles"), suffix=suffix))
    return _means(banded, ["dist_band", by], commission, cpm)


def temperature_profile(df: DataFrame, commission: str = "commission", cpm: str = "y_cpm") -> DataFrame:
    return _means(df.withColumn("temp_bin", temp_bin(F.col("temp_avg_calculated"))), ["temp_bin"], commission, cpm)


def precipitation_profile(df: DataFrame, commission: str = "commission", cpm: str = "y_cpm") -> DataFrame:
    return _means(df.withColumn("precip_bin", precip_bin(F.col("precipitation_mm"))), ["precip_bin"], commission, cpm)


def _response(df: DataFrame, keys: Sequence[str], cpm: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(cpm).alias("avg_cpm"), F.count(F.lit(1)).alias("trips"))


def weather_response(df: DataFrame, dim: str, cpm: str = "y_cpm") -> DataFrame:
    """Mean positive response by nearest 5-degree bin, precipitation x snow, or wind."""
    valid = df.where(F.col(cpm) > 0)
    if dim == "temperature":
        return _response(
            valid.withColumn("temp_bin", temp_bin(F.col("temp_avg_calculated"), mode="nearest")), ["temp_bin"], cpm
        )
    if dim == "precipitation":
        binned = valid.withColumn("precip_bin", precip_bin(F.col("precipitation_mm"), "fine"))
        return _response(binned, ["precip_bin", "is_snow"], cpm)
    if dim == "wind":
        return _response(valid.withColumn("wind_bin", wind_bin(F.col("wind_speed_kmh"))), ["wind_bin"], cpm)
    raise ValueError(f"unknown dimension {dim!r}")


def flag_profiles(
    df: DataFrame, flags: Sequence[str], commission: str = "commission", cpm: str = "y_cpm"
) -> DataFrame:
    """(flag, level, means, trips) for several 0/1 flags in one pass.

    Rows are first reduced to one per combination of the flags.
    """
    cells = df.groupBy(*flags).agg(
        F.sum(commission).alias("c"),
        F.count(commission).alias("c_n"),
        F.sum(cpm).alias("r"),
        F.count(cpm).alias("r_n"),
        F.count(F.lit(1)).alias("trips"),
    )
    rows = F.explode(
        F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).cast("int").alias("level")) for f in flags])
    )
    per_level = cells.select(rows.alias("x"), "c", "c_n", "r", "r_n", "trips").groupBy("x.flag", "x.level")
    return per_level.agg(
        (F.sum("c") / F.nullif(F.sum("c_n"), F.lit(0))).alias("avg_commission"),
        (F.sum("r") / F.nullif(F.sum("r_n"), F.lit(0))).alias("avg_cpm"),
        F.sum("trips").alias("trips"),
    )


def interaction(df: DataFrame, row: str, col: str, value: str, levels: Sequence) -> DataFrame:
    """Wide table of means: one row per ``row``, one column per level."""
    return df.groupBy(row).pivot(col, list(levels)).agg(F.avg(value))


def cross_counts(df: DataFrame, row: str, col: str, levels: Sequence) -> DataFrame:
    """Wide table of row counts, 0 where a cell is empty."""
    return df.groupBy(row).pivot(col, list(levels)).count().fillna(0)


def uplift(df: DataFrame, outer: str, inner: str, value: str, strata: Sequence[str] = ()) -> DataFrame:
    """Cell mean minus its outer-group mean, with the cell's 95 % bounds.

    One pass over the rows; outer means come from the cell sums. ``strata`` (a distance band, say)
    keeps comparisons within each stratum.
    """
    cells = df.groupBy(*strata, outer, inner).agg(
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.count(F.lit(1)).alias("n"),
        F.sum(value).alias("_sum"),
        F.count(value).alias("_n"),
    )
    # The window holds one outer group of the aggregate: at most one row per inner level.
    group = Window.partitionBy(*strata, outer)
    total = F.sum("_n").over(group)
    outer_mean = F.when(total > 0, F.sum("_sum").over(group) / total)
    return (
        _with_ci(cells.withColumn("outer_mean", outer_mean))
        .withColumn("uplift", F.col("mean") - F.col("outer_mean"))
        .drop("_sum", "_n")
    )


def distance_uplift(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """Uplift within the bands 0-2, 2-5, 5-10 and 10+ miles."""
    banded = df.withColumn("dist_band", distance_band(F.col("trip_miles"), (2, 5, 10)))
    return uplift(banded, outer, inner, value, strata=["dist_band"])


def value_counts(df: DataFrame, cols: Sequence[str] | str) -> DataFrame:
    """Row counts, largest first."""
    keys = [cols] if isinstance(cols, str) else list(cols)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys)


def value_shares(df: DataFrame, col: str, k: int | None = None) -> DataFrame:
    """Counts and percentage of all rows, largest first, optionally the top ``k`` only."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    shares = counts.withColumn("pct", F.col("n") / total * 100).orderBy(F.desc("n"), col)
    return shares if k is None else shares.limit(k)


def mode_of(df: DataFrame, col: str) -> DataFrame:
    """Most frequent value; ties go to the smallest."""
    return value_counts(df.where(F.col(col).isNotNull()), col).limit(1)


def group_means(df: DataFrame, keys: Sequence[str], values: Sequence[str], digits: int = 2) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.round(F.avg(v), digits).alias(f"avg_{v}") for v in values])


def mean_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean per label, best first."""
    return df.groupBy(key).agg(F.avg(value).alias("mean")).orderBy(F.desc("mean"), key)


def best_label(df: DataFrame, key: str, value: str) -> DataFrame:
    """The label with the highest mean."""
    return mean_by(df, key, value).limit(1)


def share_rate(df: DataFrame, condition: Column, out: str = "share_rate") -> DataFrame:
    """Share of rows that meet the condition."""
    return df.agg(F.avg(flag(condition)).alias(out))


def n_distinct(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct counts of several columns, from one scan; a column without values counts 0.

    All columns are reduced to their distinct values together, so a hot value costs one row per task. Values are
    compared as text; of floating-point columns both zeros count as one, as in ``count(distinct)``.
    """
    floating = {c for c, t in df.dtypes if t in ("float", "double")}

    def text(c: str) -> Column:
        value = F.when(F.col(c) == 0, F.lit(0.0).cast(df.schema[c].dataType)).otherwise(F.col(c)) if c in floating else F.col(c)
        return value.cast("string").alias(c)

    values = df.select(*[text(c) for c in cols]).unpivot([], list(cols), "column", "v")
    return values.distinct().groupBy("column").agg(F.count("v").alias("n_distinct"))


def value_bitmaps(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(*by, column, bucket, bits) of whole-number columns: which values occur, as bitmaps of 32,768 values each.

    Tasks combine bits before they are shuffled, and bitmaps of parts are joined by ``distinct_of_bitmaps``. Null sets
    no bit.
    """
    long = df.select(*by, *[F.col(c).cast("bigint").alias(c) for c in cols]).unpivot(list(by), list(cols), "column", "v").where("v is not null")
    bucket = F.bitmap_bucket_number("v").alias("bucket")
    return long.groupBy(*by, "column", bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits"))


def distinct_of_bitmaps(bitmaps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, column, n_distinct): exact distinct counts over all parts of a group; a column without values has no row."""
    joined = bitmaps.groupBy(*by, "column", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return joined.groupBy(*by, "column").agg(F.sum(F.bitmap_count("bits")).alias("n_distinct"))


def pct_vs_baseline(
    profile: DataFrame, hour: str = "pickup_hour", value: str = "mean", lo: int = 2, hi: int = 5, by: Sequence[str] = ()
) -> DataFrame:
    """Percent change against the unweighted mean of the profile's off-peak hours.

    Takes an hourly profile, so a window holds 24 rows per ``by``. Without ``by`` the mean is a scalar of its own and
    the rows stay where they are.
    """
    off_peak = F.when(F.col(hour).between(lo, hi), F.col(value))
    base = F.avg(off_peak).over(Window.partitionBy(*by)) if by else profile.agg(F.avg(off_peak)).scalar()
    return profile.withColumn("baseline", base).withColumn(
        "pct_vs_offpeak", F.when(F.col("baseline") != 0, (F.col(value) / F.col("baseline") - 1.0) * 100.0)
    )


def peak(profile: DataFrame, label: str, value: str = "mean") -> DataFrame:
    """The profile row with the highest value; ties go to the smallest label."""
    return profile.where(F.col(value).isNotNull()).orderBy(F.desc(value), label).limit(1).select(label, value)


def circular_mean(df: DataFrame, part: Sequence[str], order: str, cols: Sequence[str], width: int = 3) -> DataFrame:
    """Centred moving average of ``<col>_s`` that wraps around within each part, by row position.

    Each part is a day profile: 24 rows at most for an hourly one.
    """
    pad = width // 2
    whole = Window.partitionBy(*part)
    placed = df.withColumns(
        {"_pos": F.row_number().over(whole.orderBy(order)), "_len": F.count(F.lit(1)).over(whole)}
    )
    # Every row appears once at its place, and again past the far end where it pads the wrap.
    shifts = F.array(
        F.lit(0),
        F.when(F.col("_pos") <= pad, F.col("_len")),
        F.when(F.col("_pos") > F.col("_len") - pad, -F.col("_len")),
    )
    padded = placed.withColumn("_shift", F.explode(shifts)).where(F.col("_shift").isNotNull())
    frame = whole.orderBy("_at").rowsBetween(-pad, pad)
    smooth = {f"{c}_s": F.avg(c).over(frame) for c in cols}
    return (
        padded.withColumn("_at", F.col("_pos") + F.col("_shift"))
        .withColumns(smooth)
        .where(F.col("_shift") == 0)
        .drop("_pos", "_len", "_shift", "_at")
    )


def centred_mean(df: DataFrame, order: str, value: str, width: int = 30, part: Sequence[str] = (), block: int = halo.BLOCK) -> DataFrame:
    """Centred rolling mean over rows; null unless the whole window holds values.

    An even width reaches one row further back than ahead. Without ``part`` the rows are one series, cut into blocks in
    order that carry their neighbours' border rows along (``halo.in_blocks``).
    """
    back, ahead = width // 2, (width - 1) // 2

    def smooth(rows: DataFrame, group: Sequence[str], by: str) -> DataFrame:
        frame = Window.partitionBy(*group).orderBy(by).rowsBetween(-back, ahead)
        return rows.withColumn(f"{value}_rolling", F.when(F.count(value).over(frame) == width, F.avg(value).over(frame)))

    return smooth(df, part, order) if part else halo.in_blocks(df, order, back, ahead, smooth, block)


def temporal_insights(df: DataFrame) -> DataFrame:
    """One row of demand figures from calendar-labelled trips.

    Rows are first reduced to one per hour and label, so every figure comes from that small table.
    """
    cells = df.groupBy("pickup_hour", "is_weekend", "rush_hour_label", "is_holiday").agg(
        F.count(F.lit(1)).alias("n"), F.sum("trip_miles").alias("miles"), F.count("trip_miles").alias("miles_n")
    )
    hours = cells.groupBy("pickup_hour").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("is_weekend"), F.col("n"))).alias("weekend_n"),
        F.sum(F.when(~F.col("is_weekend"), F.col("n"))).alias("weekday_n"),
        F.sum(F.when(is_rush(F.col("rush_hour_label")), F.col("miles"))).alias("rush_miles"),
        F.sum(F.when(is_rush(F.col("rush_hour_label")), F.col("miles_n"))).alias("rush_n"),
        F.sum(F.when(F.col("rush_hour_label") == "off_peak", F.col("miles"))).alias("off_miles"),
        F.sum(F.when(F.col("rush_hour_label") == "off_peak", F.col("miles_n"))).alias("off_n"),
        F.sum(F.when(F.col("is_holiday"), F.col("n"))).alias("holiday_n"),
        F.sum(F.when((F.col("pickup_hour") >= 22) | (F.col("pickup_hour") <= 5), F.col("n"))).alias("late_n"),
    )

    def share(part: str) -> Column:
        return F.coalesce(F.sum(part), F.lit(0)) / F.sum("n") * 100

    return hours.agg(
        F.max_by("pickup_hour", F.struct("n", -F.col("pickup_hour"))).alias("peak_hour"),
        F.avg("weekend_n").alias("weekend_hourly_mean"),
        F.avg("weekday_n").alias("weekday_hourly_mean"),
        (F.sum("rush_miles") / F.nullif(F.sum("rush_n"), F.lit(0))).alias("rush_miles"),
        (F.sum("off_miles") / F.nullif(F.sum("off_n"), F.lit(0))).alias("off_peak_miles"),
        share("holiday_n").alias("holiday_pct"),
        share("late_n").alias("late_night_pct"),
    )
