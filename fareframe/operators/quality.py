"""Thresholds, removal funnels, coverage and other one-pass table checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareframe.functions.numbers import safe_pct
from fareframe.operators.clean import all_present, provider_is, trip_is_valid, with_clock_duration
from fareframe.operators.order_stats import probability_label, quantile_struct, quantiles
from fareframe.schemas import REQUIRED_TRIP_COLUMNS

PROFILE_PS = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999)
SUMMARY_PS = (0.01, 0.5, 0.95, 0.98, 0.99)
# Reporting limits for distance, duration (s) and speed.
OUTLIER_LIMITS = {
    "over_100_miles": ("trip_miles", ">", 100),
    "over_200_miles": ("trip_miles", ">", 200),
    "over_500_miles": ("trip_miles", ">", 500),
    "negative_miles": ("trip_miles", "<", 0),
    "zero_miles": ("trip_miles", "==", 0),
    "over_6_hours": ("duration_sec", ">", 6 * 3600),
    "over_12_hours": ("duration_sec", ">", 12 * 3600),
    "over_24_hours": ("duration_sec", ">", 24 * 3600),
    "under_1_min": ("duration_sec", "<", 60),
    "zero_or_negative": ("duration_sec", "<=", 0),
    "over_50_mph": ("mph", ">", 50),
    "over_100_mph": ("mph", ">", 100),
    "over_200_mph": ("mph", ">", 200),
}
# Column groups of the coverage report.
COVERAGE_GROUPS = {
    "spatial": ("trip_cbd_type", "PU_Borough", "DO_Borough", "PU_Zone", "DO_Zone"),
    "temporal": ("pickup_hour", "is_holiday", "pickup_day_of_week", "is_weekend", "rush_hour_label"),
    "weather": ("temp_avg_calculated", "precipitation_mm", "is_snow", "wind_speed_kmh", "fog_flag"),
}
_COMPARE = {
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "==": lambda c, v: c == v,
}


def _condition(spec: tuple[str, str, float]) -> Column:
    col, op, value = spec
    return _COMPARE[op](F.col(col), F.lit(value))


def threshold_counts(df: DataFrame, spec: dict[str, tuple[str, str, float]] = OUTLIER_LIMITS) -> DataFrame:
    """One row of conditional counts."""
    return df.agg(*[F.count_if(_condition(rule)).alias(name) for name, rule in spec.items()])


def basic_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, n, mean, sd, min, max) rows from one aggregate."""
    row = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(c).alias("n"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("sd"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
            ).alias(c)
            for c in cols
        ]
    )
    return row.select(F.inline(F.array(*[F.col(c) for c in cols])))


def averages(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg(c).alias(f"avg_{c}") for c in cols])


def extent(df: DataFrame, ts: str) -> DataFrame:
    """First and last timestamp and the row count."""
    return df.agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n"))


def summary(df: DataFrame, col: str, ps: Sequence[float] = SUMMARY_PS) -> DataFrame:
    """(percentile, value) rows labelled p1, p50 ..."""
    labels = F.create_map(*[x for p in ps for x in (F.lit(float(p)), F.lit(probability_label(p)))])
    return quantiles(df, col, ps).select(labels[F.col("p")].alias("percentile"), "value")


def compare_summaries(a: DataFrame, b: DataFrame, suffixes: tuple[str, str] = ("_train", "_test")) -> DataFrame:
    """Two percentile tables side by side."""
    left = a.withColumnRenamed("value", f"value{suffixes[0]}")
    right = b.withColumnRenamed("value", f"value{suffixes[1]}")
    return left.join(right, "percentile")


def thresholds(df: DataFrame, config: dict[str, dict]) -> DataFrame:
    """(column, lower, upper) rows for the methods ``iqr``, ``percentile`` and ``z_score``.

    Lower bounds never go below 0. Columns without values, or with zero spread under ``z_score``,
    give no row.
    """
    parts, wanted = [], {}
    for col, c in config.items():
        if c["method"] == "iqr":
            wanted[col] = (0.25, 0.75)
        elif c["method"] == "percentile":
            wanted[col] = (c.get("lower", 0.5) / 100, c.get("upper", 99.5) / 100)
        elif c["method"] != "z_score":
            raise ValueError(f"unknown method {c['method']!r}")
    if wanted:
        q = quantiles(df, list(wanted), [p for pair in wanted.values() for p in pair])
        is_low = F.lit(False)
        is_high = F.lit(False)
        factor = F.lit(0.0)
        for col, (lo, hi) in wanted.items():
            here = F.col("column") == col
            is_low = is_low | (here & (F.col("p") == lo))
            is_high = is_high | (here & (F.col("p") == hi))
            if config[col]["method"] == "iqr":
                factor = F.when(here, F.lit(float(config[col].get("factor", 1.5)))).otherwise(factor)
        ends = q.groupBy("column").agg(
            F.max(F.when(is_low, F.col("value"))).alias("lo"), F.max(F.when(is_high, F.col("value"))).alias("hi")
        )
        reach = factor * (F.col("hi") - F.col("lo"))
        parts.append(
            ends.select(
                "column",
                F.greatest(F.lit(0.0), F.col("lo") - reach).alias("lower"),
                (F.col("hi") + reach).alias("upper"),
            )
        )
    scored = [c for c in config if config[c]["method"] == "z_score"]
    if scored:
        z = F.lit(0.0)
        for col in scored:
            z = F.when(F.col("column") == col, F.lit(float(config[col].get("z_threshold", 3.0)))).otherwise(z)
        spread = basic_stats(df, scored).where(F.col("sd") > 0)
        parts.append(
            spread.select(
                "column",
                F.greatest(F.lit(0.0), F.col("mean") - z * F.col("sd")).alias("lower"),
                (F.col("mean") + z * F.col("sd")).alias("upper"),
            )
        )
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def threshold_values(table: DataFrame) -> dict[str, tuple[float, float]]:
    """Action: thresholds as literals; one row per configured column."""
    return {r["column"]: (r["lower"], r["upper"]) for r in table.collect()}


def retention(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Per rule and combined: rows kept, below and above the range, and percentages, in one pass."""

    def row(name: str, kept: Column, low: Column, high: Column) -> Column:
        return F.struct(
            F.lit(name).alias("rule"),
            F.count_if(kept).alias("kept"),
            F.count_if(low).alias("below"),
            F.count_if(high).alias("above"),
            F.count(F.lit(1)).alias("total"),
        ).alias(name)

    rows, every, any_low, any_high = [], F.lit(True), F.lit(False), F.lit(False)
    for col, (lo, hi) in ranges.items():
        kept, low, high = F.col(col).between(lo, hi), F.col(col) < lo, F.col(col) > hi
        rows.append(row(col, kept, low, high))
        every, any_low, any_high = every & kept, any_low | low, any_high | high
    rows.append(row("combined", every, any_low, any_high))
    names = [*ranges, "combined"]
    table = df.agg(*rows).select(F.inline(F.array(*[F.col(n) for n in names])))
    pct = F.when(F.col("total") > 0, F.col("kept") / F.col("total") * 100)
    return table.withColumn("kept_pct", pct)


def tail_share(df: DataFrame, col: str, threshold: float | Column) -> DataFrame:
    """Percentage of non-null rows at or above the threshold; 0 for an empty column."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    value = F.col(col).cast("double")
    share = F.avg(F.when(value.isNotNull(), F.when(value >= limit, 1.0).otherwise(0.0))) * 100
    return df.agg(F.coalesce(share, F.lit(0.0)).alias("tail_pct"))


def outlier_profile(df: DataFrame) -> DataFrame:
    """(metric, value) rows: limits, basic statistics and quantiles of distance, duration and speed."""
    timed = with_clock_duration(df)
    cols = ["trip_miles", "duration_sec", "mph"]
    counts = threshold_counts(timed)
    counts = counts.select([F.col(c).cast("double").alias(c) for c in counts.columns])
    counts = counts.unpivot([], counts.columns, "metric", "value")
    stats = basic_stats(timed, cols)
    stats = stats.select("column", *[F.col(c).cast("double").alias(c) for c in stats.columns if c != "column"])
    stats = stats.unpivot("column", ["n", "mean", "sd", "min", "max"], "stat", "value").select(
        F.concat_ws("_", "column", "stat").alias("metric"), "value"
    )
    labels = F.create_map(*[x for p in PROFILE_PS for x in (F.lit(float(p)), F.lit(probability_label(p)))])
    tails = quantiles(timed, cols, PROFILE_PS).select(
        F.concat_ws("_", F.col("column"), labels[F.col("p")]).alias("metric"), "value"
    )
    return counts.unionByName(stats).unionByName(tails)


def quality_indicators(df: DataFrame) -> DataFrame:
    """(indicator, n) rows: very short, very long, quick, slow, fast and zero-distance trips."""
    limits = quantile_struct(
        df, {"miles": ("trip_miles", 0.99), "hours": ("duration_hours", 0.99), "mph": ("mph", 0.95)}
    )
    df = df.withColumn("_limit", limits)
    limit = F.col("_limit")
    rules = {
        "very_short": F.col("trip_miles") < 0.5,
        "very_long": F.col("trip_miles") > limit["miles"],
        "quick": F.col("duration_hours") < 2 / 60,
        "long": F.col("duration_hours") > limit["hours"],
        "high_speed": F.col("mph") > limit["mph"],
        "zero_distance": F.col("trip_miles") == 0,
    }
    row = df.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return row.unpivot([], list(rules), "indicator", "n")


def removal_funnel(
    df: DataFrame,
    provider_col: str,
    code: str,
    by: Sequence[str] = ("year", "month"),
    sampled: Column | None = None,
    required: Sequence[str] = REQUIRED_TRIP_COLUMNS,
) -> DataFrame:
    """Rows left and removed at each step, per month, in a single pass over the raw trips."""
    own = provider_is(provider_col, code)
    good = own & all_present(required) & trip_is_valid()
    taken = good if sampled is None else good & sampled
    final = taken & (F.col("base_passenger_fare") - F.col("driver_pay") >= 0)
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("raw_count"),
        F.count_if(own).alias("provider_count"),
        F.count_if(good).alias("quality_count"),
        F.count_if(taken).alias("sampled_count"),
        F.count_if(final).alias("final_rows"),
    )
    return counts.withColumns(
        {
            "removed_other_provider": F.col("raw_count") - F.col("provider_count"),
            "removed_quality": F.col("provider_count") - F.col("quality_count"),
            "removed_sampling": F.col("quality_count") - F.col("sampled_count"),
            "removed_neg_commission": F.col("sampled_count") - F.col("final_rows"),
        }
    )


# Report column -> monthly funnel column.
FUNNEL_SUMS = {
    "raw": "raw_count",
    "provider": "provider_count",
    "quality": "quality_count",
    "sampled": "sampled_count",
    "final": "final_rows",
    "rm_other_provider": "removed_other_provider",
    "rm_quality": "removed_quality",
    "rm_sampling": "removed_sampling",
    "rm_neg_comm": "removed_neg_commission",
}
# Report percentage -> (numerator, denominator).
FUNNEL_PCTS = {
    "ret_after_provider_pct": ("provider", "raw"),
    "ret_after_quality_pct": ("quality", "provider"),
    "ret_after_sampling_pct": ("sampled", "quality"),
    "ret_final_pct": ("final", "sampled"),
    "ret_final_vs_raw_pct": ("final", "raw"),
    "pct_rm_other_provider": ("rm_other_provider", "raw"),
    "pct_rm_quality": ("rm_quality", "provider"),
    "pct_rm_sampling": ("rm_sampling", "quality"),
    "pct_rm_neg_comm": ("rm_neg_comm", "sampled"),
}


def funnel_by_year(monthly: DataFrame) -> DataFrame:
    """Yearly sums plus an ``ALL`` row, with step percentages (1 decimal), ``ALL`` last."""
    rolled = monthly.rollup("year").agg(
        F.grouping("year").alias("_all"), *[F.sum(src).alias(out) for out, src in FUNNEL_SUMS.items()]
    )
    named = rolled.withColumn("year", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("year").cast("string")))
    with_pct = named.withColumns({out: safe_pct(F.col(n), F.col(d)) for out, (n, d) in FUNNEL_PCTS.items()})
    return with_pct.orderBy("_all", "year").drop("_all")


def coverage(df: DataFrame, groups: dict[str, Sequence[str]] = COVERAGE_GROUPS, by: Sequence[str] = ()) -> DataFrame:
    """Non-null count, total and percentage per listed column, from one aggregate.

    A listed column the table lacks is reported with ``present`` 0 and no matches.
    """
    listed = [(g, c) for g, cols in groups.items() for c in cols]
    total = F.count(F.lit(1))
    rows = [
        F.struct(
            F.lit(g).alias("group"),
            F.lit(c).alias("column"),
            F.lit(1 if c in df.columns else 0).alias("present"),
            (F.count(c) if c in df.columns else F.lit(0).cast("bigint")).alias("non_null"),
            total.alias("total"),
        ).alias(f"_{i}")
        for i, (g, c) in enumerate(listed)
    ]
    table = df.groupBy(*by).agg(*rows).select(*by, F.inline(F.array(*[F.col(f"_{i}") for i in range(len(rows))])))
    pct = F.when(F.col("total") > 0, F.col("non_null") / F.col("total") * 100).otherwise(F.lit(0.0))
    return table.withColumn("coverage_pct", pct)


def null_rates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, non_null, total, null_pct) with the percentage rounded to 2 decimals."""
    table = coverage(df, {"": [c for c in cols if c in df.columns]})
    missing = F.when(F.col("total") > 0, F.round(100 * (1 - F.col("non_null") / F.col("total")), 2))
    return table.select("column", "non_null", "total", missing.alias("null_pct"))


def check_mart(df: DataFrame, required: Sequence[str], unwanted: Sequence[str]) -> dict[str, list[str]]:
    """Required columns that are missing and unwanted ones still present."""
    return {
        "missing": [c for c in required if c not in df.columns],
        "unwanted": [c for c in unwanted if c in df.columns],
    }
