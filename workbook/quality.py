"""Quantiles, thresholds, funnels, coverage and the other table checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fareframe.operators import metrics, quality
from fareframe.operators.clean import analysis_extract, filter_provider
from fareframe.operators.order_stats import quantile_pair, quantile_scalar, quantiles
from workbook import views as V
from workbook.registry import query, rounded

PS = [0.001, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999]


def _q(col: str, p: float, source: str = "trips", name: str | None = None) -> str:
    return f"SELECT '{name or col}' AS \"column\", {p}::DOUBLE AS p, quantile_cont({col}, {p}) AS value FROM {source}"


@query(
    "q_quantiles",
    f'WITH {V.TRIPS_SQL} SELECT "column", p, round(value, 9) AS value FROM ('
    + " UNION ALL ".join(_q(c, p) for c in ("commission", "y_cpm", "trip_time") for p in PS)
    + ")",
)
def exact_quantiles(spark, sf):
    return rounded(quantiles(V.trips(spark, sf), ["commission", "y_cpm", "trip_time"], PS), ["value"], 9)


@query(
    "q_summary_compare",
    f"""WITH {V.TRIPS_SQL}, a AS (SELECT * FROM trips WHERE year(pickup_date) < 1999),
    b AS (SELECT * FROM trips WHERE year(pickup_date) >= 1999) """
    + " UNION ALL ".join(
        f"""SELECT '{label}' AS percentile, round((SELECT quantile_cont(commission, {p}) FROM a), 9) AS value_train,
        round((SELECT quantile_cont(commission, {p}) FROM b), 9) AS value_test"""
        for label, p in [("p1", 0.01), ("p50", 0.5), ("p95", 0.95), ("p98", 0.98), ("p99", 0.99)]
    ),
)
def compare(spark, sf):
    """All years, split at one."""
    df = V.trips(spark, sf)
    early = F.year("pickup_date") < 1999
    sides = [quality.summary(df.where(side), "commission") for side in (early, ~early)]
    return rounded(quality.compare_summaries(*sides), ["value_train", "value_test"], 9)


def _thresholds(spark, sf, config):
    df = analysis_extract(filter_provider(V.raw_trips(spark, sf), "provider_code", "N"))
    return rounded(quality.thresholds(df, config), ["lower", "upper"])


OWN_SQL = f"{V.RAW_SQL}, own AS (SELECT *, trip_time AS duration_sec FROM raw WHERE provider_code = 'N')"


def _iqr(col: str, k: float) -> str:
    return f"""SELECT '{col}' AS "column", round(greatest(0, a - {k}::DOUBLE * (b - a)), 6) AS lower,
    round(b + {k}::DOUBLE * (b - a), 6) AS upper
    FROM (SELECT quantile_cont({col}, 0.25) AS a, quantile_cont({col}, 0.75) AS b FROM own)"""


@query("q_thresholds_iqr", f"WITH {OWN_SQL} {_iqr('trip_miles', 0.5)} UNION ALL {_iqr('duration_sec', 1.5)}")
def iqr(spark, sf):
    config = {"trip_miles": {"method": "iqr", "factor": 0.5}, "duration_sec": {"method": "iqr"}}
    return _thresholds(spark, sf, config)


def _pct(col: str, lo: float, hi: float) -> str:
    return f"""SELECT '{col}' AS "column", round(quantile_cont({col}, {lo / 100}), 6) AS lower,
    round(quantile_cont({col}, {hi / 100}), 6) AS upper FROM own"""


@query("q_thresholds_pct", f"WITH {OWN_SQL} {_pct('trip_miles', 0.1, 99.5)} UNION ALL {_pct('duration_sec', 0.1, 99.8)}")
def percentile(spark, sf):
    config = {
        "trip_miles": {"method": "percentile", "lower": 0.1, "upper": 99.5},
        "duration_sec": {"method": "percentile", "lower": 0.1, "upper": 99.8},
    }
    return _thresholds(spark, sf, config)


def _z(col: str, z: float) -> str:
    return f"""SELECT '{col}' AS "column", round(greatest(0, avg({col}) - {z}::DOUBLE * stddev_samp({col})), 6) AS lower,
    round(avg({col}) + {z}::DOUBLE * stddev_samp({col}), 6) AS upper FROM own"""


@query("q_thresholds_z", f"WITH {OWN_SQL} {_z('trip_miles', 3.0)} UNION ALL {_z('duration_sec', 1.2)}")
def z_score(spark, sf):
    config = {"trip_miles": {"method": "z_score"}, "duration_sec": {"method": "z_score", "z_threshold": 1.2}}
    return _thresholds(spark, sf, config)


CLIP_SQL = f"""{V.TRIPS_SQL}, kept AS (SELECT * FROM trips WHERE commission >= 0),
  q AS (SELECT quantile_cont(commission, 0.01) AS lo, quantile_cont(commission, 0.99) AS hi FROM kept),
  clipped AS (SELECT kept.* REPLACE (least(greatest(commission, lo), hi) AS commission), commission AS commission_raw FROM kept, q)"""


@query("q_winsorize", f"WITH {CLIP_SQL} SELECT trip_key, trip_part, round(commission, 9) AS commission FROM clipped")
def winsorize(spark, sf):
    df = metrics.winsorize(V.trips(spark, sf).where("commission >= 0"), "commission")
    return rounded(df.select("trip_key", "trip_part", "commission"), ["commission"], 9)


@query(
    "q_winsorized_ratios",
    f"""WITH {CLIP_SQL} SELECT PULocationID, count(*) AS n, round(avg(commission), 6) AS commission,
    round(avg(commission_raw), 6) AS commission_raw, round(avg(commission / trip_miles), 6) AS commission_per_mile,
    round(avg(commission / base_passenger_fare * 100), 6) AS take_rate FROM clipped GROUP BY 1""",
)
def winsorized(spark, sf):
    kept = V.trips(spark, sf).where("commission >= 0")
    df = metrics.winsorize_commission(kept, quantile_pair(kept, "commission", 0.01, 0.99))
    cols = ["commission", "commission_raw", "commission_per_mile", "take_rate"]
    out = df.groupBy("PULocationID").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in cols])
    return rounded(out, cols)


def _kept(name: str, kept: str, below: str, above: str) -> str:
    return f"""SELECT '{name}' AS rule, count(*) FILTER ({kept}) AS kept, count(*) FILTER ({below}) AS below,
    count(*) FILTER ({above}) AS above, count(*) AS total, count(*) FILTER ({kept}) / count(*) * 100 AS kept_pct FROM own"""


@query(
    "q_retention",
    f"WITH {OWN_SQL} "
    + _kept("trip_miles", "trip_miles BETWEEN 1 AND 24", "trip_miles < 1", "trip_miles > 24")
    + " UNION ALL "
    + _kept("duration_sec", "duration_sec BETWEEN 200 AND 3000", "duration_sec < 200", "duration_sec > 3000")
    + " UNION ALL "
    + _kept(
        "combined", "trip_miles BETWEEN 1 AND 24 AND duration_sec BETWEEN 200 AND 3000",
        "trip_miles < 1 OR duration_sec < 200", "trip_miles > 24 OR duration_sec > 3000",
    ),
)
def retention(spark, sf):
    df = analysis_extract(filter_provider(V.raw_trips(spark, sf), "provider_code", "N"))
    return quality.retention(df, {"trip_miles": (1, 24), "duration_sec": (200, 3000)})


@query(
    "q_tail_share",
    f"""WITH {V.TRIPS_SQL} SELECT round(count(*) FILTER (commission >= (SELECT quantile_cont(commission, 0.95) FROM trips))
    / count(commission) * 100, 6) AS tail_pct FROM trips""",
)
def tail(spark, sf):
    df = V.trips(spark, sf)
    return rounded(quality.tail_share(df, "commission", quantile_scalar(df, "commission", 0.95)), ["tail_pct"])


@query(
    "q_quality_indicators",
    f"""WITH {OWN_SQL}, m AS (SELECT *, trip_time / 3600.0::DOUBLE AS h, trip_miles / (trip_time / 3600.0::DOUBLE) AS mph FROM own),
    q AS (SELECT quantile_cont(trip_miles, 0.99) AS a, quantile_cont(h, 0.99) AS b, quantile_cont(mph, 0.95) AS c FROM m)
    SELECT 'very_short' AS indicator, count(*) AS n FROM m WHERE trip_miles < 0.5
    UNION ALL SELECT 'very_long', count(*) FROM m, q WHERE trip_miles > a
    UNION ALL SELECT 'quick', count(*) FROM m WHERE h < 2 / 60
    UNION ALL SELECT 'long', count(*) FROM m, q WHERE h > b
    UNION ALL SELECT 'high_speed', count(*) FROM m, q WHERE mph > c
    UNION ALL SELECT 'zero_distance', count(*) FROM m WHERE trip_miles = 0""",
)
def indicators(spark, sf):
    df = analysis_extract(filter_provider(V.raw_trips(spark, sf), "provider_code", "N"))
    return quality.quality_indicators(df)


SPEC = {
    "over_20_miles": ("trip_miles", ">", 20),
    "zero_miles": ("trip_miles", "==", 0),
    "under_5_min": ("trip_time", "<", 300),
    "loss": ("commission", "<", 0),
    "over_60_mph": ("avg_speed_mph", ">=", 60),
}


@query(
    "q_threshold_counts",
    f"""WITH {V.TRIPS_SQL} SELECT count(*) FILTER (trip_miles > 20) AS over_20_miles,
    count(*) FILTER (trip_miles = 0) AS zero_miles, count(*) FILTER (trip_time < 300) AS under_5_min,
    count(*) FILTER (commission < 0) AS loss, count(*) FILTER (avg_speed_mph >= 60) AS over_60_mph FROM trips""",
)
def limits(spark, sf):
    return quality.threshold_counts(V.trips(spark, sf), SPEC)


STATS = ["commission", "trip_miles", "trip_time"]


@query(
    "q_basic_stats",
    f"WITH {V.TRIPS_SQL} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd,
        min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM trips"""
        for c in STATS
    ),
)
def stats(spark, sf):
    return rounded(quality.basic_stats(V.trips(spark, sf), STATS), ["mean", "sd"])


AVG = ["base_passenger_fare", "driver_pay", "commission", "take_rate"]


@query("q_averages", f"WITH {V.TRIPS_SQL} SELECT " + ", ".join(f"round(avg({c}), 6) AS avg_{c}" for c in AVG) + " FROM trips")
def averages(spark, sf):
    df = quality.averages(V.trips(spark, sf), AVG)
    return rounded(df, df.columns)


def _limit(name: str, rule: str) -> str:
    return f"SELECT '{name}' AS metric, (count(*) FILTER ({rule}))::DOUBLE AS value FROM timed"


def _stat(col: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{col}_{n}', {e}::DOUBLE FROM timed"
        for n, e in [("n", f"count({col})"), ("mean", f"avg({col})"), ("sd", f"stddev_samp({col})"), ("min", f"min({col})"), ("max", f"max({col})")]
    )


OUTLIER_SQL = (
    f"""WITH {V.RAW_SQL}, timed AS (SELECT trip_miles, trip_time::BIGINT AS duration_sec,
      trip_miles / (trip_time / 3600.0::DOUBLE) AS mph FROM raw)
    SELECT metric, round(value, 6) AS value FROM ("""
    + " UNION ALL ".join(
        [_limit(n, f"{c} {'=' if op == '==' else op} {v}") for n, (c, op, v) in quality.OUTLIER_LIMITS.items()]
        + [_stat(c) for c in ("trip_miles", "duration_sec", "mph")]
        + [
            f"SELECT '{c}_{label}', quantile_cont({c}, {p}) FROM timed"
            for c in ("trip_miles", "duration_sec", "mph")
            for label, p in [
                ("p1", 0.01), ("p5", 0.05), ("p10", 0.1), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p90", 0.9),
                ("p95", 0.95), ("p99", 0.99), ("p99.9", 0.999),
            ]
        ]
    )
    + ")"
)


@query("q_outlier_profile", OUTLIER_SQL)
def outliers(spark, sf):
    return rounded(quality.outlier_profile(V.raw_trips(spark, sf)), ["value"])


FUNNEL_SQL = f"""{V.RAW_SQL}, steps AS (
  SELECT CAST(year(pickup_datetime) AS INTEGER) AS year, CAST(month(pickup_datetime) AS INTEGER) AS month,
         count(*) AS raw_count, count(*) FILTER (own) AS provider_count, count(*) FILTER (own AND ok) AS quality_count,
         count(*) FILTER (own AND ok AND tolls >= 0.02) AS sampled_count,
         count(*) FILTER (own AND ok AND tolls >= 0.02 AND base_passenger_fare - driver_pay >= 0) AS final_rows
  FROM (SELECT *, provider_code = 'N' AS own, trip_miles >= 0 AND trip_time > 0 AND base_passenger_fare >= 0
          AND driver_pay >= 0 AS ok FROM raw) GROUP BY 1, 2),
monthly AS (
  SELECT *, raw_count - provider_count AS removed_other_provider, provider_count - quality_count AS removed_quality,
         quality_count - sampled_count AS removed_sampling, sampled_count - final_rows AS removed_neg_commission FROM steps)"""


def _funnel(spark, sf):
    raw = V.raw_trips(spark, sf).withColumns({"year": F.year("pickup_datetime"), "month": F.month("pickup_datetime")})
    # A toll rule stands for the sample, so that both sides agree on its rows.
    return quality.removal_funnel(raw, "provider_code", "N", sampled=F.col("tolls") >= 0.02)


@query("q_removal_funnel", f"WITH {FUNNEL_SQL} SELECT * FROM monthly")
def funnel(spark, sf):
    return _funnel(spark, sf)


def _pct_sql(n: str, d: str, out: str) -> str:
    return f"round(CASE WHEN {d} > 0 THEN 100 * ({n} / {d}) END, 1) AS {out}"


@query(
    "q_funnel_by_year",
    f"WITH {FUNNEL_SQL}, y AS (SELECT coalesce(CAST(year AS VARCHAR), 'ALL') AS year, "
    + ", ".join(f"CAST(sum({src}) AS BIGINT) AS {out}" for out, src in quality.FUNNEL_SUMS.items())
    + " FROM monthly GROUP BY ROLLUP (year)) SELECT *, "
    + ", ".join(_pct_sql(n, d, out) for out, (n, d) in quality.FUNNEL_PCTS.items())
    + " FROM y",
)
def by_year(spark, sf):
    return quality.funnel_by_year(_funnel(spark, sf))


COVER = {"spatial": ["PU_Borough", "trip_cbd_type"], "temporal": ["holiday_name", "rush_hour_label"], "weather": ["fog_flag"]}


@query(
    "q_coverage",
    f"WITH {V.LABELLED_SQL} "
    + " UNION ALL ".join(
        f"""SELECT '{g}' AS "group", '{c}' AS "column", {0 if c == "fog_flag" else 1} AS present,
        {"0::BIGINT" if c == "fog_flag" else f"count({c})"} AS non_null, count(*) AS total,
        {"0::DOUBLE" if c == "fog_flag" else f"count({c}) / count(*) * 100"} AS coverage_pct FROM labelled"""
        for g, cols in COVER.items()
        for c in cols
    ),
)
def coverage(spark, sf):
    return quality.coverage(V.labelled_trips(spark, sf), COVER)


@query(
    "q_null_rates",
    f"""WITH {V.LABELLED_SQL} SELECT 'holiday_name' AS "column", count(holiday_name) AS non_null, count(*) AS total,
    round(100 * (1 - count(holiday_name) / count(*)), 2) AS null_pct FROM labelled
    UNION ALL SELECT 'PU_Zone', count(PU_Zone), count(*), round(100 * (1 - count(PU_Zone) / count(*)), 2) FROM labelled""",
)
def null_rates(spark, sf):
    return quality.null_rates(V.labelled_trips(spark, sf), ["holiday_name", "PU_Zone", "absent"])
