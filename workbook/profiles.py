"""Grouped profiles, interactions, uplift, smoothing and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fareframe.operators import order_stats, profile
from fareframe.operators.calendar import add_calendar
from fareframe.operators.clean import positive
from workbook import views as V
from workbook.registry import query, rounded

CI_COLS = ["mean", "sd", "se", "lo", "hi"]


def ci_sql(keys: str, value: str, source: str) -> str:
    return f"""SELECT {keys}, round(m, 6) AS mean, round(s, 6) AS sd, n, round(s / sqrt(n), 6) AS se,
      round(m - 1.96::DOUBLE * s / sqrt(n), 6) AS lo, round(m + 1.96::DOUBLE * s / sqrt(n), 6) AS hi
    FROM (SELECT {keys}, avg({value}) AS m, stddev_samp({value}) AS s, count(*) AS n FROM {source} GROUP BY ALL)"""


HOURLY_SQL = (
    f"WITH {V.TRIPS_SQL}, h AS (SELECT *, dayofweek(pickup_datetime) IN (0, 6) AS is_weekend,"
    " CAST(month(pickup_datetime) AS INTEGER) AS pickup_month FROM trips) "
)


@query("q_hourly_ci", HOURLY_SQL + ci_sql("pickup_hour, is_weekend", "commission", "h"))
def hourly(spark, sf):
    df = profile.agg_with_ci(add_calendar(V.trips(spark, sf)), ["pickup_hour", "is_weekend"], "commission")
    return rounded(df, CI_COLS)


@query("q_hourly_cpm_ci", HOURLY_SQL + ci_sql("pickup_hour, is_weekend", "y_cpm", "h"))
def hourly_cpm(spark, sf):
    df = profile.agg_with_ci(add_calendar(V.trips(spark, sf)), ["pickup_hour", "is_weekend"], "y_cpm")
    return rounded(df, CI_COLS)


@query("q_monthly_ci", HOURLY_SQL + ci_sql("pickup_month", "commission", "h"))
def monthly(spark, sf):
    return rounded(profile.agg_with_ci(add_calendar(V.trips(spark, sf)), ["pickup_month"], "commission"), CI_COLS)


EVENT_SQL = "WITH e AS (SELECT *, CAST(hour(ts) AS INTEGER) AS pickup_hour FROM events) "


@query("q_event_hourly_ci", EVENT_SQL + ci_sql("pickup_hour, event_type", "value", "e"))
def event_hourly(spark, sf):
    e = V.table(spark, sf, "events").withColumn("pickup_hour", F.hour("ts"))
    return rounded(profile.agg_with_ci(e, ["pickup_hour", "event_type"], "value"), CI_COLS)


@query(
    "q_pct_vs_baseline",
    f"""WITH {V.TRIPS_SQL}, p AS (SELECT pickup_hour, avg(commission) AS mean FROM trips GROUP BY 1),
    b AS (SELECT avg(mean) AS base FROM p WHERE pickup_hour BETWEEN 2 AND 5)
    SELECT pickup_hour, round((mean / base - 1) * 100, 6) AS pct_vs_offpeak FROM p, b""",
)
def vs_baseline(spark, sf):
    hourly = profile.agg_with_ci(add_calendar(V.trips(spark, sf)), ["pickup_hour"], "commission")
    return rounded(profile.pct_vs_baseline(hourly).select("pickup_hour", "pct_vs_offpeak"), ["pct_vs_offpeak"])


@query(
    "q_peak",
    f"""WITH {V.TRIPS_SQL} SELECT pickup_hour, round(avg(commission), 6) AS mean FROM trips
    GROUP BY 1 ORDER BY avg(commission) DESC, pickup_hour LIMIT 1""",
)
def peak(spark, sf):
    hourly = profile.agg_with_ci(add_calendar(V.trips(spark, sf)), ["pickup_hour"], "commission")
    return rounded(profile.peak(hourly, "pickup_hour"), ["mean"])


def zone_sql(key: str, prefix: str) -> str:
    return f"""WITH {V.TRIPS_SQL} SELECT {key}, count(*) AS {prefix}_n_trips, round(avg(y_cpm), 6) AS {prefix}_avg_cpm
    FROM trips WHERE y_cpm > 0 GROUP BY 1"""


@query("q_zone_profile_pu", zone_sql("PULocationID", "pu"))
def pu_profile(spark, sf):
    return rounded(profile.zone_profile(V.trips(spark, sf), "PULocationID", "pu"), ["pu_avg_cpm"])


@query("q_zone_profile_do", zone_sql("DOLocationID", "do"))
def do_profile(spark, sf):
    return rounded(profile.zone_profile(V.trips(spark, sf), "DOLocationID", "do"), ["do_avg_cpm"])


MEANS_SQL = "round(avg(commission), 6) AS avg_commission, round(avg(y_cpm), 6) AS avg_cpm, count(*) AS trips"


@query(
    "q_band_profile",
    f"""WITH {V.TRIPS_SQL} SELECT CASE WHEN trip_miles <= 2 THEN '0-2mi' WHEN trip_miles <= 5 THEN '2-5mi'
    WHEN trip_miles <= 10 THEN '5-10mi' WHEN trip_miles <= 20 THEN '10-20mi' ELSE '20+mi' END AS dist_band,
    shared_match_flag, {MEANS_SQL} FROM trips GROUP BY 1, 2""",
)
def bands(spark, sf):
    return rounded(profile.band_profile(V.trips(spark, sf)), ["avg_commission", "avg_cpm"])


TYPES = ["intra_cbd", "outbound_cbd", "inbound_cbd", "non_cbd"]


@query(
    "q_interaction",
    f"WITH {V.LABELLED_SQL} SELECT pickup_hour, "
    + ", ".join(f"round(avg(y_cpm) FILTER (trip_cbd_type = '{t}'), 6) AS {t}" for t in TYPES)
    + " FROM labelled GROUP BY 1",
)
def interaction(spark, sf):
    df = profile.interaction(V.labelled_trips(spark, sf), "pickup_hour", "trip_cbd_type", "y_cpm", TYPES)
    return rounded(df, TYPES)


@query(
    "q_cross_counts",
    f"WITH {V.LABELLED_SQL} SELECT trip_cbd_type, "
    + ", ".join(f"count(*) FILTER (pickup_hour = {h}) AS \"{h}\"" for h in range(24))
    + " FROM labelled WHERE y_cpm > 0 GROUP BY 1",
)
def cross(spark, sf):
    df = positive(V.labelled_trips(spark, sf), "y_cpm")
    return profile.cross_counts(df, "trip_cbd_type", "pickup_hour", list(range(24)))


@query(
    "q_cross_counts_weekday",
    """SELECT CAST(dayofweek(ts) AS INTEGER) AS pickup_day_of_week, """
    + ", ".join(f"count(*) FILTER (hour(ts) = {h}) AS \"{h}\"" for h in range(24))
    + " FROM events GROUP BY 1",
)
def cross_weekday(spark, sf):
    df = add_calendar(V.table(spark, sf, "events"), "ts")
    return profile.cross_counts(df, "pickup_day_of_week", "pickup_hour", list(range(24)))


def uplift_sql(source: str, outer: str, inner: str, strata: str = "") -> str:
    lead = f"{strata}, " if strata else ""
    return f"""cells AS (SELECT {lead}{outer}, {inner}, avg(v) AS m, stddev_samp(v) AS s, count(*) AS n FROM {source} GROUP BY ALL),
    outers AS (SELECT {lead}{outer}, avg(v) AS om FROM {source} GROUP BY ALL),
    up AS (SELECT {lead}{outer}, {inner}, m, s, n, om, m - om AS u, s / sqrt(n) AS e FROM cells JOIN outers USING ({lead}{outer}))"""


UPLIFT_OUT = """round(m, 6) AS mean, round(s, 6) AS sd, n, round(om, 6) AS outer_mean, round(e, 6) AS se,
    round(m - 1.96::DOUBLE * e, 6) AS lo, round(m + 1.96::DOUBLE * e, 6) AS hi, round(u, 6) AS uplift FROM up"""
UPLIFT_COLS = ["mean", "sd", "outer_mean", "se", "lo", "hi", "uplift"]
BASE_SQL = f"{V.LABELLED_SQL}, b AS (SELECT *, y_cpm AS v FROM labelled WHERE y_cpm > 0)"


def _base(spark, sf):
    return positive(V.labelled_trips(spark, sf), "y_cpm")


@query(
    "q_uplift",
    f"WITH {BASE_SQL}, {uplift_sql('b', 'pickup_hour', 'trip_cbd_type')} SELECT pickup_hour, trip_cbd_type, {UPLIFT_OUT}",
)
def uplift(spark, sf):
    return rounded(profile.uplift(_base(spark, sf), "pickup_hour", "trip_cbd_type", "y_cpm"), UPLIFT_COLS)


@query(
    "q_uplift_by_band",
    f"""WITH {BASE_SQL}, bb AS (SELECT *, CASE WHEN trip_miles <= 2 THEN '0-2' WHEN trip_miles <= 5 THEN '2-5'
      WHEN trip_miles <= 10 THEN '5-10' ELSE '10+' END AS dist_band FROM b),
    {uplift_sql('bb', 'pickup_hour', 'trip_cbd_type', 'dist_band')}
    SELECT dist_band, pickup_hour, trip_cbd_type, {UPLIFT_OUT}""",
)
def band_uplift(spark, sf):
    df = profile.distance_uplift(_base(spark, sf), "pickup_hour", "trip_cbd_type", "y_cpm")
    return rounded(df, UPLIFT_COLS)


@query(
    "q_circular_mean",
    f"""WITH {BASE_SQL}, {uplift_sql('b', 'pickup_hour', 'trip_cbd_type')},
    pos AS (SELECT *, row_number() OVER (PARTITION BY trip_cbd_type ORDER BY pickup_hour) - 1 AS i,
                   count(*) OVER (PARTITION BY trip_cbd_type) AS c FROM up)
    SELECT a.trip_cbd_type, a.pickup_hour, round(avg(o.u), 6) AS uplift_s
    FROM pos a, (SELECT unnest([-1, 0, 1]) AS s) s JOIN pos o
      ON o.trip_cbd_type = a.trip_cbd_type AND o.i = (a.i + s.s + a.c) % a.c GROUP BY 1, 2""",
)
def circular(spark, sf):
    cells = profile.uplift(_base(spark, sf), "pickup_hour", "trip_cbd_type", "y_cpm")
    smooth = profile.circular_mean(cells, ["trip_cbd_type"], "pickup_hour", ["uplift", "lo", "hi"])
    return rounded(smooth.select("trip_cbd_type", "pickup_hour", "uplift_s"), ["uplift_s"])


@query(
    "q_event_uplift",
    f"""WITH e AS (SELECT CAST(hour(ts) AS INTEGER) AS pickup_hour, event_type, value AS v FROM events),
    {uplift_sql('e', 'pickup_hour', 'event_type')} SELECT pickup_hour, event_type, {UPLIFT_OUT}""",
)
def event_uplift(spark, sf):
    e = V.table(spark, sf, "events").withColumn("pickup_hour", F.hour("ts"))
    return rounded(profile.uplift(e, "pickup_hour", "event_type", "value"), UPLIFT_COLS)


@query(
    "q_value_counts",
    f"WITH {V.LABELLED_SQL} SELECT PU_Borough, trip_cbd_type, count(*) AS n FROM labelled GROUP BY 1, 2",
)
def counts(spark, sf):
    return profile.value_counts(V.labelled_trips(spark, sf), ["PU_Borough", "trip_cbd_type"])


@query(
    "q_value_shares",
    f"""WITH {V.LABELLED_SQL} SELECT rush_hour_label, count(*) AS n,
    round(count(*) / (SELECT count(*) FROM labelled) * 100, 6) AS pct
    FROM labelled GROUP BY 1 ORDER BY n DESC, rush_hour_label LIMIT 4""",
)
def shares(spark, sf):
    return rounded(profile.value_shares(add_calendar(V.trips(spark, sf)), "rush_hour_label", 4), ["pct"])


@query(
    "q_mode",
    "SELECT CAST(hour(ts) AS INTEGER) AS pickup_hour, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1",
)
def mode(spark, sf):
    return profile.mode_of(V.table(spark, sf, "events").withColumn("pickup_hour", F.hour("ts")), "pickup_hour")


@query(
    "q_mean_by",
    f"WITH {V.LABELLED_SQL} SELECT trip_cbd_type, round(avg(commission), 6) AS mean FROM labelled GROUP BY 1",
)
def mean_by(spark, sf):
    return rounded(profile.mean_by(V.labelled_trips(spark, sf), "trip_cbd_type", "commission"), ["mean"])


@query(
    "q_best_label",
    f"""WITH {V.LABELLED_SQL} SELECT PU_Borough, round(avg(commission), 6) AS mean FROM labelled
    GROUP BY 1 ORDER BY avg(commission) DESC LIMIT 1""",
)
def best(spark, sf):
    return rounded(profile.best_label(V.labelled_trips(spark, sf), "PU_Borough", "commission"), ["mean"])


@query(
    "q_share_rate",
    f"WITH {V.TRIPS_SQL} SELECT round(avg(CASE WHEN shared_match_flag THEN 1 ELSE 0 END), 9) AS share_rate FROM trips",
)
def share_rate(spark, sf):
    return rounded(profile.share_rate(V.trips(spark, sf), F.col("shared_match_flag")), ["share_rate"], 9)


@query(
    "q_ecdf",
    """SELECT value, n, CAST(sum(n) OVER (ORDER BY value) AS BIGINT) AS upto,
    round(sum(n) OVER (ORDER BY value) / (SELECT count(*) FROM events), 9) AS y
    FROM (SELECT value, count(*) AS n FROM events GROUP BY 1)""",
)
def ecdf(spark, sf):
    return rounded(order_stats.ecdf(V.table(spark, sf, "events"), "value"), ["y"], 9)


@query(
    "q_histogram",
    """WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
    h AS (SELECT CAST(least(floor((value - lo) / (hi - lo) * 200), 199) AS INTEGER) AS bin, count(*) AS n FROM events, e GROUP BY 1)
    SELECT bin, round(lo + bin * ((hi - lo) / 200), 6) AS bin_lo, round(lo + (bin + 1) * ((hi - lo) / 200), 6) AS bin_hi, n
    FROM h, e""",
)
def histogram(spark, sf):
    return rounded(order_stats.histogram(V.table(spark, sf, "events"), "value", 200), ["bin_lo", "bin_hi"])


@query(
    "q_log_histogram",
    f"""WITH {V.TRIPS_SQL}, p AS (SELECT quantile_cont(commission, 0.95) AS q FROM trips),
    t AS (SELECT log10(commission) AS v FROM trips, p WHERE commission >= q AND commission >= 0.01),
    e AS (SELECT log10(greatest((SELECT q FROM p), 0.01::DOUBLE)) AS lo, max(v) AS hi FROM t),
    h AS (SELECT CAST(least(floor((v - lo) / (hi - lo) * 59), 58) AS INTEGER) AS bin, count(*) AS n FROM t, e GROUP BY 1)
    SELECT bin, round(pow(10, lo + bin * ((hi - lo) / 59)), 6) AS bin_lo,
           round(pow(10, lo + (bin + 1) * ((hi - lo) / 59)), 6) AS bin_hi, n FROM h, e""",
)
def log_histogram(spark, sf):
    return rounded(order_stats.log_tail_histogram(V.trips(spark, sf), "commission"), ["bin_lo", "bin_hi"])


@query(
    "q_capped_bins",
    f"""WITH {V.TRIPS_SQL}, z AS (SELECT PULocationID, DOLocationID, round(avg(y_cpm), 6) AS v FROM trips WHERE y_cpm > 0 GROUP BY 1, 2),
    q AS (SELECT quantile_cont(v, 0.95) AS cap, quantile_cont(v, 0.99) AS far FROM z),
    c AS (SELECT PULocationID, DOLocationID, v, least(v, cap) AS capped, CASE WHEN v > far THEN 1 ELSE 0 END AS is_outlier FROM z, q),
    e AS (SELECT list_sort(list_distinct(quantile_cont(capped, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS x FROM c),
    pad AS (SELECT list_concat([x[1] - 0.01::DOUBLE], x[2:-2], [x[-1] + 0.01::DOUBLE]) AS x FROM e)
    SELECT PULocationID, DOLocationID, round(capped, 6) AS capped, is_outlier,
           CAST(len(list_filter(x, lambda b: b <= capped)) AS INTEGER) AS bin FROM c, pad""",
)
def capped(spark, sf):
    zones = positive(V.trips(spark, sf), "y_cpm").groupBy("PULocationID", "DOLocationID").agg(
        F.round(F.avg("y_cpm"), 6).alias("v")
    )
    return rounded(order_stats.capped_bins(zones, "v").drop("v"), ["capped"])
