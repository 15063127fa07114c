"""Filters, metrics, unions and samples over the trip view."""

from __future__ import annotations

from pyspark.sql import functions as F

from fareframe.functions.calendar import duration_seconds, speed_mph
from fareframe.functions.numbers import distance_band, yn
from fareframe.operators import clean, features, metrics, profile, sampling, setops
from fareframe.operators.order_stats import equal_width_cut
from workbook import views as V
from workbook.registry import query, rounded

# Money has at most 5 and 7 decimals here, so decimal sums are exact and free of summation order.
TRIP_COUNTS = """count(*) AS n, CAST(sum(CAST(base_passenger_fare AS DECIMAL(18, 5))) AS DOUBLE) AS fare,
    CAST(sum(CAST(driver_pay AS DECIMAL(18, 7))) AS DOUBLE) AS pay"""


def _totals(df, *keys):
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("base_passenger_fare").cast("decimal(18,5)")).cast("double").alias("fare"),
        F.sum(F.col("driver_pay").cast("decimal(18,7)")).cast("double").alias("pay"),
    )


@query("q_provider_filter", f"WITH {V.RAW_SQL} SELECT PULocationID, {TRIP_COUNTS} FROM raw WHERE provider_code = 'N' GROUP BY 1")
def provider_filter(spark, sf):
    raw = V.raw_trips(spark, sf).withColumn("provider_code", F.concat(F.lit(" "), F.lower("provider_code")))
    return _totals(clean.filter_provider(raw, "provider_code", "N"), "PULocationID")


# Some required values are blanked out by their toll so that the filter has work to do.
BLANKED_SQL = """blanked AS (
  SELECT provider_code, trip_miles, DOLocationID,
         CASE WHEN tolls <> 0.05 THEN base_passenger_fare END AS base_passenger_fare,
         CASE WHEN tolls > 0 THEN driver_pay END AS driver_pay FROM raw)"""


@query(
    "q_required_not_null",
    f"""WITH {V.RAW_SQL}, {BLANKED_SQL} SELECT provider_code, {TRIP_COUNTS} FROM blanked
    WHERE base_passenger_fare IS NOT NULL AND driver_pay IS NOT NULL GROUP BY 1""",
)
def required_not_null(spark, sf):
    raw = V.raw_trips(spark, sf).withColumns(
        {
            "base_passenger_fare": F.when(F.col("tolls") != 0.05, F.col("base_passenger_fare")),
            "driver_pay": F.when(F.col("tolls") > 0, F.col("driver_pay")),
        }
    )
    return _totals(clean.require_not_null(raw), "provider_code")


@query(
    "q_valid_trips",
    f"""WITH {V.RAW_SQL}, shifted AS (
      SELECT provider_code, trip_miles - CASE WHEN trip_part = 1 THEN 2 ELSE 0 END AS trip_miles,
             trip_time - CASE WHEN trip_part = 2 THEN 300 ELSE 0 END AS trip_time,
             base_passenger_fare, driver_pay - CASE WHEN trip_part = 3 THEN 5 ELSE 0 END AS driver_pay FROM raw)
    SELECT provider_code, {TRIP_COUNTS} FROM shifted
    WHERE trip_miles >= 0 AND trip_time > 0 AND base_passenger_fare >= 0 AND driver_pay >= 0 GROUP BY 1""",
)
def valid(spark, sf):
    part = F.col("trip_part")
    raw = V.raw_trips(spark, sf).withColumns(
        {
            "trip_miles": F.col("trip_miles") - F.when(part == 1, 2).otherwise(0),
            "trip_time": F.col("trip_time") - F.when(part == 2, 300).otherwise(0),
            "driver_pay": F.col("driver_pay") - F.when(part == 3, 5).otherwise(0),
        }
    )
    return _totals(clean.valid_trips(raw), "provider_code")


@query(
    "q_analysis_extract",
    f"""WITH {V.RAW_SQL} SELECT trip_key, trip_part, trip_time AS duration_sec,
    trip_time / 3600.0::DOUBLE AS duration_hours, trip_miles / (trip_time / 3600.0::DOUBLE) AS mph
    FROM raw WHERE provider_code = 'N'""",
)
def extract(spark, sf):
    own = clean.filter_provider(V.raw_trips(spark, sf), "provider_code", "N")
    return clean.analysis_extract(own).select("trip_key", "trip_part", "duration_sec", "duration_hours", "mph")


@query(
    "q_commission_metrics",
    f"""WITH {V.TRIPS_SQL} SELECT trip_key, trip_part, trip_duration_minutes, avg_speed_mph, commission, take_rate,
    commission_per_mile, commission_per_minute, driver_efficiency, CAST(pickup_date AS VARCHAR) AS pickup_date FROM trips""",
)
def commission(spark, sf):
    return V.trips(spark, sf).select(
        "trip_key", "trip_part", "trip_duration_minutes", "avg_speed_mph", "commission", "take_rate",
        "commission_per_mile", "commission_per_minute", "driver_efficiency",
        F.col("pickup_date").cast("string").alias("pickup_date"),
    )


@query(
    "q_fare_metrics",
    f"""WITH {V.RAW_SQL} SELECT trip_key, trip_part,
    CASE WHEN trip_miles > 0 THEN base_passenger_fare / trip_miles ELSE 0 END AS revenue_per_mile,
    base_passenger_fare * 60.0::DOUBLE / trip_time AS revenue_per_minute FROM raw""",
)
def fares(spark, sf):
    df = metrics.fare_metrics(V.raw_trips(spark, sf))
    return df.select("trip_key", "trip_part", "revenue_per_mile", "revenue_per_minute")


@query(
    "q_with_cpm",
    f"""WITH {V.TRIPS_SQL} SELECT trip_key, trip_part, commission / trip_miles AS y_cpm,
    round(ln(trip_miles + 0.000001::DOUBLE), 9) AS log_trip_miles FROM trips WHERE trip_miles > 0.6""",
)
def cpm(spark, sf):
    df = metrics.with_cpm(V.trips(spark, sf), min_miles=0.6)
    return rounded(df.select("trip_key", "trip_part", "y_cpm", "log_trip_miles"), ["log_trip_miles"], 9)


@query(
    "q_drop_negative",
    f"WITH {V.TRIPS_SQL} SELECT PULocationID, {TRIP_COUNTS} FROM trips WHERE commission >= 0 GROUP BY 1",
)
def no_negative(spark, sf):
    return _totals(clean.drop_negative(V.trips(spark, sf), "commission"), "PULocationID")


@query(
    "q_within",
    f"""WITH {V.TRIPS_SQL} SELECT DOLocationID, {TRIP_COUNTS} FROM trips
    WHERE trip_miles BETWEEN 1 AND 20 AND trip_time BETWEEN 300 AND 2400 GROUP BY 1""",
)
def in_range(spark, sf):
    df = clean.within(V.trips(spark, sf), {"trip_miles": (1, 20), "trip_time": (300, 2400)})
    return _totals(df, "DOLocationID")


@query(
    "q_sql_predicate",
    f"""WITH {V.TRIPS_SQL} SELECT pickup_hour, {TRIP_COUNTS} FROM trips
    WHERE commission < 0 AND PULocationID <> DOLocationID GROUP BY 1""",
)
def predicate(spark, sf):
    df = clean.where_sql(V.trips(spark, sf), "commission < 0 AND PULocationID <> DOLocationID")
    return _totals(df.withColumn("pickup_hour", F.hour("pickup_datetime")), "pickup_hour")


@query(
    "q_positive",
    f"WITH {V.TRIPS_SQL} SELECT PULocationID, {TRIP_COUNTS} FROM trips WHERE y_cpm > 0 GROUP BY 1",
)
def positive(spark, sf):
    return _totals(clean.positive(V.trips(spark, sf), "y_cpm"), "PULocationID")


@query(
    "q_drop_na_zones",
    f"""WITH {V.LABELLED_SQL}, marked AS (
      SELECT base_passenger_fare, driver_pay, CASE WHEN PU_Borough = 'AFRICA' THEN 'N/A' ELSE PU_Borough END AS p,
             CASE WHEN DO_Borough <> 'EUROPE' THEN DO_Borough END AS d FROM labelled)
    SELECT p AS PU_Borough, {TRIP_COUNTS} FROM marked WHERE p <> 'N/A' AND d <> 'N/A' GROUP BY 1""",
)
def na_zones(spark, sf):
    df = V.labelled_trips(spark, sf).withColumns(
        {
            "PU_Borough": F.when(F.col("PU_Borough") == "AFRICA", "N/A").otherwise(F.col("PU_Borough")),
            "DO_Borough": F.when(F.col("DO_Borough") != "EUROPE", F.col("DO_Borough")),
        }
    )
    return _totals(clean.drop_na_zones(df), "PU_Borough")


@query(
    "q_early_prune",
    f"WITH {V.RAW_SQL} SELECT trip_key, trip_part, PULocationID, DOLocationID, base_passenger_fare, driver_pay FROM raw",
)
def early_prune(spark, sf):
    df = clean.drop_existing(V.raw_trips(spark, sf))
    return df.select([c for c in df.columns if c not in _NOT_COMPARED])


_NOT_COMPARED = {
    "provider_code", "pickup_datetime", "dropoff_datetime", "trip_miles", "trip_time", "shared_match_flag",
    "shared_request_flag",
}


@query(
    "q_yes_no",
    f"""WITH {V.RAW_SQL} SELECT upper(shared_request_flag) = 'Y' AS shared, {TRIP_COUNTS} FROM raw GROUP BY 1""",
)
def yes_no(spark, sf):
    return _totals(V.raw_trips(spark, sf).withColumn("shared", yn(F.col("shared_request_flag"))), "shared")


@query(
    "q_clock_duration",
    f"""WITH {V.RAW_SQL} SELECT trip_key, trip_part, CAST(trip_time AS BIGINT) AS duration_sec,
    trip_miles / (trip_time / 3600.0::DOUBLE) AS mph FROM raw""",
)
def clock_duration(spark, sf):
    seconds = duration_seconds(F.col("pickup_datetime"), F.col("dropoff_datetime"))
    df = V.raw_trips(spark, sf).withColumn("duration_sec", seconds)
    return df.select("trip_key", "trip_part", "duration_sec", speed_mph(F.col("trip_miles"), F.col("duration_sec")).alias("mph"))


BAND_SQL = """CASE WHEN trip_miles <= 2 THEN '0-2mi' WHEN trip_miles <= 5 THEN '2-5mi' WHEN trip_miles <= 10 THEN '5-10mi'
    WHEN trip_miles <= 20 THEN '10-20mi' ELSE '20+mi' END"""


@query(
    "q_distance_band",
    f"WITH {V.RAW_SQL} SELECT {BAND_SQL} AS dist_band, {TRIP_COUNTS} FROM raw GROUP BY 1",
)
def bands(spark, sf):
    df = V.raw_trips(spark, sf).withColumn("dist_band", distance_band(F.col("trip_miles"), suffix="mi"))
    return _totals(df, "dist_band")


# Unions, keys and overlaps on the orders and events tables.


@query(
    "q_union_by_name",
    """SELECT yr, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (
      SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, o_totalprice, CASE WHEN year(o_orderdate) >= 1998 THEN o_orderpriority END
             AS o_orderpriority FROM orders) GROUP BY 1, 2""",
)
def union_by_name(spark, sf):
    o = V.table(spark, sf, "orders").withColumn("yr", F.year("o_orderdate"))
    df = setops.union_years(o.where("yr < 1998").drop("o_orderpriority"), o.where("yr >= 1998"))
    return df.groupBy("yr", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query(
    "q_union_strict",
    """SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1
    UNION ALL SELECT 'ALL', count(*) FROM orders""",
)
def union_strict(spark, sf):
    counts = V.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.lit("ALL").alias("label"), F.sum("n").alias("n"))
    return setops.union_strict(counts, total)


@query(
    "q_intersect_dates",
    """SELECT CAST(o_orderdate AS VARCHAR) AS d FROM (
      SELECT CAST(o_orderdate AS DATE) AS o_orderdate FROM orders
      INTERSECT SELECT CAST(l_shipdate AS DATE) FROM lineitem)""",
)
def intersect_dates(spark, sf):
    o = V.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"))
    li = V.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("s"))
    return setops.common_values(o, "d", li, "s").select(F.col("d").cast("string").alias("d"))


@query(
    "q_date_overlap",
    """WITH a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders),
    b AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem)
    SELECT (SELECT count(*) FROM a) AS left_dates, (SELECT count(*) FROM b) AS right_dates,
           (SELECT count(*) FROM a JOIN b USING (d)) AS common_dates""",
)
def date_overlap(spark, sf):
    o = V.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"))
    li = V.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("s"))
    return setops.date_overlap(o, "d", li, "s")


@query(
    "q_dedupe_key",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
    WHERE rn = 1""",
)
def dedupe(spark, sf):
    df = setops.dedupe_key(V.table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return df.select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "q_first_per_key",
    """WITH o AS (SELECT o_custkey, o_orderdate, o_orderkey,
      CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS s, o_orderpriority AS p FROM orders)
    SELECT o_custkey, first(s ORDER BY o_orderdate, o_orderkey) FILTER (s IS NOT NULL) AS first_status,
           first(p ORDER BY o_orderdate, o_orderkey) AS first_priority FROM o GROUP BY 1""",
)
def first_values(spark, sf):
    o = V.table(spark, sf, "orders").select(
        "o_custkey", "o_orderdate", "o_orderkey",
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("first_status"),
        F.col("o_orderpriority").alias("first_priority"),
    )
    df = setops.first_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return df.select("o_custkey", "first_status", "first_priority")


@query(
    "q_duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicates(spark, sf):
    return setops.duplicate_keys(V.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def _in_sample(keys: str, fraction: str, seed: int = 0) -> str:
    """The sampling rule of ``in_hash_sample`` in SQL; ``keys`` is a list of text columns."""
    digits = f"substr(md5(concat_ws('|', '{seed}', {keys})), 1, 15)"
    return f"CAST('0x' || {digits} AS BIGINT) < {fraction} * 1152921504606846976.0::DOUBLE"


@query(
    "q_hash_sample",
    f"""SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE {_in_sample("o_orderkey::VARCHAR", "0.2::DOUBLE", 202401)}""",
)
def hash_sample(spark, sf):
    df = sampling.hash_sample(V.table(spark, sf, "orders"), ["o_orderkey"], 0.2, seed=sampling.month_seed(2024, 1))
    return df.select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "q_bernoulli_sample",
    f"""WITH {V.TRIPS_SQL} SELECT true AS within_5_sigma, true AS from_table FROM (SELECT count(*) AS n FROM trips) WHERE n > 0""",
)
def bernoulli(spark, sf):
    """A row sample has no exact SQL; its size and membership do."""
    trips = V.trips(spark, sf)
    keys = ["trip_key", "trip_part"]
    taken = sampling.bernoulli(trips, 0.05, 42).groupBy(*keys).agg(F.count(F.lit(1)).alias("taken"))
    all_ = trips.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    both = all_.join(taken, keys, "full").agg(F.sum("taken").alias("taken"), F.sum("n").alias("n"), F.max(F.col("n").isNull() | (F.col("taken") > F.col("n"))).alias("foreign"))
    near = F.abs(F.col("taken") - 0.05 * F.col("n")) <= 5 * F.sqrt(0.05 * 0.95 * F.col("n"))
    return both.select(near.alias("within_5_sigma"), (~F.col("foreign")).alias("from_table"))


@query(
    "q_sample_n_by",
    """SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority
    ORDER BY substr(md5(concat_ws('|', '7', o_orderkey::VARCHAR)), 1, 15), o_orderkey) <= CASE o_orderpriority WHEN '1-URGENT' THEN 500 WHEN '5-LOW' THEN 100000 ELSE 0 END""",
)
def sample_per_stratum(spark, sf):
    """Exact sizes per stratum; one is asked for more than it has."""
    taken = sampling.sample_n_by(V.table(spark, sf, "orders"), {"1-URGENT": 500, "5-LOW": 100_000}, "o_orderpriority", ["o_orderkey"], seed=7)
    return taken.select("o_orderpriority", "o_orderkey", "o_totalprice")


@query(
    "q_sample_n",
    """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
    ORDER BY substr(md5(concat_ws('|', '42', l_orderkey::VARCHAR, l_linenumber::VARCHAR)), 1, 15), l_orderkey, l_linenumber LIMIT 5000""",
)
def sample_n(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return sampling.sample_n(li, 5000, ["l_orderkey", "l_linenumber"])


@query("q_stratified_sample", "SELECT count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS strata, true AS all_near_half FROM orders")
def stratified(spark, sf):
    """Every month is sampled at one half, within six standard deviations."""
    o = V.table(spark, sf, "orders").withColumn("ym", F.date_format("o_orderdate", "yyyy-MM"))
    n = o.groupBy("ym").agg(F.count(F.lit(1)).alias("n"))
    taken = sampling.stratified(o, "ym", 0.5).groupBy("ym").agg(F.count(F.lit(1)).alias("taken"))
    both = n.join(taken, "ym", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    near = F.abs(F.col("taken") - F.col("n") / 2) <= 6 * F.sqrt(F.col("n") / 4)
    return both.agg(F.count(F.lit(1)).alias("strata"), F.min(near).alias("all_near_half"))


@query(
    "q_stratified_hash",
    f"""SELECT o_orderpriority, count(*) AS n FROM orders WHERE {_in_sample("o_orderkey::VARCHAR",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 0.5::DOUBLE WHEN '5-LOW' THEN 0.1::DOUBLE ELSE 0 END")} GROUP BY 1""",
)
def stratified_hash(spark, sf):
    fractions = {"1-URGENT": 0.5, "5-LOW": 0.1}
    df = sampling.stratified_hash(V.table(spark, sf, "orders"), "o_orderpriority", fractions, ["o_orderkey"])
    return df.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q_year_split",
    f"""WITH {V.TRIPS_SQL} SELECT CASE WHEN year(pickup_date) <= 1996 THEN 'train' ELSE 'test' END AS part, {TRIP_COUNTS}
    FROM trips GROUP BY 1""",
)
def year_split(spark, sf):
    df = V.trips(spark, sf).withColumn("year", F.year("pickup_date"))
    train, test = sampling.year_split(df, 1996)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return _totals(both, "part")


@query(
    "q_top_k",
    f"""WITH {V.TRIPS_SQL} SELECT trip_key, trip_part, commission FROM trips
    ORDER BY abs(commission) DESC, trip_key, trip_part, commission LIMIT 50""",
)
def top_k(spark, sf):
    order = [F.desc(F.abs("commission")), F.asc("trip_key"), F.asc("trip_part"), F.asc("commission")]
    return sampling.top_k(V.trips(spark, sf).select("trip_key", "trip_part", "commission"), order, 50)


NUMERIC = ["trip_miles", "trip_time", "trip_duration_minutes", "avg_speed_mph", "base_passenger_fare", "driver_pay", "commission"]
PAIRS_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM trips"
    for i, a in enumerate(NUMERIC)
    for b in NUMERIC[i + 1 :]
)


@query("q_correlations", f"WITH {V.TRIPS_SQL} SELECT a, b, round(r, 6) AS r FROM ({PAIRS_SQL})")
def correlations(spark, sf):
    return rounded(features.correlations(V.trips(spark, sf), NUMERIC), ["r"])


@query(
    "q_correlation_pairs",
    f"WITH {V.TRIPS_SQL} SELECT a, b, round(r, 6) AS r FROM ({PAIRS_SQL}) WHERE abs(r) >= 0.9",
)
def correlation_pairs(spark, sf):
    return rounded(features.correlation_pairs(V.trips(spark, sf), NUMERIC), ["r"])


@query(
    "q_suggest_removals",
    f"""WITH {V.TRIPS_SQL}, pairs AS ({PAIRS_SQL})
    SELECT DISTINCT CASE WHEN b LIKE '%revenue_per%' THEN b WHEN a LIKE '%revenue_per%' THEN a ELSE b END AS "column"
    FROM pairs WHERE abs(r) >= 0.8 UNION SELECT 'trip_duration_minutes' UNION SELECT 'avg_speed_mph'""",
)
def removals(spark, sf):
    return features.removal_set(V.trips(spark, sf), 0.8, NUMERIC)


@query(
    "q_label_pairs",
    f"""WITH {V.LABELLED_SQL} SELECT count(DISTINCT (time_period, rush_hour_label)) AS pairs,
    count(DISTINCT time_period) AS left_values, count(DISTINCT rush_hour_label) AS right_values FROM labelled""",
)
def label_pairs(spark, sf):
    return features.label_pair_counts(V.labelled_trips(spark, sf), "time_period", "rush_hour_label")


@query(
    "q_prune_features",
    f"""WITH {V.WEATHER_TRIPS_SQL} SELECT fog_flag, is_hot, count(*) AS n, round(avg(temp_avg_calculated), 6) AS temp
    FROM wtrips GROUP BY 1, 2""",
)
def prune(spark, sf):
    kept = features.prune_features(V.weather_trips(spark, sf))
    return rounded(
        kept.groupBy("fog_flag", "is_hot").agg(F.count(F.lit(1)).alias("n"), F.avg("temp_avg_calculated").alias("temp")),
        ["temp"],
    )


@query(
    "q_screen_features",
    f"""WITH {V.TRIPS_SQL} SELECT trip_key, trip_part, commission, take_rate FROM trips""",
)
def screen(spark, sf):
    df = features.screen_features(V.trips(spark, sf))
    return df.select("trip_key", "trip_part", "commission", "take_rate")


@query(
    "q_n_distinct",
    f"""WITH {V.RAW_SQL} SELECT 'PULocationID' AS "column", count(DISTINCT PULocationID) AS n_distinct FROM raw
    UNION ALL SELECT 'trip_time', count(DISTINCT trip_time) FROM raw
    UNION ALL SELECT 'trip_key', count(DISTINCT trip_key) FROM raw
    UNION ALL SELECT 'signed', count(DISTINCT CASE WHEN trip_miles > 5 THEN trip_miles ELSE 0 END) FROM raw""",
)
def distinct_counts(spark, sf):
    raw = V.raw_trips(spark, sf).withColumns({c: F.col(c).cast("bigint") for c in ("PULocationID", "trip_time", "trip_key")})
    zero = F.when(F.col("trip_time") % 2 == 0, F.lit(0.0)).otherwise(F.lit(-0.0))
    raw = raw.withColumn("signed", F.when(F.col("trip_miles") > 5, F.col("trip_miles")).otherwise(zero))
    return profile.n_distinct(raw, ["PULocationID", "trip_time", "trip_key", "signed"])


@query(
    "q_bitmap_distinct",
    f"""WITH {V.RAW_SQL} SELECT provider_code, 'trip_key' AS "column", count(DISTINCT trip_key) AS n_distinct FROM raw GROUP BY 1
    UNION ALL SELECT provider_code, 'shifted', count(DISTINCT trip_time - 1000) FROM raw GROUP BY 1""",
)
def bitmap_distinct(spark, sf):
    """Negative values too, and one bitmap of all parts of a provider's trips."""
    raw = V.raw_trips(spark, sf).withColumn("shifted", F.col("trip_time") - 1000)
    parts = profile.value_bitmaps(raw, ["trip_key", "shifted"], by=["provider_code", "PULocationID"])
    return profile.distinct_of_bitmaps(parts, by=["provider_code"])


@query(
    "q_equal_width_cut",
    f"""WITH {V.TRIPS_SQL}, e AS (SELECT min(trip_miles) AS lo, max(trip_miles) AS hi FROM trips)
    SELECT ['Very Cold', 'Cold', 'Moderate', 'Warm', 'Hot'][
      CAST(greatest(least(ceil((trip_miles - lo) / (hi - lo) * 5), 5), 1) AS INTEGER)] AS band, count(*) AS n
    FROM trips, e GROUP BY 1""",
)
def width_cut(spark, sf):
    df = equal_width_cut(V.trips(spark, sf), "trip_miles", ["Very Cold", "Cold", "Moderate", "Warm", "Hot"], "band")
    return df.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
