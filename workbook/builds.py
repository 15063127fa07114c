"""Feature builds, backfills and dimension files over the given tables, each written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from fareframe.operators.joins import join_od
from fareframe.operators.order_stats import quantiles
from fareframe.operators.zones import add_cbd_flags, add_trip_flags
from fareframe.plans import external, ingest
from fareframe.sources import dims, lake
from workbook import views as V
from workbook.registry import query, rounded


@query(
    "q_build_spatial",
    f"""WITH {V.RAW_SQL}, {V.ZONES_SQL} SELECT p.in_cbd AS "PU_in_cbd", d.in_cbd AS "DO_in_cbd", p.Borough <> d.Borough AS is_cross_borough, count(*) AS n,
    (SELECT count(*) * count(*) FROM zones) AS listed
    FROM raw JOIN zones p ON PULocationID = p.LocationID JOIN zones d ON DOLocationID = d.LocationID GROUP BY 1, 2, 3""",
)
def spatial(spark, sf):
    """The built lookup, joined to the raw trips."""
    path = lake.scratch_dir(spark, "od")
    od = external.build_spatial(V.zones(spark, sf), V.cbd_zones(spark, sf), path)
    listed = spark.read.json(f"{path}_manifest").select("rows").scalar()
    trips = join_od(V.raw_trips(spark, sf), od)
    return trips.groupBy("PU_in_cbd", "DO_in_cbd", "is_cross_borough").agg(F.count(F.lit(1)).alias("n")).withColumn("listed", listed)


HOLIDAY_SQL = ", ".join(f"DATE '{d}'" for d, _ in V.HOLIDAYS)


@query(
    "q_build_temporal",
    f"""WITH h AS (SELECT unnest(generate_series(
      (SELECT min(o_orderdate)::DATE FROM orders)::TIMESTAMP, (SELECT max(o_orderdate)::DATE FROM orders) + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS ts)
    SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, count(*) AS hours,
    count(*) FILTER (ts::DATE IN ({HOLIDAY_SQL})) AS holiday_hours FROM h GROUP BY 1, 2""",
)
def temporal(spark, sf):
    path = lake.scratch_dir(spark, "calendar")
    ends = V.table(spark, sf, "orders").agg(F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi")).first()
    holidays = spark.createDataFrame(V.HOLIDAYS, "holiday_date string, holiday_name string").withColumn("holiday_date", F.to_date("holiday_date"))
    grid = external.build_temporal(spark, str(ends["lo"]), str(ends["hi"]), holidays, path)
    return grid.groupBy("year", "month").agg(F.count(F.lit(1)).alias("hours"), F.count_if("is_holiday").alias("holiday_hours"))


@query(
    "q_build_weather",
    f"""WITH {V.DAY_SQL} SELECT CAST(year(weather_date) AS INTEGER) AS year, count(*) AS days, round(sum(precipitation_mm), 6) AS precip,
    CAST(sum(is_snow) AS BIGINT) AS snow FROM day GROUP BY 1""",
)
def weather(spark, sf):
    path = lake.scratch_dir(spark, "weather")
    built = external.build_weather(V.station_records(spark, sf), path, "imperial")
    out = built.groupBy("year").agg(
        F.count(F.lit(1)).alias("days"), F.sum("precipitation_mm").alias("precip"), F.sum("is_snow").cast("bigint").alias("snow")
    )
    return rounded(out, ["precip"])


@query(
    "q_backfill",
    f"WITH {V.RAW_SQL} SELECT CAST(year(pickup_datetime) AS INTEGER) AS year, count(*) AS n, count(*) AS written FROM raw GROUP BY 1",
)
def backfill(spark, sf):
    """All source folders in one job; the count seen while writing agrees with the lake."""
    base, path = lake.scratch_dir(spark, "sources"), lake.scratch_dir(spark, "lake")
    raw = V.raw_trips(spark, sf)
    halves = [f"{base}/a", f"{base}/b"]
    for i, half in enumerate(halves):
        raw.where(F.pmod(F.xxhash64("pickup_datetime"), F.lit(2)) == i).write.parquet(half)
    rows = ingest.backfill(spark, halves, path)
    back = spark.read.parquet(path)
    if back.count() != rows:
        raise ValueError("the observed count is wrong")
    return back.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count("ingest_ts").alias("written"))


@query(
    "q_ingest_each",
    f"""WITH {V.RAW_SQL}, months AS (SELECT CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month FROM range(1995, 2002) a(y), range(1, 13) b(m)),
    r AS (SELECT year(pickup_datetime) AS year, month(pickup_datetime) AS month, count(*) AS n, CAST(sum(CAST(round(driver_pay * 10000) AS BIGINT)) AS BIGINT) AS pay FROM raw GROUP BY 1, 2)
    SELECT m.year, m.month, CASE WHEN n IS NULL THEN 'failed' ELSE 'success' END AS status, n AS "rows", pay
    FROM months m LEFT JOIN r ON r.year = m.year AND r.month = m.month""",
)
def each(spark, sf):
    """Every month of seven years from a folder of its own; months without one fail alone, and all others are published."""
    base, path = lake.scratch_dir(spark, "months"), lake.scratch_dir(spark, "lake")
    raw = V.raw_trips(spark, sf).withColumns({"year": F.year("pickup_datetime"), "month": F.month("pickup_datetime")})
    lake.write_partitioned(raw, base)
    states = ingest.ingest_each(spark, {(y, m): f"{base}/year={y}/month={m}" for y in range(1995, 2002) for m in range(1, 13)}, path)
    told = spark.createDataFrame([(s["year"], s["month"], s["status"], s.get("rows")) for s in states], "year int, month int, status string, rows bigint")
    pay = lake.read_lake(spark, path).groupBy("year", "month").agg(F.sum(F.round(F.col("driver_pay") * 10000).cast("bigint")).alias("pay"))
    return told.join(pay, ["year", "month"], "left")


@query(
    "q_flag_dim",
    f"""WITH {V.RAW_SQL} SELECT CASE WHEN PULocationID % 4 = 0 THEN 1 ELSE 0 END AS "PU_in_cbd",
    CASE WHEN DOLocationID % 4 = 0 THEN 1 ELSE 0 END AS "DO_in_cbd", count(*) AS n FROM raw GROUP BY 1, 2""",
)
def flag_dim(spark, sf):
    """Raw trips flagged by a mapping read from CSV files with repeated rows."""
    path = lake.scratch_dir(spark, "flags")
    zones = V.zones(spark, sf).select("LocationID", F.when(F.col("LocationID") % 4 == 0, 1).otherwise(0).alias("in_cbd"))
    zones.unionByName(zones).write.option("header", True).csv(path)
    flagged = add_cbd_flags(V.raw_trips(spark, sf), dims.read_flag_dim(spark, path))
    return flagged.groupBy("PU_in_cbd", "DO_in_cbd").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q_holiday_dim",
    "SELECT CAST(o_orderdate AS DATE)::VARCHAR AS holiday_date, min(o_orderpriority) AS holiday_name FROM orders GROUP BY 1",
)
def holiday_dim(spark, sf):
    """Repeated dates keep their first name."""
    path = lake.scratch_dir(spark, "holidays")
    days = V.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("holiday_name"))
    days.write.option("header", True).csv(path)
    return dims.read_holiday_dim(spark, path).select(F.col("holiday_date").cast("string"), "holiday_name")


@query(
    "q_load_features",
    f"""WITH {V.DAY_SQL}, m AS (SELECT count(*) AS n FROM day WHERE year(weather_date) = 1996 AND month(weather_date) = 5)
    SELECT n, (SELECT count(*) FROM day) AS total, true AS has_weather, false AS has_calendar FROM m""",
)
def load(spark, sf):
    base = lake.scratch_dir(spark, "features")
    external.build_weather(V.station_records(spark, sf), f"{base}/weather", "imperial")
    known = lake.feature_availability(spark, {"weather": f"{base}/weather", "calendar": f"{base}/calendar"})
    month = lake.load_features(spark, base, "weather", 1996, 5).agg(F.count(F.lit(1)).alias("n"))
    total = lake.read_first_of(spark, [f"{base}/calendar", f"{base}/weather"]).agg(F.count(F.lit(1))).scalar()
    return month.withColumns({"total": total, "has_weather": F.lit(known["weather"]), "has_calendar": F.lit(known["calendar"])})


NULL_FLAGS_SQL = f"""WITH {V.RAW_SQL}, {V.ZONES_SQL}, z AS (SELECT LocationID, CASE WHEN LocationID % 5 <> 0 THEN Borough END AS b FROM zones)
SELECT {{cross}} AS is_cross_borough, count(*) AS n FROM raw LEFT JOIN z p ON PULocationID = p.LocationID
LEFT JOIN z d ON DOLocationID = d.LocationID GROUP BY 1"""


def _flags(spark, sf, null_as):
    zones = V.zones(spark, sf).withColumn("Borough", F.when(F.col("LocationID") % 5 != 0, F.col("Borough")))
    from fareframe.operators.joins import join_zone_roles

    df = add_trip_flags(join_zone_roles(V.raw_trips(spark, sf), zones), null_as=null_as, borough=V.BOROUGH)
    return df.groupBy("is_cross_borough").agg(F.count(F.lit(1)).alias("n"))


@query("q_null_borough_unknown", NULL_FLAGS_SQL.format(cross="p.b <> d.b"))
def null_unknown(spark, sf):
    return _flags(spark, sf, None)


@query("q_null_borough_false", NULL_FLAGS_SQL.format(cross="coalesce(p.b <> d.b, false)"))
def null_false(spark, sf):
    return _flags(spark, sf, False)


@query(
    "q_quantiles_by_month",
    f"""WITH {V.TRIPS_SQL}, m AS (SELECT strftime(pickup_date, '%Y-%m') AS ym, commission FROM trips)
    SELECT ym, 'commission' AS "column", p::DOUBLE AS p, round(v, 9) AS value FROM (
      SELECT ym, unnest([0.01, 0.5, 0.99]) AS p,
             unnest(quantile_cont(commission, [0.01, 0.5, 0.99])) AS v FROM m GROUP BY ym)""",
)
def by_month(spark, sf):
    trips = V.trips(spark, sf).select(F.date_format("pickup_date", "yyyy-MM").alias("ym"), "commission")
    return rounded(quantiles(trips, "commission", [0.01, 0.5, 0.99], by=["ym"]), ["value"], 9)
