"""Reads and writes of the trip lake. Each query writes below a scratch folder and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from fareframe.operators import quality
from fareframe.operators.zones import build_od_features
from fareframe.plans import mart
from fareframe.sources import dims, footers, lake
from workbook import views as V
from workbook.registry import query, rounded


def _monthly(spark, sf):
    return V.raw_trips(spark, sf).withColumns(
        {"year": F.year("pickup_datetime"), "month": F.month("pickup_datetime")}
    )


@query(
    "q_write_read_partitioned",
    f"""WITH {V.RAW_SQL} SELECT CAST(year(pickup_datetime) AS INTEGER) AS year, CAST(month(pickup_datetime) AS INTEGER) AS month,
    count(*) AS n, round(sum(base_passenger_fare), 6) AS fare FROM raw
    WHERE year(pickup_datetime) IN (1996, 1997) AND month(pickup_datetime) <= 6 GROUP BY 1, 2""",
)
def write_read(spark, sf):
    path = lake.scratch_dir(spark, "trips")
    df = _monthly(spark, sf)
    lake.write_partitioned(df, path)
    # A second, partial write replaces its own months only.
    lake.write_partitioned(df.where("year = 1996 and month = 3"), path)
    back = lake.read_lake(spark, path, years=[1996, 1997], months=range(1, 7))
    return back.groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("base_passenger_fare"), 6).alias("fare")
    )


@query(
    "q_list_partitions",
    f"""WITH {V.RAW_SQL} SELECT DISTINCT CAST(year(pickup_datetime) AS INTEGER) AS year,
    CAST(month(pickup_datetime) AS INTEGER) AS month FROM raw""",
)
def partitions(spark, sf):
    path = lake.scratch_dir(spark, "parts")
    lake.write_partitioned(_monthly(spark, sf), path)
    return lake.list_partitions(spark, path)


@query(
    "q_read_month",
    f"""WITH {V.RAW_SQL} SELECT provider_code, count(*) AS n, round(sum(base_passenger_fare), 6) AS fare FROM raw
    WHERE year(pickup_datetime) = 1996 AND month(pickup_datetime) = 5 GROUP BY 1""",
)
def one_month(spark, sf):
    path = lake.scratch_dir(spark, "months")
    lake.write_partitioned(_monthly(spark, sf), path)
    if not lake.month_available(spark, path, 1996, 5) or lake.month_available(spark, path, 1990, 5):
        raise ValueError("month probe is wrong")
    return lake.read_month(spark, path, 1996, 5).groupBy("provider_code").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("base_passenger_fare"), 6).alias("fare")
    )


@query(
    "q_report_round_trip",
    f"""WITH {V.TRIPS_SQL} SELECT 'commission' AS "column", count(*) AS n, min(commission) AS min, max(commission) AS max
    FROM trips""",
)
def report(spark, sf):
    path = lake.scratch_dir(spark, "report")
    lake.write_report(quality.basic_stats(V.trips(spark, sf), ["commission"]), path)
    return spark.read.parquet(path).select("column", "n", "min", "max")


@query(
    "q_thresholds_round_trip",
    f"""WITH {V.TRIPS_SQL} SELECT count(*) AS n FROM trips
    WHERE trip_miles BETWEEN (SELECT quantile_cont(trip_miles, 0.01) FROM trips) AND (SELECT quantile_cont(trip_miles, 0.99) FROM trips)""",
)
def thresholds(spark, sf):
    from fareframe.operators.clean import within

    df = V.trips(spark, sf)
    path = lake.scratch_dir(spark, "limits")
    table = quality.thresholds(df, {"trip_miles": {"method": "percentile", "lower": 1, "upper": 99}})
    lake.write_thresholds(table, path, generated_from="training")
    return within(df, lake.read_thresholds(spark, path)).agg(F.count(F.lit(1)).alias("n"))


@query("q_zone_csv", f"WITH {V.ZONES_SQL}, {V.RAW_SQL} SELECT Borough, count(*) AS n FROM raw JOIN zones ON PULocationID = LocationID GROUP BY 1")
def zone_csv(spark, sf):
    from fareframe.operators.joins import join_zone_roles

    path = lake.scratch_dir(spark, "zones")
    dim = V.zones(spark, sf)
    dim.unionByName(dim).write.option("header", True).csv(path)
    df = join_zone_roles(V.raw_trips(spark, sf), dims.read_zone_dim(spark, path))
    return df.groupBy(F.col("PU_Borough").alias("Borough")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "q_weather_csv",
    f"""WITH {V.CLASSES_SQL} SELECT season, count(*) AS days, round(sum(precipitation_mm), 6) AS precip_sum FROM days GROUP BY 1""",
)
def weather_csv(spark, sf):
    from fareframe.operators.weather import clean_imperial, day_classes, season_profile

    path = lake.scratch_dir(spark, "stations")
    V.station_records(spark, sf).write.option("header", True).csv(path)
    df = season_profile(day_classes(clean_imperial(dims.read_weather_raw(spark, path))))
    return rounded(df.select("season", "days", "precip_sum"), ["precip_sum"])


@query(
    "q_ingest",
    f"""WITH {V.RAW_SQL} SELECT CAST(year(pickup_datetime) AS INTEGER) AS year, count(*) AS n,
    round(sum(driver_pay), 7) AS pay, count(*) AS stamped FROM raw GROUP BY 1""",
)
def ingest(spark, sf):
    from fareframe.plans.ingest import ingest_trips

    path = lake.scratch_dir(spark, "raw")
    ingest_trips(V.raw_trips(spark, sf), path)
    return spark.read.parquet(path).groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("driver_pay"), 7).alias("pay"), F.count("ingest_ts").alias("stamped")
    )


MART_SQL = f"""WITH {V.WEATHER_TRIPS_SQL}, {V.ZONES_SQL},
kept AS (SELECT * FROM wtrips WHERE commission >= 0),
bounds AS (SELECT year(pickup_date) AS y, month(pickup_date) AS m, quantile_cont(commission, 0.01) AS lo,
           quantile_cont(commission, 0.99) AS hi FROM kept GROUP BY 1, 2),
mart AS (SELECT kept.* EXCLUDE (commission), least(greatest(commission, lo), hi) AS commission
         FROM kept JOIN bounds ON y = year(pickup_date) AND m = month(pickup_date) WHERE y = 1997 AND m = 6)"""


@query(
    "q_month_mart",
    f"""{MART_SQL} SELECT p.Borough AS PU_Borough, t.season, count(*) AS n, round(avg(commission), 6) AS commission,
    round(avg(commission / trip_miles), 6) AS commission_per_mile FROM mart t JOIN zones p ON PULocationID = p.LocationID
    GROUP BY 1, 2""",
)
def month_mart(spark, sf):
    sources = mart.Sources(
        trips=_monthly(spark, sf).withColumnRenamed("provider_code", "hvfhs_license_num"),
        zones=V.zones(spark, sf),
        calendar=V.calendar(spark, sf),
        weather=V.daily_weather(spark, sf),
    )
    built = mart.build_month(sources, 1997, 6, mart.Settings(provider="N"))
    out = built.trips.groupBy("PU_Borough", "season").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("commission").alias("commission"),
        F.avg("commission_per_mile").alias("commission_per_mile"),
    )
    return rounded(out, ["commission", "commission_per_mile"])


def _sources(spark, sf):
    """The raw trips as one folder per month, and the paths of all months of eight years, among them some without trips."""
    base = lake.scratch_dir(spark, "months")
    lake.write_partitioned(_monthly(spark, sf).withColumnRenamed("provider_code", "hvfhs_license_num"), base)
    return {(y, m): f"{base}/year={y}/month={m}" for y in range(1994, 2002) for m in range(1, 13)}


def _outcome(spark, sf, **settings):
    """States of a batch over all month folders, with every external feature; the mart's folder and that of its reports."""
    base = lake.scratch_dir(spark, "features")

    def stored(name, df):
        df.write.parquet(f"{base}/{name}")
        return lake.load_features(spark, base, name)

    od = build_od_features(V.zones(spark, sf), V.cbd_zones(spark, sf), airports=None, borough=V.BOROUGH)
    features = mart.Sources(
        zones=V.zones(spark, sf), od=stored("od", od), calendar=stored("calendar", V.calendar(spark, sf)), weather=stored("weather", V.daily_weather(spark, sf))
    )
    path, reports = lake.scratch_dir(spark, "mart"), lake.scratch_dir(spark, "mart-reports")
    states = mart.run_months(spark, _sources(spark, sf), path, features, mart.Settings(provider="N", **settings), reports=reports)
    table = spark.createDataFrame([(s["year"], s["month"], s["status"], s.get("rows")) for s in states], "year int, month int, status string, n bigint")
    return table, path, reports


MONTHS_SQL = "months AS (SELECT CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month FROM range(1994, 2002) a(y), range(1, 13) b(m))"


@query(
    "q_month_batch",
    f"""WITH {V.WEATHER_TRIPS_SQL}, {V.ZONES_SQL}, {V.HOLIDAYS_SQL}, {MONTHS_SQL},
    t AS (SELECT year(pickup_date) AS year, month(pickup_date) AS month, count(*) AS n,
      round(quantile_cont(commission, 0.01), 6) AS low, round(quantile_cont(commission, 0.99), 6) AS high,
      100.0::DOUBLE AS zone_pct, CAST(sum(CASE WHEN p.in_cbd = 1 AND d.in_cbd = 0 THEN 1 ELSE 0 END) AS BIGINT) AS outbound,
      count(holiday_name) AS holiday_trips, round(avg(temp_avg_calculated), 6) AS temp, CAST(sum(is_snow) AS BIGINT) AS snow_trips
    FROM wtrips JOIN zones p ON PULocationID = p.LocationID JOIN zones d ON DOLocationID = d.LocationID
    LEFT JOIN holidays ON holiday_date = pickup_date WHERE commission >= 0 GROUP BY 1, 2),
    r AS (SELECT DISTINCT year(pickup_datetime) AS year, month(pickup_datetime) AS month FROM raw)
    SELECT m.year, m.month, CASE WHEN r.year IS NULL THEN 'failed' ELSE 'success' END AS status,
           CASE WHEN r.year IS NOT NULL THEN coalesce(n, 0) END AS n, low, high, zone_pct, outbound, holiday_trips, temp, snow_trips
    FROM months m LEFT JOIN r ON r.year = m.year AND r.month = m.month LEFT JOIN t ON t.year = m.year AND t.month = m.month""",
)
def month_batch(spark, sf):
    """All month folders through the mart with every feature joined; months without a folder fail alone."""
    states, path, reports = _outcome(spark, sf)
    saved = lake.read_lake(spark, path).groupBy("year", "month").agg(
        F.count_if(F.col("trip_cbd_type") == "outbound_cbd").alias("outbound"), F.count_if("is_holiday").alias("holiday_trips"),
        F.round(F.avg("temp_avg_calculated"), 6).alias("temp"), F.sum("is_snow").cast("bigint").alias("snow_trips"),
    )
    bounds = spark.read.parquet(f"{reports}/removal_summary").select("year", "month", F.round("winsor_low", 6).alias("low"), F.round("winsor_high", 6).alias("high"))
    cover = spark.read.parquet(f"{reports}/coverage").where("column = 'PU_Borough'").select("year", "month", F.round("coverage_pct", 6).alias("zone_pct"))
    for more in (bounds, cover, saved):
        states = states.join(more, ["year", "month"], "left")
    return states


TAKEN_SQL = """CAST('0x' || substr(md5(concat_ws('|', (year(pickup_date) * 100 + month(pickup_date))::VARCHAR, trip_key::VARCHAR,
    trip_part::VARCHAR)), 1, 15) AS BIGINT) < 0.25::DOUBLE * 1152921504606846976.0::DOUBLE"""


@query(
    "q_month_batch_sampled",
    f"""WITH {V.TRIPS_SQL} SELECT CAST(year(pickup_date) AS INTEGER) AS year, CAST(month(pickup_date) AS INTEGER) AS month,
    count(*) FILTER (commission >= 0) AS n, count(*) AS sampled_count FROM trips WHERE {TAKEN_SQL} GROUP BY 1, 2""",
)
def month_batch_sampled(spark, sf):
    """A quarter of each month's trips by their hash; the mart agrees with its funnel."""
    states, path, reports = _outcome(spark, sf, sample_fraction=0.25, sample_keys=("trip_key", "trip_part"))
    saved = lake.read_lake(spark, path).groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"))
    funnel = spark.read.parquet(f"{reports}/removal_summary").where("sampled_count > 0").select("year", "month", "sampled_count")
    agreed = states.where("status = 'success'").select("year", "month", F.col("n").alias("told"))
    out = funnel.join(saved, ["year", "month"], "left").join(agreed, ["year", "month"])
    return out.select("year", "month", F.when(F.coalesce("n", F.lit(0)) == F.col("told"), F.coalesce("n", F.lit(0))).alias("n"), "sampled_count")


@query(
    "q_footer_table",
    f"""WITH {V.RAW_SQL}, {MONTHS_SQL}, r AS (SELECT year(pickup_datetime) AS year, month(pickup_datetime) AS month, count(*) AS n,
      count(driver_pay) AS paid, min(driver_pay) AS least_pay, max(trip_time) AS longest FROM raw GROUP BY 1, 2)
    SELECT m.year, m.month, r.year IS NOT NULL AS available, coalesce(n, 0) AS n, paid, least_pay, longest
    FROM months m LEFT JOIN r ON r.year = m.year AND r.month = m.month""",
)
def footer_table(spark, sf):
    """Availability, rows, nulls and extremes of all months from the files' footers alone."""
    table = footers.read_footers(spark, {f"{y}-{m}": path for (y, m), path in _sources(spark, sf).items()})
    column = table.select("path", F.inline("columns"))
    pay = column.where("name = 'driver_pay'").select("path", "nulls", F.col("low").cast("double").alias("least_pay"))
    time = column.where("name = 'trip_time'").select("path", F.col("high").cast("int").alias("longest"))
    each = table.select("part", "path", "rows").join(pay, "path", "left").join(time, "path", "left")
    part = F.split("part", "-")
    return each.groupBy(part[0].cast("int").alias("year"), part[1].cast("int").alias("month")).agg(
        (F.coalesce(F.sum("rows"), F.lit(0)) > 0).alias("available"), F.coalesce(F.sum("rows"), F.lit(0)).alias("n"),
        F.sum(F.col("rows") - F.col("nulls")).alias("paid"), F.min("least_pay").alias("least_pay"), F.max("longest").alias("longest"),
    )


DRIFT_SQL = """CASE WHEN year(pickup_datetime) = 1996 THEN 'tolls' ELSE '' END AS missing,
    CASE WHEN year(pickup_datetime) = 1998 AND month(pickup_datetime) > 6 THEN 'bcf,tips' ELSE '' END AS extra,
    CASE WHEN year(pickup_datetime) = 2000 THEN 'trip_time' ELSE '' END AS retyped"""


@query(
    "q_schema_drift",
    f"""WITH {V.RAW_SQL} SELECT * FROM (SELECT 'year=' || year(pickup_datetime) || '/month=' || month(pickup_datetime) AS part,
    {DRIFT_SQL}, count(*) AS "rows" FROM raw GROUP BY ALL) WHERE missing <> '' OR extra <> '' OR retyped <> ''""",
)
def drift(spark, sf):
    """Month folders whose columns differ, told by their footers."""
    base = lake.scratch_dir(spark, "drift")
    df = _monthly(spark, sf)
    late = (F.col("year") == 1998) & (F.col("month") > 6)
    shapes = [
        (F.col("year") == 1996, df.drop("tolls")),
        (late, df.withColumns({"bcf": F.lit(0.5), "tips": F.lit(1.5)})),
        (F.col("year") == 2000, df.withColumn("trip_time", F.col("trip_time").cast("double"))),
        (~F.col("year").isin(1996, 2000) & ~late, df),
    ]
    for rule, shape in shapes:
        shape.where(rule).write.mode("append").partitionBy("year", "month").parquet(base)
    types = {"int": "int32", "bigint": "int64", "double": "double", "string": "string", "boolean": "bool", "timestamp_ntz": "timestamp[us]"}
    expected = {c: types[t] for c, t in df.dtypes if c not in ("year", "month")}
    return footers.drift(footers.read_footers(spark, base), expected)
