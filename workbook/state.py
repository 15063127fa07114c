"""Reports from the mergeable monthly state, which is built in two steps and then asked for sets of months."""

from __future__ import annotations

from pyspark.sql import functions as F

from fareframe.operators import quality
from fareframe.plans.state import MonthState
from fareframe.sources import lake
from workbook import views as V
from workbook.quality import FUNNEL_SQL, _pct_sql
from workbook.registry import query, rounded

GROUPS = {"spatial": ["PU_Borough", "trip_cbd_type"], "temporal": ["holiday_name", "rush_hour_label"], "weather": ["fog_flag"]}
#: The months asked for: from April of 1996 to August of 1999.
RANGE = "year * 100 + month BETWEEN 199604 AND 199908"
RANGE_SQL = "pickup_date >= DATE '1996-04-01' AND pickup_date < DATE '1999-09-01'"


def _state(spark, sf, raw=False, **asked):
    """The state of all years but the last two, to which those are then added."""
    state = MonthState(spark, lake.scratch_dir(spark, "state"))
    df = V.raw_trips(spark, sf) if raw else V.labelled_trips(spark, sf)
    df = df.withColumns({"year": F.year("pickup_datetime"), "month": F.month("pickup_datetime")})
    for part in (F.col("year") < 2000, F.col("year") >= 2000):
        if raw:
            state.add_funnel(df.where(part), "provider_code", "N", sampled=F.col("tolls") >= 0.02)
        else:
            state.add(df.where(part), **asked)
    return state


@query(
    "q_state_funnel_by_year",
    f"WITH {FUNNEL_SQL}, y AS (SELECT coalesce(CAST(year AS VARCHAR), 'ALL') AS year, "
    + ", ".join(f"CAST(sum({src}) AS BIGINT) AS {out}" for out, src in quality.FUNNEL_SUMS.items())
    + " FROM monthly GROUP BY ROLLUP (year)) SELECT *, "
    + ", ".join(_pct_sql(n, d, out) for out, (n, d) in quality.FUNNEL_PCTS.items())
    + " FROM y",
)
def funnel(spark, sf):
    return _state(spark, sf, raw=True).funnel_by_year()


@query(
    "q_state_coverage",
    f"WITH {V.LABELLED_SQL}, asked AS (SELECT * FROM labelled WHERE {RANGE_SQL}) "
    + " UNION ALL ".join(
        f"""SELECT '{g}' AS "group", '{c}' AS "column", {0 if c == "fog_flag" else 1} AS present,
        {"0::BIGINT" if c == "fog_flag" else f"count({c})"} AS non_null, count(*) AS total,
        {"0::DOUBLE" if c == "fog_flag" else f"count({c}) / count(*) * 100"} AS coverage_pct FROM asked"""
        for g, cols in GROUPS.items()
        for c in cols
    ),
)
def coverage(spark, sf):
    return _state(spark, sf, groups=GROUPS).coverage(RANGE)


STATS_SQL = """SELECT CAST(year(pickup_date) AS INTEGER) AS year, '{c}' AS "column", count({c}) AS n,
    round(sum(CAST({c} AS DECIMAL(28, 9)))::DOUBLE, 6) AS total, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM trips GROUP BY 1"""


@query("q_state_stats", f"WITH {V.TRIPS_SQL} " + " UNION ALL ".join(STATS_SQL.format(c=c) for c in ("trip_miles", "base_passenger_fare")))
def stats(spark, sf):
    table = _state(spark, sf, columns=["trip_miles", "base_passenger_fare"]).basic_stats(by=["year"])
    return rounded(table.withColumn("total", F.col("total").cast("double")), ["total"]).drop("mean")


@query(
    "q_state_quantiles",
    f"""WITH {V.TRIPS_SQL} SELECT c AS "column", p::DOUBLE AS p, round(v, 9) AS value FROM (
      SELECT 'commission' AS c, unnest([0.01, 0.25, 0.5, 0.99]) AS p, unnest(quantile_cont(commission, [0.01, 0.25, 0.5, 0.99])) AS v FROM trips WHERE {RANGE_SQL}
      UNION ALL SELECT 'trip_miles', unnest([0.01, 0.25, 0.5, 0.99]), unnest(quantile_cont(trip_miles, [0.01, 0.25, 0.5, 0.99])) FROM trips WHERE {RANGE_SQL})""",
)
def quantiles(spark, sf):
    state = _state(spark, sf, columns=["commission", "trip_miles"])
    return rounded(state.quantiles(["commission", "trip_miles"], [0.01, 0.25, 0.5, 0.99], RANGE), ["value"], 9)


@query(
    "q_state_distinct",
    f"""WITH {V.TRIPS_SQL}, y AS (SELECT CAST(year(pickup_date) AS INTEGER) AS year, * FROM trips)
    SELECT year, 'PULocationID' AS "column", count(DISTINCT PULocationID) AS n_distinct FROM y GROUP BY 1
    UNION ALL SELECT year, 'trip_time', count(DISTINCT trip_time) FROM y GROUP BY 1
    UNION ALL SELECT year, 'trip_key', count(DISTINCT trip_key) FROM y GROUP BY 1""",
)
def distinct(spark, sf):
    """Years from bitmaps of months."""
    return _state(spark, sf, whole=["PULocationID", "trip_time", "trip_key"]).distinct(by=["year"])
