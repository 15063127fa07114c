"""Regression pipelines, their metrics and weight tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fareframe.operators import model
from fareframe.operators.calendar import add_calendar
from fareframe.operators.sampling import year_split
from workbook import views as V
from workbook.registry import query, rounded

LOW = ["pickup_day_of_week", "trip_cbd_type", "rush_hour_label", "time_period"]
HIGH = ["PULocationID", "DOLocationID", "PU_Zone", "DO_Zone"]
LAST_TRAIN = 1996
NUMERIC = ["trip_miles", "trip_time", "avg_speed_mph", "pickup_month"]


def _split(spark, sf):
    df = V.labelled_trips(spark, sf).where("commission >= 0").withColumn("year", F.year("pickup_date"))
    return year_split(df, LAST_TRAIN)


def _lasso(spark, sf, bins: int = 256):
    train, test = model.trim_by_train(*_split(spark, sf), "commission")
    train = model.as_text(train, HIGH)
    return model.lasso_pipeline(LOW, HIGH, NUMERIC, hash_bins=bins).fit(train), train, model.as_text(test, HIGH)


def _sound(fitted, train, test, label: str):
    """Test rows scored, and what holds for any sound fit: its error on the training rows is not above the mean's."""
    scores = model.eval_metrics(fitted.transform(test), label)
    own = model.eval_metrics(fitted.transform(train), label).select(F.col("r2") >= 0).scalar()
    return scores.select("n", own.alias("beats_mean"), (F.col("mae") <= F.col("rmse")).alias("ordered"))


TEST_SQL = """hi AS (SELECT quantile_cont({y}, 0.98) AS q FROM t WHERE year(pickup_date) <= 1996),
test AS (SELECT * FROM t, hi WHERE year(pickup_date) > 1996 AND {y} <= q)"""
LASSO_SQL = f"{V.TRIPS_SQL}, t AS (SELECT * FROM trips WHERE commission >= 0), {TEST_SQL.format(y='commission')}"
FOREST_SQL = (
    f"{V.TRIPS_SQL}, t AS (SELECT *, commission / trip_miles AS y_cpm FROM trips WHERE commission >= 0 AND trip_miles > 0.1), "
    + TEST_SQL.format(y="y_cpm")
)


TRAIN_SQL = "train AS (SELECT t.* FROM t, hi WHERE year(pickup_date) <= 1996 AND commission <= q)"


@query(
    "q_lasso",
    f"""WITH {LASSO_SQL}, {TRAIN_SQL} SELECT (SELECT count(*) FROM test) AS n_test, count(*) AS n,
    round(var_pop(commission) / 2, 6) AS null_objective, round(avg(commission), 6) AS mean_prediction,
    true AS optimal, true AS pulls_alike FROM train""",
)
def lasso(spark, sf):
    """The fitted weights are proven optimal; the mean prediction on the training rows is that of the labels."""
    fitted, train, test = _lasso(spark, sf, model.HASH_BINS)
    linear, seen = fitted.stages[-1], fitted.transform(train)
    proof = model.lasso_certificate(linear, seen)
    mean = seen.agg(F.avg("prediction")).scalar()
    out = proof.select(
        test.agg(F.count(F.lit(1))).scalar().alias("n_test"), "n", "null_objective", mean.alias("mean_prediction"),
        F.col("gap").between(-1e-6, 1e-3).alias("optimal"),
        (F.abs(F.col("largest_pull") / linear.getRegParam() - 1) < 0.05).alias("pulls_alike"),
    )
    return rounded(out, ["null_objective", "mean_prediction"])


@query(
    "q_lasso_coefficients",
    f"""WITH {LASSO_SQL}, {TRAIN_SQL} SELECT round(stddev_samp(trip_miles), 6) AS miles_std, round(stddev_samp(trip_time), 6) AS time_std,
    256 + 4 + count(DISTINCT dayofweek(pickup_date)) AS places, true AS unique_names, true AS texts_on_places_only,
    true AS per_unit FROM train""",
)
def coefficients(spark, sf):
    """All weights by name: the deviations of scaled columns are those of SQL, and weights divide by them."""
    fitted, train, _ = _lasso(spark, sf)
    w = model.coefficients(fitted, train, zeros=True)
    on_place = F.col("feature").startswith("loc_hashed_")
    days = F.count_if(F.col("feature").startswith("pickup_day_of_week_oh_"))
    hashed = F.count_if(on_place)
    scaled = F.count_if(F.col("attribute").isNotNull())
    out = w.agg(
        *[F.max(F.when(F.col("attribute") == c, F.col("std"))).alias(a) for c, a in (("trip_miles", "miles_std"), ("trip_time", "time_std"))],
        (hashed + scaled + days).alias("places"),
        (F.count_distinct("feature") == F.count(F.lit(1))).alias("unique_names"),
        F.min(F.col("texts").isNull() | on_place).alias("texts_on_places_only"),
        F.min(F.coalesce(F.abs(F.col("weight_per_unit") * F.col("std") - F.col("weight")) < 1e-9, F.col("attribute").isNull())).alias("per_unit"),
    )
    return rounded(out, ["miles_std", "time_std"])


@query(
    "q_hash_tokens",
    f"""WITH {LASSO_SQL}, {V.ZONES_SQL}, {TRAIN_SQL},
    named AS (SELECT PULocationID::VARCHAR AS a, DOLocationID::VARCHAR AS b, p.Zone AS c, d.Zone AS d
      FROM train LEFT JOIN zones p ON PULocationID = p.LocationID LEFT JOIN zones d ON DOLocationID = d.LocationID)
    SELECT DISTINCT 'PULocationID_str' AS "column", a AS text FROM named WHERE a IS NOT NULL
    UNION SELECT 'DOLocationID_str', b FROM named WHERE b IS NOT NULL
    UNION SELECT 'PU_Zone_str', c FROM named WHERE c IS NOT NULL UNION SELECT 'DO_Zone_str', d FROM named WHERE d IS NOT NULL""",
)
def tokens(spark, sf):
    fitted, train, _ = _lasso(spark, sf, bins=64)
    return model.hashed_texts(fitted, train).select("column", "text")


def _forest(spark, sf):
    train, test = (d.where("y_cpm is not null") for d in _split(spark, sf))
    train, test = model.trim_by_train(train, test, "y_cpm")
    train = train.drop("trip_key", "trip_part", "provider_code", "holiday_name")
    cols = model.forest_columns(train)
    return model.forest_pipeline(**cols, trees=20, depth=6, bins=64).fit(train), train, test


@query("q_random_forest", f"WITH {FOREST_SQL} SELECT count(*) AS n, true AS beats_mean, true AS ordered FROM test")
def forest(spark, sf):
    fitted, train, test = _forest(spark, sf)
    return _sound(fitted, train, test, "y_cpm")


@query("q_forest_importances", "SELECT 1.0::DOUBLE AS total, true AS all_positive, true AS unique_names")
def importances(spark, sf):
    fitted, train, _ = _forest(spark, sf)
    return model.importances(fitted, train).agg(
        F.round(F.sum("importance"), 6).alias("total"),
        F.min(F.col("importance") > 0).alias("all_positive"),
        (F.count_distinct("feature") == F.count(F.lit(1))).alias("unique_names"),
    )


@query(
    "q_eval_metrics",
    f"""WITH {V.TRIPS_SQL}, e AS (SELECT commission AS y, commission - base_passenger_fare * 0.2::DOUBLE AS d FROM trips)
    SELECT round(sqrt(sum(d * d) / count(*)), 6) AS rmse, round(sum(abs(d)) / count(*), 6) AS mae,
    round(1 - sum(d * d) / (var_pop(y) * count(*)), 6) AS r2, count(*) AS n FROM e""",
)
def metrics(spark, sf):
    df = V.trips(spark, sf).withColumn("prediction", F.col("base_passenger_fare") * 0.2)
    return rounded(model.eval_metrics(df, "commission"), ["rmse", "mae", "r2"])


@query(
    "q_trim_by_train",
    f"""WITH {V.TRIPS_SQL}, q AS (SELECT quantile_cont(commission, 0.98) AS hi FROM trips WHERE year(pickup_date) <= 1996)
    SELECT CAST(year(pickup_date) AS INTEGER) AS year, count(*) AS n, round(avg(commission), 6) AS mean FROM trips, q
    WHERE commission <= hi GROUP BY 1""",
)
def trim(spark, sf):
    train, test = year_split(V.trips(spark, sf).withColumn("year", F.year("pickup_date")), LAST_TRAIN)
    train, test = model.trim_by_train(train, test, "commission")
    out = train.unionByName(test).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.avg("commission").alias("mean"))
    return rounded(out, ["mean"])


@query(
    "q_group_weights",
    f"""WITH {V.TRIPS_SQL}, {V.ZONES_SQL}, w AS (
      SELECT PULocationID AS LocationID, round(avg(commission), 6) AS weight FROM trips GROUP BY 1)
    SELECT CASE WHEN service_zone = 'Airports' THEN 'airport' WHEN Borough IS NULL THEN 'other' ELSE Borough END AS theme,
    round(sum(weight), 6) AS weight_sum, count(*) AS n FROM w LEFT JOIN (SELECT * FROM zones WHERE Zone <> 'NATION_7')
    USING (LocationID) GROUP BY 1""",
)
def group_weights(spark, sf):
    weights = V.trips(spark, sf).groupBy(F.col("PULocationID").alias("LocationID")).agg(
        F.round(F.avg("commission"), 6).alias("weight")
    )
    themes = V.zones(spark, sf).where("Zone <> 'NATION_7'").select(
        "LocationID", F.when(F.col("service_zone") == "Airports", "airport").otherwise(F.col("Borough")).alias("theme")
    )
    return rounded(model.group_weights(weights, themes, "LocationID", "theme", "weight"), ["weight_sum"])


@query("q_model_round_trip", f"WITH {LASSO_SQL} SELECT count(*) AS n, 0::BIGINT AS different FROM test")
def round_trip(spark, sf):
    """Predictions of a saved and reloaded pipeline against those of the original."""
    from fareframe.sources.lake import load_model, save_model, scratch_dir

    fitted, _, test = _lasso(spark, sf, bins=64)
    path = scratch_dir(spark, "model")
    save_model(fitted, path)
    first = fitted.transform(test).select("*", F.col("prediction").alias("first"))
    own = [c for c in first.columns if c in test.columns] + ["first"]
    both = load_model(path).transform(first.select(*own))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("first") != F.col("prediction")).alias("different"))


@query("q_numeric_features", "SELECT unnest(['trip_miles', 'trip_time', 'driver_efficiency']) AS feature, count(*) > 0 AS has_rows FROM orders GROUP BY 1")
def numeric(spark, sf):
    from fareframe.operators.features import numeric_features

    df = add_calendar(V.trips(spark, sf)).select("trip_miles", "trip_time", "driver_efficiency", "commission", "pickup_date")
    names = numeric_features(df, exclude=["commission"])
    return df.agg(*[(F.count(n) > 0).alias(n) for n in names]).unpivot([], names, "feature", "has_rows")
