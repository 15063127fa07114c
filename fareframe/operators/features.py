"""Feature pruning, correlation screening and leak-free selection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareframe.functions.weather import fog_flag
from fareframe.schemas import FARE_METRIC_COLUMNS, FEE_COLUMNS, ID_COLUMNS, NUMERIC_TYPES, numeric_columns

# Columns dropped as redundant before the mart is written.
REDUNDANT = {
    "weather": (
        "tmax_c", "tmin_c", "temp_range_c",
        "is_very_cold", "is_cold", "is_cool", "is_mild", "is_warm", "is_extreme_heat",
        "is_light_rain", "is_moderate_rain", "is_heavy_rain", "is_extreme_rain", "is_precipitation",
        "is_light_snow", "is_heavy_snow", "snow_cm", "snow_depth_cm",
        "is_windy", "is_very_windy", "high_winds",
        "fog_mist", "heavy_fog", "ice_pellets", "hail", "glaze_rime", "smoke_haze",
        "ingest_ts",
    ),
    "spatial": ("PU_in_cbd", "DO_in_cbd"),
    "temporal": ("is_rush_hour",),
    "raw_flags": ("shared_request_flag", "access_a_ride_flag", "wav_request_flag", "wav_match_flag"),
}
# Columns removed before modelling.
SCREENED = (
    "hvfhs_license_num", "dispatching_base_num", "originating_base_num",
    "pickup_datetime", "dropoff_datetime", "request_datetime",
    "shared_request_flag", "shared_match_flag", "access_a_ride_flag", "wav_request_flag",
    "tolls", "bcf", "sales_tax", "congestion_surcharge", "airport_fee", "tips",
    "trip_duration_minutes", "avg_speed_mph", "revenue_per_mile", "revenue_per_minute",
)
COMMONLY_REDUNDANT = ("trip_duration_minutes", "avg_speed_mph", *FARE_METRIC_COLUMNS)
EARLY_DROPS = (*ID_COLUMNS, *FEE_COLUMNS, *FARE_METRIC_COLUMNS)
# Neighbouring tasks whose moments are merged at a time.
FAN_IN = 256
# Squared relative spread below which a column counts as constant.
CONSTANT = 1e-24


def label_pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: distinct combinations of two labels and distinct values of each, from one scan.

    The scan reduces to the distinct combinations before the three counts.
    """
    # A plain distinct lets Catalyst drop left joins that do not feed the two labels.
    pairs = df.select(a, b).distinct()
    # A null label is a value of its own, as it is for DISTINCT.
    left = F.count_distinct(F.struct(a))
    right = F.count_distinct(F.struct(b))
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), left.alias("left_values"), right.alias("right_values"))


def is_redundant_label(df: DataFrame, a: str, b: str) -> bool:
    """Action: True when the pair has no more combinations than the richer label alone."""
    row = label_pair_counts(df, a, b).first()
    return row["pairs"] <= max(row["left_values"], row["right_values"])


def drop_redundant(df: DataFrame, groups: Sequence[str] = tuple(REDUNDANT)) -> DataFrame:
    """Derive ``fog_flag`` from its parts and drop the redundant columns that are present."""
    parts = [F.col(c) for c in ("fog_mist", "heavy_fog") if c in df.columns]
    if parts:
        df = df.withColumn("fog_flag", fog_flag(*parts))
    return df.drop(*[c for g in groups for c in REDUNDANT[g]])


def prune_features(df: DataFrame, labels: Sequence[str] = ()) -> DataFrame:
    """``drop_redundant``, and the labels that the caller has found redundant for the whole lake.

    Nothing depends on the rows at hand, so all months of a lake get one schema. ``is_redundant_label`` over all of
    them tells whether ``time_period`` can go.
    """
    return drop_redundant(df).drop(*labels)


def screen_features(df: DataFrame, names: Sequence[str] = SCREENED) -> DataFrame:
    return df.drop(*names)


def numeric_features(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """Numeric columns minus labels, leaks and keys."""
    return [c for c, t in df.dtypes if t in NUMERIC_TYPES and c not in set(exclude)]


def _moments(x: np.ndarray) -> dict[str, np.ndarray]:
    """Pairwise counts, means and centred moments of a block; entry (i, j) uses rows with both values."""
    present = ~np.isnan(x)
    start = x[present.argmax(axis=0), np.arange(x.shape[1])]
    start = np.where(np.isnan(start), 0.0, start)
    # Shifting by a value of the column itself keeps a constant column exactly at zero.
    z, m = np.where(present, x - start, 0.0), present.astype(float)
    n = m.T @ m
    total, some = z.T @ m, np.maximum(n, 1.0)
    return {
        "n": n,
        "mean": start[:, None] + total / some,
        "var": (z * z).T @ m - total * total / some,
        "cov": z.T @ z - total * total.T / some,
    }


def _merged(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    n = a["n"] + b["n"]
    some = np.maximum(n, 1.0)
    gap = np.where((a["n"] > 0) & (b["n"] > 0), b["mean"] - a["mean"], 0.0)
    weight = a["n"] * b["n"] / some
    return {
        "n": n,
        "mean": (a["mean"] * a["n"] + b["mean"] * b["n"]) / some,
        "var": a["var"] + b["var"] + gap * gap * weight,
        "cov": a["cov"] + b["cov"] + gap * gap.T * weight,
    }


def merge_moments(parts: DataFrame) -> DataFrame:
    """Moments (a, b, n, ma, mb, va, vb, c) of each pair from those of its tasks.

    Up to ``FAN_IN`` neighbouring tasks are merged at a time, then those results again, so that no group holds many rows
    however many tasks there were. Means are merged by their gap, without the cancellation of plain sums of squares.
    """
    names = ["n", "ma", "mb", "va", "vb", "c"]

    def both(x: Column, y: Column) -> Column:
        n = x["n"] + y["n"]
        ga, gb, share = y["ma"] - x["ma"], y["mb"] - x["mb"], y["n"] / n
        weight = x["n"] * share
        merged = [n, x["ma"] + ga * share, x["mb"] + gb * share, x["va"] + y["va"] + ga * ga * weight, x["vb"] + y["vb"] + gb * gb * weight, x["c"] + y["c"] + ga * gb * weight]
        return F.struct(*[m.alias(k) for m, k in zip(merged, names, strict=True)])

    for keys in (["a", "b", F.floor(F.col("task") / FAN_IN).alias("task")], ["a", "b"]):
        listed = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("task", *names))).alias("of"))
        rest = F.transform(F.slice("of", 2, FAN_IN * FAN_IN), lambda x: F.struct(*[x[k].alias(k) for k in names]))
        first = F.struct(*[F.col("of")[0][k].alias(k) for k in names])
        parts = listed.withColumn("of", F.aggregate(rest, first, both)).select(*[c for c in listed.columns if c != "of"], "of.*")
    return parts


def correlations(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair over all rows, as ``(a, b, r)``.

    A pair uses the rows where both are present; a constant column gives null. Each task reduces
    its Arrow batches to one moment matrix, so any number of columns takes one scan and shuffles
    one row per pair and task, which are merged in a tree. Built-in aggregates would keep three buffers per pair and row.
    """
    names = list(cols or numeric_columns(df))
    if len(names) < 2:
        raise ValueError("need at least two numeric columns")
    rows, others = np.triu_indices(len(names), 1)

    def reduce_task(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                block = _moments(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
                total = block if total is None else _merged(total, block)
        if total is not None:
            fields = {
                "a": [names[i] for i in rows],
                "b": [names[j] for j in others],
                "task": [TaskContext.get().partitionId()] * len(rows),
                "n": total["n"][rows, others],
                "ma": total["mean"][rows, others],
                "mb": total["mean"][others, rows],
                "va": total["var"][rows, others],
                "vb": total["var"][others, rows],
                "c": total["cov"][rows, others],
            }
            yield pa.RecordBatch.from_pydict(fields)

    parts = df.select([F.col(c).cast("double").alias(c) for c in names]).mapInArrow(
        reduce_task, "a string, b string, task long, n double, ma double, mb double, va double, vb double, c double"
    )
    sums = merge_moments(parts.where("n > 0"))
    # A spread at rounding level is that of a constant column.
    varies = (F.col("va") > F.col("n") * F.col("ma") * F.col("ma") * CONSTANT) & (F.col("vb") > F.col("n") * F.col("mb") * F.col("mb") * CONSTANT)
    return sums.select("a", "b", F.when(varies, F.col("c") / F.sqrt(F.col("va") * F.col("vb"))).alias("r"))


def correlation_pairs(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.9) -> DataFrame:
    """Pairs with ``|r| >= threshold``, strongest first."""
    strong = correlations(df, cols).where(F.abs("r") >= threshold)
    return strong.orderBy(F.desc(F.abs("r")), "a", "b")


def suggest_removals(pairs: DataFrame) -> DataFrame:
    """(a, b, r, remove): which column of each correlated pair to drop.

    Derived revenue ratios go first, else the second column.
    """
    a, b = F.col("a"), F.col("b")
    remove = (
        F.when(b.contains("revenue_per"), b)
        .when(a.contains("revenue_per"), a)
        .otherwise(b)
    )
    return pairs.withColumn("remove", remove)


def removal_set(df: DataFrame, threshold: float = 0.8, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct suggested columns from correlations plus the commonly redundant ones present."""
    found = suggest_removals(correlation_pairs(df, cols, threshold)).select(F.col("remove").alias("column"))
    known = [(c,) for c in COMMONLY_REDUNDANT if c in df.columns]
    if known:
        found = found.unionByName(df.sparkSession.createDataFrame(known, "column string"))
    return found.distinct()
