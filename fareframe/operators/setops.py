"""Unions, overlaps, key hygiene and schema drift."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def union_years(*frames: DataFrame) -> DataFrame:
    """Union by name; columns missing on one side become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_strict(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name; both sides must have the same columns."""
    return a.unionByName(b)


def common_values(a: DataFrame, a_col: str, b: DataFrame, b_col: str) -> DataFrame:
    """Distinct values present on both sides."""
    return a.select(F.col(a_col).alias(a_col)).intersect(b.select(F.col(b_col).alias(a_col)))


def date_overlap(a: DataFrame, a_col: str, b: DataFrame, b_col: str) -> DataFrame:
    """One row: distinct dates on each side and in common."""
    sides = a.select(F.col(a_col).alias("d"), F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(
        b.select(F.col(b_col).alias("d"), F.lit(0).alias("in_a"), F.lit(1).alias("in_b"))
    )
    per_date = (
        sides.where(F.col("d").isNotNull())
        .groupBy("d")
        .agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    )
    return per_date.agg(
        F.count_if(F.col("in_a") == 1).alias("left_dates"),
        F.count_if(F.col("in_b") == 1).alias("right_dates"),
        F.count_if((F.col("in_a") == 1) & (F.col("in_b") == 1)).alias("common_dates"),
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Per key, each column's first non-null value in ``order``.

    An aggregation rather than a window, so a hot key is combined before the shuffle.
    """
    sort = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), sort)).alias(c) for c in others]
    )


def dedupe_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One whole row per key: the first in ``order``. Combined before the shuffle, like above."""
    sort = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    others = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*others), sort).alias("row"))
    return picked.select(*keys, "row.*").select(*df.columns)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fails at run time on a repeated key, so that a join cannot fan rows out.

    Aggregates to one row per key; meant for dimensions. A key with a null can't match in a join, so repeats of one are
    no fault; one row of them stays.
    """
    others = [c for c in df.columns if c not in keys]
    message = F.concat_ws("=", F.lit("repeated key " + ",".join(keys)), *[F.col(k).cast("string") for k in keys])
    grouped = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.first(F.struct(F.lit(0).alias("_"), *others)).alias("_row")
    )
    matches = F.lit(True)
    for k in keys:
        matches = matches & F.col(k).isNotNull()
    # The check sits inside every kept column, so that column pruning cannot remove it.
    checked = {
        c: F.when((F.col("_n") > 1) & matches, F.raise_error(message).cast(df.schema[c].dataType)).otherwise(F.col("_row")[c])
        for c in others
    }
    return grouped.select(*keys, *[col.alias(c) for c, col in checked.items()]).select(*df.columns)


def schema_drift(spark: SparkSession, schemas: dict[str, Sequence[str]], expected: Sequence[str]) -> DataFrame:
    """Missing and extra columns per named part; consistent parts are absent."""
    rows = []
    for part, cols in sorted(schemas.items()):
        missing, extra = sorted(set(expected) - set(cols)), sorted(set(cols) - set(expected))
        if missing or extra:
            rows.append((part, ",".join(missing), ",".join(extra)))
    return spark.createDataFrame(rows, "part string, missing string, extra string")
