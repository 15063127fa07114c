"""Mergeable monthly state: partial aggregates stored per month, from which reports of any months are made.

A month is aggregated once. What is kept of it adds up: step counts, non-null counts, exact decimal sums, counts of
values by quantile cell, and bitmaps of whole numbers. Reports over years, or over any set of months, read the state and
no trips, and another month costs reading that month.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fareframe.operators import order_stats, profile, quality
from fareframe.operators.order_stats import cell_of
from fareframe.sources.footers import path_exists
from fareframe.sources.lake import write_partitioned
from fareframe.sources.scratch import scratch_dir

MONTH = ("year", "month")
#: Sums are of decimals with so many digits behind the point: exact for money and distances, in any order.
SUM_TYPE = "decimal(38,9)"
TABLES = ("funnel", "coverage", "sums", "values", "cells", "bitmaps")


class MonthState:
    """The stored state below a folder; every frame has ``year`` and ``month``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- adding months

    def add_funnel(self, raw: DataFrame, provider_col: str, code: str, sampled: Column | None = None) -> None:
        """Rows left and removed at each step, of the months in the raw trips."""
        self._put("funnel", quality.removal_funnel(raw, provider_col, code, sampled=sampled))

    def add(self, trips: DataFrame, columns: Sequence[str] = (), groups: dict[str, Sequence[str]] | None = None, whole: Sequence[str] = ()) -> None:
        """The months in the frame replace their state; other months stay.

        ``columns`` are the numeric ones of which sums and quantiles will be asked, ``groups`` those of the coverage
        report, ``whole`` the whole-number ones of which distinct values will be counted. Values are counted per month,
        so a column of few different values takes little room; at worst its counts are as many as its rows.
        """
        if groups:
            self._put("coverage", quality.coverage(trips, groups, by=MONTH).drop("coverage_pct"))
        if columns:
            long = trips.select(*MONTH, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(MONTH), list(columns), "column", "value")
            long = long.where("value is not null and not isnan(value)")
            counts = long.groupBy(*MONTH, "column", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("cell", cell_of(F.col("value")))
            # Counted once and stored; everything about the columns follows from the counts.
            folder = scratch_dir(self.spark, "value-counts")
            counts.write.parquet(folder)
            counts = self.spark.read.schema(counts.schema).parquet(folder)
            self._put("values", counts)
            ends = [F.sum("n").alias("n"), F.min("value").alias("least"), F.max("value").alias("most")]
            self._put("cells", counts.groupBy(*MONTH, "column", "cell").agg(*ends))
            exact = F.col("value").cast(SUM_TYPE)
            total = F.sum((exact * F.col("n").cast("decimal(20,0)")).cast(SUM_TYPE)).alias("total")
            self._put("sums", counts.groupBy(*MONTH, "column").agg(*ends, total))
        if whole:
            self._put("bitmaps", profile.value_bitmaps(trips, whole, by=MONTH))

    def _put(self, table: str, df: DataFrame) -> None:
        write_partitioned(df, f"{self.path}/{table}", MONTH)

    # --- reports over months

    def read(self, table: str, months: Column | str | None = None) -> DataFrame:
        """A table of the state; ``months`` is a condition on year and month, which prunes folders."""
        if not path_exists(self.spark, f"{self.path}/{table}"):
            raise FileNotFoundError(f"no state {table!r} below {self.path}")
        df = self.spark.read.parquet(f"{self.path}/{table}")
        return df if months is None else df.where(months)

    def funnel_by_year(self, months: Column | str | None = None) -> DataFrame:
        return quality.funnel_by_year(self.read("funnel", months))

    def coverage(self, months: Column | str | None = None, by: Sequence[str] = ()) -> DataFrame:
        """Non-null count, total and percentage per listed column over the months."""
        merged = self.read("coverage", months).groupBy(*by, "group", "column").agg(
            F.max("present").alias("present"), F.sum("non_null").alias("non_null"), F.sum("total").alias("total")
        )
        pct = F.when(F.col("total") > 0, F.col("non_null") / F.col("total") * 100).otherwise(F.lit(0.0))
        return merged.withColumn("coverage_pct", pct)

    def basic_stats(self, months: Column | str | None = None, by: Sequence[str] = ()) -> DataFrame:
        """(*by, column, n, total, mean, min, max) with exact sums."""
        merged = self.read("sums", months).groupBy(*by, "column").agg(
            F.sum("n").alias("n"), F.sum("total").cast(SUM_TYPE).alias("total"), F.min("least").alias("min"), F.max("most").alias("max")
        )
        return merged.select(*by, "column", "n", "total", (F.col("total").cast("double") / F.col("n")).alias("mean"), "min", "max")

    def quantiles(self, cols: Sequence[str], ps: Sequence[float], months: Column | str | None = None, by: Sequence[str] = ()) -> DataFrame:
        """(*by, column, p, value): exact quantiles over all rows of the months.

        The cells of the months are added up and tell which cells hold a wanted rank; of the value counts only those
        cells are read further.
        """
        keys, chosen = [*by, "column"], F.col("column").isin(*cols)
        cells = self.read("cells", months).where(chosen).groupBy(*keys, "cell").agg(
            F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")
        )
        ps = sorted({float(p) for p in ps})
        wanted = order_stats.wanted_cells(cells, ps, keys)
        values = self.read("values", months).where(chosen)
        return order_stats.interpolated(order_stats.order_statistics(wanted, values, ps, keys), by)

    def distinct(self, months: Column | str | None = None, by: Sequence[str] = ()) -> DataFrame:
        """(*by, column, n_distinct) of the whole-number columns."""
        return profile.distinct_of_bitmaps(self.read("bitmaps", months), by)
