"""Window functions over one long series: blocks in order, each with the border rows of its neighbours."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block, and ranges that the series is first cut into.
BLOCK = 100_000
RANGES = 200


def range_bounds(df: DataFrame, order: str, ranges: int = RANGES) -> list[float]:
    """Action: values that cut a numeric, date or time column into ranges of about equal size; ``ranges`` at most.

    They need not be exact: they decide where rows are counted, never a result.
    """
    key = _number(df, order)
    cuts = df.select(key.alias("k")).where("not isnan(k)").agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], 10_000)).first()[0]
    return sorted(set(cuts or []))


def _number(df: DataFrame, order: str):
    kind = df.schema[order].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(order).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.col(order).cast("timestamp").cast("double")
    if isinstance(kind, (T.TimestampType, T.NumericType)):
        return F.col(order).cast("double")
    raise ValueError(f"a series is ordered by a number, date or time, not by {kind.simpleString()}")


def placed(df: DataFrame, order: str, bounds: Sequence[float]) -> DataFrame:
    """Adds ``_at``, the row's place in the whole series from 0, with null keys first.

    Rows are numbered within ranges, and ranges by the counts of those before them: one row per range, broadcast. Rows
    of equal keys share a range and stand in any order.
    """
    key = _number(df, order)
    range_ = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<double>"), lambda b: b <= key))
    ranged = df.withColumn("_range", F.when(key.isNull(), F.lit(0)).otherwise(range_))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")  # over RANGES rows at most
    starts = counts.select("_range", before.alias("_start"))
    number = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return ranged.withColumn("_number", number).join(F.broadcast(starts), "_range").withColumn("_at", F.col("_start") + F.col("_number")).drop("_range", "_number", "_start")


def in_blocks(
    df: DataFrame, order: str, back: int, ahead: int, window: Callable[[DataFrame, Sequence[str], str], DataFrame], block: int = BLOCK
) -> DataFrame:
    """``window(rows, group, by)`` over the whole series, with windows that reach ``back`` and ``ahead`` rows at most.

    The series is cut into blocks of equal length in order. A row within reach of the next or the last block is sent
    there too, so each block holds all rows that its own rows' windows reach, and blocks are worked on side by side. The
    copies go afterwards. Finding where to cut is a job of its own, over the order column alone.
    """
    size = max(block, back, ahead, 1)
    rows = placed(df, order, range_bounds(df, order))
    own, inside = F.floor(F.col("_at") / size), F.col("_at") % size
    to = F.array_compact(F.array(own, F.when(inside >= size - back, own + 1), F.when((inside < ahead) & (own > 0), own - 1)))
    spread = rows.withColumn("_own", own).withColumn("_block", F.explode(to))
    return window(spread, ["_block"], "_at").where(F.col("_block") == F.col("_own")).drop("_at", "_own", "_block")
