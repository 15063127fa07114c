"""Broadcast only what is known to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BYTES = 32 * 1024 * 1024
MAX_ROWS = 1_000_000


def planned_bytes(df: DataFrame, optimized: bool = True) -> int | None:
    """Catalyst's size estimate for the frame, or None where it has none that can be trusted.

    Estimates do not see how many rows an explode adds, so plans with one have none.
    """
    try:
        plans = df._jdf.queryExecution()
        plan = plans.optimizedPlan() if optimized else plans.analyzed()
        if "Generate " in plan.toString():
            return None
        return int(plan.stats().sizeInBytes().longValue())
    except AttributeError:  # no JVM handle, e.g. a remote session
        return None


def measured(df: DataFrame, max_rows: int = MAX_ROWS) -> tuple[int, int]:
    """Action: rows and approximate bytes of the frame, looking at ``max_rows`` + 1 rows at most."""
    width = F.coalesce(F.octet_length(F.to_json(F.struct("*"))), F.lit(16))
    row = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return row[0], row[1] or 0


def is_small(df: DataFrame, max_bytes: int = MAX_BYTES, max_rows: int = MAX_ROWS) -> bool:
    """True when Catalyst's estimate fits, else when the frame's own rows and their measured bytes fit.

    The estimate of the plain plan comes first, as it costs nothing; then that of the optimized
    plan. The measurement is a job on the dimension side only and runs only for frames whose estimates
    are loose, such as an aggregate over a large table.
    """
    for optimized in (False, True):
        size = planned_bytes(df, optimized)
        if size is not None and size <= max_bytes:
            return True
    rows, size = measured(df, max_rows)
    return rows <= max_rows and size <= max_bytes


def small_side(df: DataFrame, max_bytes: int = MAX_BYTES, max_rows: int = MAX_ROWS) -> DataFrame:
    """Broadcast hint when the frame is checked small; otherwise the plain frame.

    Without the hint the equi join stays a sort-merge join, whose hot keys AQE splits.
    """
    return F.broadcast(df) if is_small(df, max_bytes, max_rows) else df
