"""Exact quantiles, cumulative distributions and histograms over a whole table.

``percentile`` would gather every distinct value in one task, and a merged sketch meets in one task too. Here one pass
counts rows in cells of about equal relative width. The few cells that hold a wanted rank are read in a second pass;
their distinct values are counted, cut finer once more, and only then ordered. All counts combine before they are
shuffled, no rank can be missed, and no task orders more than a cell's share of a cell.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fareframe.functions.numbers import equal_width_bin
from fareframe.operators.sizing import small_side
from fareframe.sources.scratch import scratch_dir

# Cells per unit of the natural logarithm, the magnitude below which cells are of equal width, and the parts of a cell.
CELLS = 512
LEAST = 1e-6
PARTS = 65_536


def cell_of(value: Column) -> Column:
    """Number of the value's cell: never falls as the value rises, and bounded whatever the values."""
    size = F.least(F.log1p(F.abs(value) / F.lit(LEAST)), F.lit(1e4))
    return (F.signum(value) * F.floor(size * CELLS)).cast("long")


def _long(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, value) rows of the numeric columns, without nulls and NaN."""
    numeric = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    if len(cols) == 1:
        long = numeric.select(*by, F.lit(cols[0]).alias("column"), F.col(cols[0]).alias("value"))
    else:
        long = numeric.unpivot(list(by), list(cols), "column", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def _rank(p: float, total: Column) -> Column:
    return F.lit(float(p)) * (total - 1)


def _same(keys: Sequence[str]) -> Column:
    """Null-safe equality of the group keys of two frames, those of the second with a leading underscore."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return out


def _checked(ps: Sequence[float]) -> list[float]:
    ps = sorted({float(p) for p in ps})
    if not ps or ps[0] < 0 or ps[-1] > 1:
        raise ValueError("quantile probabilities must lie in [0, 1]")
    return ps


def wanted_cells(cells: DataFrame, ps: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """The cells that hold an order statistic of a quantile, with the rows ``before`` them and the ``total``.

    ``cells`` has (keys, cell, n, least, most), one row per group and cell; their number is bounded by CELLS.
    """
    group = Window.partitionBy(*keys)
    cells = cells.withColumns({"before": F.sum("n").over(group.orderBy("cell")) - F.col("n"), "total": F.sum("n").over(group)})
    wanted = F.lit(False)
    for p in ps:
        for r in (F.floor(_rank(p, F.col("total"))), F.ceil(_rank(p, F.col("total")))):
            wanted = wanted | ((F.col("before") <= r) & (r < F.col("before") + F.col("n")))
    return cells.where(wanted)


def order_statistics(wanted: DataFrame, values: DataFrame, ps: Sequence[float], keys: Sequence[str], hint=lambda df: df) -> DataFrame:
    """(keys, p, low, high, part) from the wanted cells and the values (keys, cell, value, n) of at least those cells.

    A value may come in several rows. Only the rows of cells with more than one value are looked up; ``hint`` may
    broadcast the cells.
    """
    open_ = wanted.where("least < most").select(*[F.col(k).alias(f"_{k}") for k in [*keys, "cell"]], "least", "most", "before", "total")
    inside = values.join(hint(open_), _same(keys) & (F.col("cell") == F.col("_cell")))
    part = F.floor((F.col("value") - F.col("least")) / (F.col("most") - F.col("least")) * PARTS).cast("long")
    counts = inside.groupBy(*keys, "cell", "before", "total", part.alias("sub"), "value").agg(F.sum("n").alias("n"))
    subs = counts.groupBy(*keys, "cell", "before", "sub").agg(F.sum("n").alias("n"))
    run = Window.partitionBy(*keys, "cell").orderBy("sub")
    subs = subs.select(
        *[F.col(k).alias(f"_{k}") for k in [*keys, "cell", "sub"]], (F.col("before") + F.sum("n").over(run) - F.col("n")).alias("start")
    )
    fine = counts.join(subs, _same(keys) & (F.col("cell") == F.col("_cell")) & (F.col("sub") == F.col("_sub")))
    run = Window.partitionBy(*keys, "cell", "sub").orderBy("value")
    fine = fine.select(*keys, "value", "total", (F.col("start") + F.sum("n").over(run) - F.col("n")).alias("first"), "n")
    whole = wanted.where("least = most").select(*keys, F.col("least").alias("value"), "total", F.col("before").alias("first"), "n")
    first, last = F.col("first"), F.col("first") + F.col("n") - 1

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank <= last), F.col("value")))

    picked = fine.unionByName(whole).groupBy(*keys).agg(
        *[at(F.floor(_rank(p, F.col("total")))).alias(f"a{i}") for i, p in enumerate(ps)],
        *[at(F.ceil(_rank(p, F.col("total")))).alias(f"b{i}") for i, p in enumerate(ps)],
        F.max("total").alias("total"),
    )

    def around(i: int, p: float) -> Column:
        rank = _rank(p, F.col("total"))
        return F.struct(
            F.lit(p).alias("p"), F.col(f"a{i}").alias("low"), F.col(f"b{i}").alias("high"), (rank - F.floor(rank)).alias("part")
        )

    return picked.select(*keys, F.inline(F.array(*[around(i, p) for i, p in enumerate(ps)])))


def neighbours(df: DataFrame, cols: Sequence[str], ps: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """The two order statistics around each quantile: ``(*by, column, p, low, high, part)``.

    The quantile is ``low + (high - low) * part``, within each group of the ``by`` columns. A group and column without
    values gives no rows. With groups, the wanted cells are found by a job at once and stored: there are at most two per
    group, column and quantile, their size in bytes is then known, and while it fits they are broadcast, so that no row
    of ``df`` is shuffled in the second pass.
    """
    ps, keys = _checked(ps), [*by, "column"]
    long = _long(df, cols, by).withColumn("cell", cell_of(F.col("value")))
    cells = long.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    wanted = wanted_cells(cells, ps, keys)
    if by:
        folder = scratch_dir(df.sparkSession, "quantile-cells")
        wanted.write.parquet(folder)
        wanted = df.sparkSession.read.schema(wanted.schema).parquet(folder)
    values = long.withColumn("n", F.lit(1).cast("long"))
    return order_statistics(wanted, values, ps, keys, hint=small_side if by else F.broadcast)


def quantiles(df: DataFrame, cols: Sequence[str] | str, ps: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation, as rows ``(*by, column, p, value)``.

    Null values are ignored. A group and column without values gives no rows.
    """
    found = neighbours(df, [cols] if isinstance(cols, str) else list(cols), ps, by)
    return interpolated(found, by)


def interpolated(found: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    between = F.col("low") + (F.col("high") - F.col("low")) * F.col("part")
    return found.select(*by, "column", "p", between.alias("value"))


def quantile_values(df: DataFrame, col: str, ps: Sequence[float]) -> dict[float, float]:
    """Action: the same quantiles as a dict, for use as literals. Empty when there are no values."""
    return {r["p"]: r["value"] for r in quantiles(df, col, ps).collect()}


def quantile_struct(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> Column:
    """Several quantiles, ``name -> (column, p)``, as one scalar subquery ``struct(name, ...)``.

    Null fields stand for columns without values.
    """
    rows = quantiles(df, sorted({c for c, _ in wanted.values()}), [p for _, p in wanted.values()])
    fields = [
        F.max(F.when((F.col("column") == c) & (F.col("p") == float(p)), F.col("value"))).alias(name)
        for name, (c, p) in wanted.items()
    ]
    return rows.agg(F.struct(*fields).alias("found")).scalar()


def quantile_scalar(df: DataFrame, col: str, p: float) -> Column:
    """Exact quantile as a lazy scalar subquery; null when there are no values."""
    return quantiles(df, col, [p]).select("value").scalar()


def quantile_pair(df: DataFrame, col: str, lo: float, hi: float) -> Column:
    """Scalar subquery ``struct(lo, hi)``."""
    return quantile_struct(df, {"lo": (col, lo), "hi": (col, hi)})


def ecdf(df: DataFrame, col: str) -> DataFrame:
    """Distinct values with ``n``, cumulative ``upto`` and cumulative share ``y``.

    The running sum starts anew in each part of each cell (see ``cell_of``), so no task holds the whole domain. What
    comes before a part is summed over the parts of its cell, and what comes before a cell over the cells.
    """
    counts = _long(df, [col]).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("cell", cell_of(F.col("value")))
    cells = counts.groupBy("cell").agg(F.sum("n").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    # One row per cell, bounded by CELLS.
    order = Window.orderBy("cell")
    cells = cells.select(
        "cell", "least", "most", (F.sum("n").over(order) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total")
    )
    width = F.col("most") - F.col("least")
    sub = F.when(width > 0, F.floor((F.col("value") - F.col("least")) / width * PARTS)).otherwise(F.lit(0)).cast("long")
    placed = counts.join(cells, "cell").withColumn("sub", sub)
    parts = placed.groupBy("cell", "sub").agg(F.sum("n").alias("part_n"))
    earlier = F.sum("part_n").over(Window.partitionBy("cell").orderBy("sub")) - F.col("part_n")
    parts = parts.select("cell", "sub", earlier.alias("within"))
    run = Window.partitionBy("cell", "sub").orderBy("value")
    return (
        placed.join(parts, ["cell", "sub"])
        .withColumn("upto", F.col("before") + F.col("within") + F.sum("n").over(run))
        .select("value", "n", "upto", (F.col("upto") / F.col("total")).alias("y"))
    )


def with_range(df: DataFrame, col: str, out: str = "_range") -> DataFrame:
    """Adds the column's extremes ``struct(lo, hi)`` to every row, from one scalar subquery."""
    value = F.col(col).cast("double")
    ends = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("range")).scalar()
    return df.withColumn(out, ends)


def _binned(df: DataFrame, value: Column, lo: Column, hi: Column, bins: int) -> DataFrame:
    """Row counts per bin with the range they share."""
    placed = df.select(equal_width_bin(value, lo, hi, bins).alias("bin"), lo.alias("lo"), hi.alias("hi"))
    counts = placed.where(F.col("bin").isNotNull()).groupBy("bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("width", (F.col("hi") - F.col("lo")) / bins)


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width counts over the column's range; empty bins are absent."""
    value = F.col(col).cast("double")
    counts = _binned(with_range(df, col), value, F.col("_range.lo"), F.col("_range.hi"), bins)
    return counts.select(
        "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_lo"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_hi"),
        "n",
    )


def log_tail_histogram(df: DataFrame, col: str, p: float = 0.95, bins: int = 59, floor: float = 1e-2) -> DataFrame:
    """Counts of the tail ``>= p`` quantile in bins of equal width on the log10 axis."""
    # The whole column's maximum is the tail's maximum.
    values = df.select(F.col(col).cast("double").alias("value"))
    tail = values.withColumn("ends", quantile_pair(values, "value", p, 1.0)).select(
        "value", F.greatest(F.col("ends.lo"), F.lit(floor)).alias("start"), F.col("ends.hi").alias("most")
    )
    tail = tail.where(F.col("value") >= F.col("start"))
    counts = _binned(tail, F.log10("value"), F.log10("start"), F.log10("most"), bins)
    return counts.select(
        "bin",
        F.pow(F.lit(10.0), F.col("lo") + F.col("bin") * F.col("width")).alias("bin_lo"),
        F.pow(F.lit(10.0), F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_hi"),
        "n",
    )


def equal_width_cut(df: DataFrame, col: str, labels: Sequence[str], out: str) -> DataFrame:
    """Label of the equal-width interval each value falls in, over the column's own range.

    Intervals are right-closed; the lowest one also holds the minimum.
    """
    lo, hi = F.col("_range.lo"), F.col("_range.hi")
    bins = len(labels)
    position = F.ceil((F.col(col) - lo) / (hi - lo) * bins)
    number = F.when(hi > lo, F.greatest(F.least(position, F.lit(bins)), F.lit(1))).otherwise(
        F.lit((bins + 1) // 2)
    )
    names = F.array(*[F.lit(x) for x in labels])
    label = F.when(F.col(col).isNotNull(), F.element_at(names, number.cast("int")))
    return with_range(df, col).withColumn(out, label).drop("_range")


def capped_bins(
    df: DataFrame, col: str, cap_p: float = 0.95, outlier_p: float = 0.99, ps: Sequence[float] = (0, 0.2, 0.4, 0.6, 0.8, 1)
) -> DataFrame:
    """Percentile bins of a positive column after capping at ``cap_p``.

    Adds ``capped``, 1-based ``bin`` and ``is_outlier`` (above ``outlier_p``). Equal bin edges
    merge; the outer edges are padded by 0.01, or by 0.1 when all capped values are equal.
    """
    valid = df.where(F.col(col) > 0)
    found = neighbours(valid, [col], [*ps, cap_p, outlier_p])
    low, high, part = F.col("low"), F.col("high"), F.col("part")
    exact = low + (high - low) * part

    def only(p: float) -> Column:
        return F.max(F.when(F.col("p") == float(p), exact))

    limits = found.agg(
        only(cap_p).alias("cap"),
        only(outlier_p).alias("far"),
        F.collect_list(F.when(F.col("p").isin([float(p) for p in ps]), F.struct("low", "high", "part"))).alias("around"),
    )

    def capped_quantile(o: Column) -> Column:
        # Capping each order statistic gives the quantiles of the capped column without another pass.
        under, over = F.least(o["low"], F.col("cap")), F.least(o["high"], F.col("cap"))
        return under + (over - under) * o["part"]

    edges = limits.select(
        "cap", "far", F.sort_array(F.array_distinct(F.transform("around", capped_quantile))).alias("edges")
    )
    one, last = F.col("edges")[0], F.element_at("edges", -1)
    inner = F.when(F.size("edges") > 2, F.slice("edges", 2, F.size("edges") - 2)).otherwise(
        F.array().cast("array<double>")
    )
    padded = F.when(F.size("edges") == 1, F.array(one - 0.1, one, one + 0.1)).otherwise(
        F.concat(F.array(one - 0.01), inner, F.array(last + 0.01))
    )
    bounds = edges.select(F.struct("cap", "far", padded.alias("edges")).alias("bounds")).scalar()
    value = F.col(col).cast("double")
    return (
        valid.withColumn("_bounds", bounds)
        .withColumns(
            {
                "capped": F.least(value, F.col("_bounds.cap")),
                "is_outlier": F.when(value > F.col("_bounds.far"), F.lit(1)).otherwise(F.lit(0)),
            }
        )
        .withColumn("bin", F.size(F.filter("_bounds.edges", lambda e: e <= F.col("capped"))))
        .drop("_bounds")
    )


def probability_label(p: float) -> str:
    """``0.995`` -> ``p99.5``, ``0.5`` -> ``p50``."""
    percent = round(p * 100, 6)
    return f"p{int(percent)}" if math.isclose(percent, int(percent)) else f"p{percent:g}"
