"""Seeded samples, stable samples, splits and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fareframe.operators.sizing import small_side

_HASH_BITS = 60
CELL_BITS = 16


def month_seed(year: int, month: int) -> int:
    """The same in every process, unlike a hash of text."""
    return year * 100 + month


def bernoulli(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Row sample; repeatable for one physical layout of the input."""
    return df.sample(False, fraction, seed)


def sample_hash(keys: Sequence[str], seed: int | Column = 0) -> Column:
    """A whole number below 2^60 from the keys' MD5: the same for a row in every layout, run and engine."""
    start = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    text = F.concat_ws("|", start, *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, _HASH_BITS // 4), 16, 10).cast("bigint")


def in_hash_sample(keys: Sequence[str], fraction: float | Column, seed: int | Column = 0) -> Column:
    """Membership by key hash: the same rows however the input is partitioned. Any fraction above 2^-60 counts."""
    share = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    return sample_hash(keys, seed) < share * F.lit(float(1 << _HASH_BITS))


def hash_sample(df: DataFrame, keys: Sequence[str], fraction: float, seed: int = 0) -> DataFrame:
    return df.where(in_hash_sample(keys, fraction, seed))


def stratified(df: DataFrame, stratum: str, fractions: float | dict, seed: int = 42) -> DataFrame:
    """One fraction per stratum value. A constant fraction needs no list of the strata."""
    if isinstance(fractions, dict):
        return df.sampleBy(stratum, fractions, seed)
    return df.sample(False, fractions, seed)


def stratified_hash(df: DataFrame, stratum: str, fractions: dict, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """As ``stratified``, but stable under repartitioning; strata not listed drop out."""
    share = F.lit(0.0)
    for value, fraction in fractions.items():
        share = F.when(F.col(stratum) == value, F.lit(float(fraction))).otherwise(share)
    return df.where(in_hash_sample(keys, share, seed))


def sample_n(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """The ``n`` rows of least key hash: every row has the same chance, wherever it is stored."""
    return sample_n_by(df.withColumn("_all", F.lit(0)), n, "_all", keys, seed).drop("_all")


def sample_n_by(df: DataFrame, n: int | dict, stratum: str, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows of each stratum, or all if it has fewer: those of least key hash.

    ``n`` is one number, or one per value; values not listed drop out. Hashes are counted in 2^16 cells of equal
    width. Along each stratum's counts one cell holds the last row taken: rows of the cells before are taken as they are
    read, and only that cell's rows, one in 65,536, are put in order. No task orders or keeps ``n`` rows. Rows of equal
    keys are taken in any order; a null stratum is a stratum of its own if ``n`` is a number.
    """
    if isinstance(n, dict):
        want = F.lit(0)
        for value, size in n.items():
            want = F.when(F.col(stratum) == value, F.lit(int(size))).otherwise(want)
    else:
        want = F.lit(int(n))
    cell = F.shiftright("_hash", _HASH_BITS - CELL_BITS).cast("int")
    rows = df.withColumn("_hash", sample_hash(keys, seed)).withColumn("_cell", cell)
    counts = rows.groupBy(stratum, "_cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(stratum).orderBy("_cell")) - F.col("n")  # over the cells of a stratum
    edges = counts.withColumns({"before": before, "want": want}).where((F.col("before") < F.col("want")) & (F.col("before") + F.col("n") >= F.col("want")))
    edges = edges.select(F.col(stratum).alias("_of"), F.col("_cell").alias("_edge"), (F.col("want") - F.col("before")).alias("_left"))
    met = rows.join(small_side(edges), F.col(stratum).eqNullSafe(F.col("_of")), "left").where(want > 0)
    whole = met.where(F.col("_edge").isNull() | (F.col("_cell") < F.col("_edge")))
    nth = F.row_number().over(Window.partitionBy(stratum).orderBy("_hash", *keys))
    part = met.where(F.col("_cell") == F.col("_edge")).withColumn("_nth", nth).where(F.col("_nth") <= F.col("_left"))
    return whole.select(*df.columns).unionAll(part.select(*df.columns))


def year_split(df: DataFrame, last_train: int, col: str = "year") -> tuple[DataFrame, DataFrame]:
    """Rows up to and including a year, and rows after it; a null year is in neither."""
    return df.where(F.col(col) <= last_train), df.where(F.col(col) > last_train)


def top_k(df: DataFrame, by: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows in the given order; give a total order for a repeatable result."""
    return df.orderBy(*by).limit(k)
