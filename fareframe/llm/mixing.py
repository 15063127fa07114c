"""Mixing sources to target weights by systematic sampling. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fareframe.llm.scratch import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
SEED = "mix"
#: Documents of a source whose places are counted together, on average.
CELL_ROWS = 20_000


def unit(key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of a text's MD5, the same in every engine and run."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def size_class(size: Column) -> Column:
    """Eight classes to a doubling, so that documents of about equal size stand together."""
    return F.floor(F.log2(size + F.lit(1.0)) * 8 + 1e-9).cast("int")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, docs, target: what each source gives of ``share`` of all sizes, by weight.

    ``sizes`` has one row per source. No target exceeds ``most`` times the source's size; what is above is shared anew
    among the others by weight until none is above. That is one level of water: with sources in the order of
    cap / weight, a source is full if what is left, shared by weight among it and those after it, reaches its cap.
    Sources take the weights in the order of their code points, null last, in turn. The windows run over one row per
    source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn.cast("int") + 1)
    t = sizes.withColumns({"w": w, "cap": F.col("source_size") * F.lit(float(most))})
    level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    t = t.withColumns(
        {
            "total": F.sum("source_size").over(everything) * F.lit(float(share)),
            "full": F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "open": F.sum("w").over(level.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    t = t.withColumn("rate", (F.col("total") - F.col("full")) / F.col("open"))
    # The water level is that of the first source that does not fill up, after which rates only fall; without such a
    # source, every one is full.
    t = t.withColumn("lambda", F.max(F.when(F.col("rate") * F.col("w") <= F.col("cap"), F.col("rate"))).over(everything))
    target = F.least(F.col("cap"), F.coalesce(F.col("lambda") * F.col("w"), F.col("cap")))
    return t.select("source", "source_size", "docs", target.alias("target"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mixed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: how often the mix takes each row.

    A source takes target / source_size of itself. Its rows stand by size, ties by the hash of doc_id; the expected
    copies add up along that order; one offset per source shifts the sums, and a row is taken once per integer that its
    sum crosses. So no row is taken more than ``MOST`` times, rounded up, all sizes are taken at the source's rate, and
    the words taken miss the target by about the longest document at most.

    A row's place is the number of rows in the cells before (a cell is a size class and the leading digits of the hash,
    a small source's only the class) plus its place in the cell. More digits are taken as a source grows, so that no
    cell, and no task, holds much more than ``CELL_ROWS`` rows of one hot source.

    Defined cases: null text has size 0 and is taken at the rate of its source; null source is a source of its own, the
    last; a source without words has target 0 and is not taken; rows that agree in doc_id, source and size share one
    place and are each taken as often as it says; other columns are ignored. An empty table gives an empty result.
    Reruns agree.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    rows = written(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("alike")), "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("alike")).alias("source_size"), F.count(F.lit(1)).alias("docs"))
    digits = F.least(F.lit(8), F.greatest(F.lit(0), F.ceil(F.log2(F.col("docs") / F.lit(float(CELL_ROWS))) / 4))).cast("int")
    goal = targets(sizes).withColumn("digits", digits).withColumnRenamed("source", "s")
    placed = rows.join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = placed.withColumns(
        {
            "h": F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":" + seed))),
            "cls": size_class(F.col("size")),
        }
    ).withColumn("cell", F.substring(F.col("h"), F.lit(1), F.col("digits")))
    cells = placed.groupBy("source", "cls", "cell").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("source").orderBy("cls", "cell").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.select(
        F.col("source").alias("s"), F.col("cls").alias("c"), F.col("cell").alias("d"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("source", "cls", "cell").orderBy("size", "h", "doc_id")
    p = placed.withColumn("inside", F.row_number().over(inside))
    p = p.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("cls") == F.col("c")) & (F.col("cell") == F.col("d")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = unit(F.concat(F.coalesce("source", F.lit("")), F.lit(":" + seed)))
    place = F.col("before") + F.col("inside")
    p = p.withColumn("copies", (F.floor(place * rate + u) - F.floor((place - 1) * rate + u)).cast("int"))
    p = p.select("doc_id", "source", "size", "source_size", "target", "copies", "alike")
    return p.withColumn("alike", F.explode(F.sequence(F.lit(1).cast("long"), F.col("alike")))).drop("alike")


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixed corpus: every row as often as ``mixed`` says, with the columns of ``docs``."""
    taken = mixed(docs, seed).where("copies > 0").distinct()
    taken = taken.select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("size").alias("z"), F.col("copies").alias("k"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    return rows.join(taken, same).select("row", F.explode(F.sequence(F.lit(1), F.col("k")))).select("row.*")
