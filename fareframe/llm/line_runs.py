"""Removes later copies of repeated line runs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_LINES = 2
MIN_WORDS = 5
_LAST = (1 << 63) - 1


def _name(x: Column) -> Column:
    return F.unhex(F.md5(x))


def _doubled(names: Column, gap: int, size: Column) -> Column:
    """Names of the windows that join each window with the one ``gap`` lines later."""
    joined = F.transform(
        F.sequence(F.lit(1), size - gap), lambda i: _name(F.concat(F.element_at(names, i), F.element_at(names, i + gap)))
    )
    return F.when(size > gap, joined).otherwise(F.array().cast("array<binary>"))


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, digest (MD5 of the text), gone (array<int>): the lines, from 0, of later copies of repeated runs.

    Windows of ``min_lines`` lines are named by 128-bit digests made from those of their halves, and a run is repeated
    where a window's name occurs more than once: fixed windows stand in place of a suffix array, so neither ranks nor
    common prefix lengths are made. The first window of each name, in the order of doc_id and line, stays.
    """
    if min_lines < 1:
        raise ValueError("min_lines must be at least 1")
    # Blank lines neither make nor break a run.
    d = docs.select("doc_id", F.md5("text").alias("digest"), F.split("text", "\n", -1).alias("lines"))
    ink = F.filter(
        F.transform("lines", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: F.regexp_like(p["x"], F.lit(r"\S"))
    )
    d = d.withColumn("ink", ink)
    d = d.select(
        "doc_id", "digest",
        F.transform("ink", lambda p: p["i"]).alias("at"),
        F.transform("ink", lambda p: _name(p["x"])).alias("w1"),
        F.transform("ink", lambda p: F.size(F.split(F.trim(p["x"]), r"\s+")) >= min_words).alias("long"),
    ).withColumn("n", F.size("at"))
    width, names = 1, "w1"
    while width * 2 <= min_lines:
        d = d.withColumn(f"w{2 * width}", _doubled(F.col(names), width, F.col("n") - (width - 1)))
        width *= 2
        names = f"w{width}"
    if width < min_lines:  # two overlapping windows cover the rest
        gap = min_lines - width
        d = d.withColumn("wk", _doubled(F.col(names), gap, F.col("n") - (width - 1)))
        names = "wk"
    runs = F.transform(names, lambda x, i: F.struct(F.lit(min_lines).alias("k"), x.alias("name"), i.alias("i")))
    singles = F.filter(
        F.transform("w1", lambda x, i: F.struct(F.lit(1).alias("k"), x.alias("name"), i.alias("i"))),
        lambda p: F.element_at("long", p["i"] + 1),
    )
    windows = d.select("doc_id", "digest", "at", F.explode(F.concat(runs, singles) if min_lines > 1 else runs).alias("w"))
    key = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), F.col("digest"), F.col("w.i").alias("i"))
    windows = windows.select("doc_id", "digest", F.col("w.k").alias("k"), F.col("w.name").alias("name"), key.alias("key"), F.slice("at", F.col("w.i") + 1, F.col("w.k")).alias("covers"))
    first = windows.groupBy("k", "name").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = windows.join(first, ["k", "name"]).where(F.col("key") != F.col("first"))
    return later.groupBy("doc_id", "digest").agg(F.array_distinct(F.flatten(F.collect_set("covers"))).alias("gone"))


def drop_repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows with ``text`` without later copies of repeated line runs, and ``n_lines``, ``n_removed``.

    A run is ``min_lines`` or more consecutive non-blank lines, or one line of at least ``min_words`` words. Lines are
    cut at line feeds and compared exactly; blank lines are kept.

    Defined cases: null text stays null with 0 lines; empty text is one (blank) line; rows equal in doc_id and text are
    one document and keep the same lines; rows without doc_id come last in the order; a text may lose all its lines
    and is then empty. Existing columns ``n_lines`` and ``n_removed`` are replaced, all others stay. An empty table
    gives an empty result.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    gone = repeated_lines(docs.select("doc_id", "text"), min_lines, min_words)
    gone = gone.select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), "gone")
    rows = docs.select(F.struct(*own).alias("row"), "doc_id", F.md5("text").alias("digest"))
    joined = rows.join(gone, (F.col("digest") == F.col("g")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    lines = F.split("row.text", "\n", -1)
    all_ = F.sequence(F.lit(0), F.size(lines) - 1)
    kept = F.transform(F.array_except(all_, F.coalesce("gone", F.array().cast("array<int>"))), lambda i: F.get(lines, i))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in own],
        F.when(F.col("row.text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )
