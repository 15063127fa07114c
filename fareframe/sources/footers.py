"""Parquet footers as a table: what files hold, known without reading a data page."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMN_TYPE = "struct<name: string, type: string, nulls: bigint, low: string, high: string>"
SCHEMA = f"part string, path string, bytes bigint, error string, rows bigint, row_groups int, columns array<{COLUMN_TYPE}>"
_FOUND = pa.struct([("name", pa.string()), ("type", pa.string()), ("nulls", pa.int64()), ("low", pa.string()), ("high", pa.string())])
_ARROW = pa.schema(
    [("part", pa.string()), ("path", pa.string()), ("bytes", pa.int64()), ("error", pa.string()), ("rows", pa.int64()),
     ("row_groups", pa.int32()), ("columns", pa.list_(_FOUND))]
)


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)


def _as_text(x) -> str | None:
    return None if x is None else x.isoformat() if hasattr(x, "isoformat") else x.decode("utf-8", "replace") if isinstance(x, bytes) else str(x)


def _columns(meta: pq.FileMetaData) -> list[dict]:
    """Name, type, nulls and ends of each column; a column nested or without statistics has its name and type only."""
    found = {}
    for i in range(meta.num_columns):
        nulls, low, high = 0, None, None
        name = meta.schema.column(i).path
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(i).statistics
            if s is None or not s.has_null_count or nulls is None:
                nulls = None
                continue
            nulls += s.null_count
            if s.has_min_max and s.physical_type != "INT96":  # whose order is undefined
                low = s.min if low is None else min(low, s.min)
                high = s.max if high is None else max(high, s.max)
        found[name] = {"nulls": nulls, "low": _as_text(low), "high": _as_text(high)}
    unknown = {"nulls": None, "low": None, "high": None}
    return [{"name": f.name, "type": str(f.type), **found.get(f.name, unknown)} for f in meta.schema.to_arrow_schema()]


def _part(path: str, roots: dict[str, str], relative: bool) -> str | None:
    """The name of the root above a file, or its folder below it."""
    folder = path.rpartition("/")[0]
    at = folder
    while at and at not in roots:
        at = at.rpartition("/")[0]
    return folder[len(at) :].lstrip("/") if relative else roots.get(at)


def _read(roots: dict[str, str], relative: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                row = {"part": _part(r["path"], roots, relative), "path": r["path"], "bytes": r["length"], "error": None, "rows": None, "row_groups": None, "columns": None}
                try:
                    fs, name = _open(r["path"])
                    with fs.open_input_file(name) as f:
                        meta = pq.read_metadata(f)
                    row |= {"rows": meta.num_rows, "row_groups": meta.num_row_groups, "columns": _columns(meta)}
                except Exception as error:  # whatever is wrong with a file is what the table tells of it
                    row["error"] = f"{type(error).__name__}: {error}"[:500]
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return run


def path_exists(spark: SparkSession, pattern: str) -> bool:
    """True when a path or glob matches, asked of the file system itself."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def qualified(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return str(fs.makeQualified(p).toString()).rstrip("/")


def read_footers(spark: SparkSession, source: str | dict[str, str]) -> DataFrame:
    """One row per Parquet file: part, path, bytes, error, rows, row_groups, columns (name, type, nulls, low, high).

    ``source`` is a root, and ``part`` then a file's folder below it, or named folders, and ``part`` then the name. Spark
    lists the files and deals them out; tasks read their footers alone, so the cost follows the number of files and not
    their size. ``low`` and ``high`` are over all row groups, as text. A file whose footer can't be read has its
    ``error`` and nothing else; a folder that doesn't exist has one row with its error and no path. The store must be one
    that Arrow's file systems open from a URI.
    """
    named = {"": source} if isinstance(source, str) else source
    roots, absent = {}, []
    for name, path in named.items():
        if path_exists(spark, path):
            roots[qualified(spark, path)] = name
        else:
            absent.append((name, None, None, f"no such path: {path}", None, None, None))
    missing = spark.createDataFrame(absent, SCHEMA)
    if not roots:
        return missing
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    # Files are packed into tasks by their size, which says nothing about the size of their footers.
    files = listing.load(list(roots)).select("path", "length").repartition(max(1, spark.sparkContext.defaultParallelism))
    read = files.mapInArrow(_read(roots, isinstance(source, str)), SCHEMA)
    return read.unionByName(missing) if absent else read


def part_rows(footers: DataFrame) -> DataFrame:
    """part, files, rows, bytes, error (the first one of its files) of each part."""
    return footers.groupBy("part").agg(
        F.count("path").alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.min("error").alias("error")
    )


def column_stats(footers: DataFrame) -> DataFrame:
    """part, column, type, files, rows, nulls of each column of each part; differing types are listed with a comma."""
    each = footers.where("columns is not null").select("part", "rows", F.inline("columns"))
    return each.groupBy("part", F.col("name").alias("column")).agg(
        F.array_join(F.array_sort(F.collect_set("type")), ",").alias("type"), F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls")
    )


def _joined(names: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(names)))), ",")


def drift(footers: DataFrame, expected: Sequence[str] | dict[str, str]) -> DataFrame:
    """part, missing, extra, retyped, rows of the parts that differ from the expected columns, in any of their files.

    With a dictionary, types (as Arrow names them) are compared too. Names are in order, joined by commas. A part with
    an unreadable file is not judged by that file.
    """
    types = dict(expected) if isinstance(expected, dict) else {}
    wanted = F.array(*[F.lit(c) for c in expected]).cast("array<string>")
    names = F.transform("columns", lambda c: c["name"])
    other = F.lit(False)
    retyped = F.array().cast("array<string>")
    if types:
        of = F.create_map(*[x for c, t in types.items() for x in (F.lit(c), F.lit(t))])
        retyped = F.transform(F.filter("columns", lambda c: F.coalesce(of[c["name"]] != c["type"], other)), lambda c: c["name"])
    each = footers.where("columns is not null").select(
        "part", "rows", F.array_except(wanted, names).alias("m"), F.array_except(names, wanted).alias("e"), retyped.alias("t")
    )
    parts = each.groupBy("part").agg(_joined(F.col("m")).alias("missing"), _joined(F.col("e")).alias("extra"), _joined(F.col("t")).alias("retyped"), F.sum("rows").alias("rows"))
    return parts.where("missing <> '' or extra <> '' or retyped <> ''")


def available(footers: DataFrame, parts: Iterable[str]) -> dict[str, bool]:
    """Which of the parts hold at least one readable row. One row per part reaches the driver."""
    found = {r.part for r in footers.groupBy("part").agg(F.sum("rows").alias("n")).where("n > 0").collect()}
    return {p: p in found for p in parts}


def partition_values(footers: DataFrame, parts: Sequence[str] = ("year", "month")) -> DataFrame:
    """The partition values of a root's folders, with their files and rows, in order."""
    values = [F.regexp_extract("part", rf"(?:^|/){p}=(-?[0-9]+)(?:/|$)", 1).cast("int").alias(p) for p in parts]
    named = footers.where(" and ".join(rf"part rlike '(^|/){p}=-?[0-9]+(/|$)'" for p in parts))
    return named.groupBy(*values).agg(F.count("path").alias("files"), F.sum("rows").alias("rows")).orderBy(*parts)
