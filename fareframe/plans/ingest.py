"""Raw ingest and backfill."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fareframe.operators.sizing import small_side
from fareframe.plans.publish import Run
from fareframe.schemas import TRIP_TYPES, conform, malformed
from fareframe.sources.footers import read_footers
from fareframe.sources.lake import read_parquet_tree, write_partitioned


def prepare_trips(df: DataFrame, ts: str = "pickup_datetime", code: str = "hvfhs_license_num") -> DataFrame:
    """Cast the numeric columns, normalise the provider code and stamp year, month and ingest time.

    Normalised codes let later provider filters push down to the files.
    """
    df = conform(df, TRIP_TYPES)
    if code in df.columns:
        df = df.withColumn(code, F.upper(F.trim(F.col(code))))
    return df.withColumns(
        {"year": F.year(ts), "month": F.month(ts), "ingest_ts": F.current_timestamp()}
    )


def ingest_trips(df: DataFrame, path: str, nulled: dict[str, int] | None = None) -> int:
    """Write trips to the partitioned lake and return the row count.

    Covers one month or a whole backfill alike: one read, one write, only the months present are
    replaced. The counts are observed on the write itself: the rows, and in ``nulled``, if given, the values of each
    column that could not be read as its type and are stored as null.
    """
    seen, bad = Observation("ingest"), Observation("malformed")
    counts = malformed(df, TRIP_TYPES)
    if nulled is not None and counts:
        df = df.observe(bad, *[n.alias(c) for c, n in counts.items()])
    write_partitioned(prepare_trips(df).observe(seen, F.count(F.lit(1)).alias("rows")), path)
    if nulled is not None and counts:
        nulled.update({c: n for c, n in bad.get.items() if n})
    return seen.get["rows"]


def backfill(spark: SparkSession, sources: Sequence[str], path: str) -> int:
    """Ingest many source paths in one job."""
    return ingest_trips(read_parquet_tree(spark, sources), path)


@dataclass
class Gathered:
    """Source months as one frame with the number of their source in ``source``; rows their footers promise, in the same
    order; and months that can't be read, with the reason."""

    trips: DataFrame | None
    months: list[tuple[int, int]]
    rows: list[int]
    errors: dict[tuple[int, int], str]


def _label(year: int, month: int) -> str:
    return f"{year}-{month:02d}"


def gather_months(spark: SparkSession, months: dict[tuple[int, int], str], required: Sequence[str] = ("pickup_datetime",)) -> Gathered:
    """All readable source months in one frame, judged by their footers before any data is read.

    A month without files, with a file whose footer can't be read or that lacks a required column is set aside. Columns
    that months lack are null; the numeric columns are cast as ingest does. What is corrupt behind a sound footer is
    skipped by the reader: whoever uses the frame compares the rows read of each source with ``rows``.
    """
    found = read_footers(spark, {_label(*m): path for m, path in months.items()})
    names = F.transform("columns", lambda c: c["name"])
    shape = F.to_json(F.transform("columns", lambda c: F.struct(c["name"], c["type"])))
    lacking = F.array_except(F.array(*[F.lit(c) for c in required]), names)
    folder = F.expr("substring(path, 1, length(path) - length(element_at(split(path, '/'), -1)) - 1)")
    parts = found.groupBy("part").agg(
        F.count("path").alias("files"), F.sum("rows").alias("rows"), F.min("error").alias("error"), F.collect_set(folder).alias("folders"),
        F.collect_set(shape).alias("shapes"), F.array_distinct(F.flatten(F.collect_list(lacking))).alias("lacking"),
    )
    told = {r.part: r for r in parts.collect()}  # one per month
    errors, alike = {}, {}
    for month in months:
        r = told.get(_label(*month))
        if r is None or r.error or not r.files or r.lacking:
            errors[month] = "no files" if r is None else r.error or (f"columns missing: {', '.join(r.lacking)}" if r.files else "no files")
        else:
            alike.setdefault(r.shapes[0] if len(r.shapes) == 1 else month, []).append(month)
    # Months of one schema are one scan; rows find their month by their file's folder.
    frame, good = None, []
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("ignoreCorruptFiles", "true")
    for shape, group in alike.items():
        try:
            scan = reader.option("mergeSchema", str(shape == group[0]).lower()).parquet(*[months[m] for m in group])
            here = F.expr("substring_index(_metadata.file_path, '/', size(split(_metadata.file_path, '/')) - 1)").alias("_folder")
            df = conform(scan.select("*", here), TRIP_TYPES)
            frame = df if frame is None else frame.unionByName(df, allowMissingColumns=True)
        except PySparkException as error:  # a month whose types don't merge
            errors |= {m: str(error).splitlines()[0] for m in group}
            continue
        good += group
    if frame is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path
        places = [(str(path(f).toUri().toString()), i) for i, m in enumerate(good) for f in told[_label(*m)].folders]
        frame = frame.join(small_side(spark.createDataFrame(places, "_folder string, source int")), "_folder").drop("_folder")
    return Gathered(frame, good, [told[_label(*m)].rows for m in good], errors)


def ingest_each(spark: SparkSession, months: dict[tuple[int, int], str], path: str) -> list[dict]:
    """Ingests source months into the lake; one state per month, and a bad one stops no other.

    All readable months are written in one job, below a staging folder. A month is published if as many rows of its
    source were read as its footers promise; else, and if it can't be read at all, it is ``failed`` with its error, and
    the lake keeps what it had of it. Rows belong to the month of their pickup; those of a month that the batch doesn't
    publish are ``strays`` of their source and replace nothing.
    """
    gathered = gather_months(spark, months)
    run = Run(spark, path)
    errors = dict(gathered.errors)
    seen = {}
    if gathered.trips is not None:
        counted = Observation("sources")
        ym = F.year("pickup_datetime") * 100 + F.month("pickup_datetime")
        inside = F.coalesce(ym.isin(*[y * 100 + m for y, m in gathered.months]), F.lit(False))
        counts = [F.count_if(F.col("source") == i).alias(f"n{i}") for i in range(len(gathered.months))]
        strays = [F.count_if((F.col("source") == i) & ~inside).alias(f"s{i}") for i in range(len(gathered.months))]
        kept = prepare_trips(gathered.trips.observe(counted, *counts, *strays)).where(inside).drop("source")
        run.stage(kept)
        seen = counted.get
    for i, month in enumerate(gathered.months):
        if seen[f"n{i}"] != gathered.rows[i]:
            errors[month] = f"{seen[f'n{i}']} of {gathered.rows[i]} rows could be read"
    staged = run.staged_rows()
    states = []
    for month in months:
        state = {"year": month[0], "month": month[1]}
        if month in errors:
            run.set_aside(*month, errors[month])
            states.append(state | {"status": "failed", "error": errors[month]})
            continue
        rows = staged.get(month, 0)
        if rows:
            run.publish(*month, rows)
        states.append(state | {"status": "success", "rows": rows, "strays": seen[f"s{gathered.months.index(month)}"]})
    run.close()
    return states
