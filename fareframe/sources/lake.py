"""Trip lake: path probes, pruned reads, partitioned writes, reports and artefacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareframe.sources import footers
from fareframe.sources.footers import path_exists
from fareframe.sources.scratch import scratch_dir  # noqa: F401  callers take it from here

# Month path layouts, in order of preference.
MONTH_PATTERNS = (
    "{base}/year={year}/month={month:02d}",
    "{base}/year={year}/month={month}",
    "{base}/*_{year}-{month:02d}.parquet",
)


def first_existing(spark: SparkSession, patterns: Sequence[str]) -> str:
    for pattern in patterns:
        if path_exists(spark, pattern):
            return pattern
    raise FileNotFoundError(f"nothing found under any of {list(patterns)}")


def read_parquet_tree(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Every Parquet file below a path, other files ignored. Partition folders are not read as columns."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(*paths)


def read_month(
    spark: SparkSession, base: str, year: int, month: int, patterns: Sequence[str] = MONTH_PATTERNS
) -> DataFrame:
    """One month from the first layout that exists."""
    found = first_existing(spark, [p.format(base=base, year=year, month=month) for p in patterns])
    return read_parquet_tree(spark, found)


def read_first_of(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return read_parquet_tree(spark, first_existing(spark, paths))


def read_lake(
    spark: SparkSession, path: str, years: Sequence[int] | None = None, months: Sequence[int] | None = None
) -> DataFrame:
    """A ``year=/month=`` lake; the filters prune partitions."""
    df = spark.read.parquet(path)
    if years is not None:
        df = df.where(F.col("year").isin(*years))
    if months is not None:
        df = df.where(F.col("month").isin(*months))
    return df


def month_available(
    spark: SparkSession, base: str, year: int, month: int, patterns: Sequence[str] = MONTH_PATTERNS
) -> bool:
    """The month's path exists, zero-padded or not, and holds at least one row."""
    for pattern in patterns:
        path = pattern.format(base=base, year=year, month=month)
        if path_exists(spark, path) and not read_parquet_tree(spark, path).isEmpty():
            return True
    return False


def feature_availability(spark: SparkSession, paths: dict[str, str]) -> dict[str, bool]:
    """Which external feature sets exist."""
    return {name: path_exists(spark, path) for name, path in paths.items()}


def load_features(
    spark: SparkSession, base: str, kind: str, year: int | None = None, month: int | None = None
) -> DataFrame:
    """One external feature set, optionally a single month of it."""
    root = f"{base}/{kind}"
    if year is None or month is None:
        return read_parquet_tree(spark, root)
    return read_month(spark, root, year, month)


def write_partitioned(
    df: DataFrame,
    path: str,
    parts: Sequence[str] = ("year", "month"),
    mode: str = "overwrite",
    max_records_per_file: int = 0,
) -> None:
    """Partitioned Parquet; overwriting replaces only the partitions present in ``df``.

    The rebalance hint groups rows by partition and lets AQE split a large month over many tasks,
    where a plain repartition would give each month to one.
    """
    writer = df.hint("rebalance", *[F.col(c) for c in parts]).write.mode(mode)
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    writer.partitionBy(*parts).parquet(path)


def list_partitions(spark: SparkSession, path: str, parts: Sequence[str] = ("year", "month")) -> DataFrame:
    """The partition values below a path, as whole numbers in order, from the folder names alone."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *(f"{p}=*" for p in parts)]))
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    rows = set()
    for status in found:
        names = str(status.getPath().toString()).rstrip("/").split("/")[-len(parts) :]
        values = [n.partition("=")[2] for n in names]
        if all(v.lstrip("-").isdigit() for v in values):
            rows.add(tuple(int(v) for v in values))
    return spark.createDataFrame(sorted(rows), ", ".join(f"{p} int" for p in parts)).orderBy(*parts)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as Parquet and as one CSV file with a header in ``<path>_csv``.

    The frame is computed once: the CSV file is written from the Parquet one. The rows move to one task only after the
    aggregation, so its stages stay parallel.
    """
    df.repartition(1).write.mode("overwrite").parquet(path)
    df.sparkSession.read.parquet(path).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}_csv")


def write_build_manifest(spark: SparkSession, path: str, **fields) -> None:
    """What a feature build produced (months, features, counts), as one JSON row."""
    spark.createDataFrame([fields]).repartition(1).write.mode("overwrite").json(path)


def write_thresholds(table: DataFrame, path: str, **fields) -> None:
    """Thresholds as one JSON row: ``<column>_lower``, ``<column>_upper`` and any extra fields."""
    row = {f"{r['column']}_{end}": float(r[end]) for r in table.collect() for end in ("lower", "upper")}
    write_build_manifest(table.sparkSession, path, **row, **fields)


def read_thresholds(spark: SparkSession, path: str) -> dict[str, tuple[float, float]]:
    row = spark.read.json(path).first().asDict()
    names = [k.removesuffix("_lower") for k in row if k.endswith("_lower")]
    return {n: (row[f"{n}_lower"], row[f"{n}_upper"]) for n in names}


def lake_schema_drift(spark: SparkSession, paths: dict[str, str], expected: Sequence[str]) -> DataFrame:
    """Missing and extra columns of each named path against the expected ones, in any of its files, from their footers."""
    return footers.drift(footers.read_footers(spark, paths), expected).select("part", "missing", "extra")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
