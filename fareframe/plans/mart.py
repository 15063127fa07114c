"""The month mart: cleaned, enriched, pruned trips with their removal and coverage reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fareframe.functions.calendar import in_month
from fareframe.operators import joins, quality
from fareframe.operators.clean import drop_existing, drop_negative, filter_provider, require_not_null, valid_trips
from fareframe.operators.features import prune_features
from fareframe.operators.metrics import commission_metrics, winsorize_commission
from fareframe.operators.order_stats import quantiles
from fareframe.operators.sampling import in_hash_sample
from fareframe.plans.ingest import gather_months
from fareframe.plans.publish import Run
from fareframe.schemas import REQUIRED_TRIP_COLUMNS
from fareframe.sources.lake import scratch_dir, write_report

REQUIRED_OUTPUT = ("commission", "take_rate", "commission_per_mile", "commission_per_minute")
UNWANTED_OUTPUT = ("tolls", "bcf", "sales_tax", "tips", "revenue_per_mile")


@dataclass
class Sources:
    """Raw trips (``year``/``month`` columns, one root for all months) and the external features."""

    trips: DataFrame | None = None
    zones: DataFrame | None = None
    od: DataFrame | None = None
    calendar: DataFrame | None = None
    weather: DataFrame | None = None


@dataclass
class Settings:
    provider: str = "HV0003"
    provider_col: str = "hvfhs_license_num"
    #: Whether codes are stored normalised, as ingest writes them; the filter then reaches the files.
    normalised: bool = True
    sample_fraction: float = 1.0
    sample_keys: Sequence[str] = ("pickup_datetime", "dropoff_datetime", "PULocationID", "DOLocationID", "driver_pay")
    low_quantile: float = 0.01
    high_quantile: float = 0.99
    winsorize: bool = True
    drop_negative: bool = True
    prune: bool = True
    #: Labels that ``is_redundant_label`` found determined by others over the whole lake.
    drop_labels: Sequence[str] = ()
    require: Sequence[str] = ()
    on_missing: str = "raise"


@dataclass
class Mart:
    trips: DataFrame
    funnel: DataFrame
    joined: dict[str, bool] = field(default_factory=dict)
    bounds: DataFrame | None = None


def month_of(trips: DataFrame, year: int, month: int) -> DataFrame:
    return trips.where((F.col("year") == year) & (F.col("month") == month))


def sample_of(s: Settings) -> Column | None:
    """The sampling rule, seeded by each trip's own month; None to keep every trip."""
    if s.sample_fraction >= 1.0:
        return None
    return in_hash_sample(s.sample_keys, s.sample_fraction, F.col("year").cast("int") * 100 + F.col("month").cast("int"))


def clean_trips(raw: DataFrame, s: Settings) -> DataFrame:
    """Provider, quality and sample filters, early pruning and metrics."""
    df = filter_provider(raw, s.provider_col, s.provider, normalised=s.normalised)
    df = df.transform(require_not_null).transform(valid_trips)
    sampled = sample_of(s)
    if sampled is not None:
        df = df.where(sampled)
    df = df.transform(drop_existing).transform(commission_metrics)
    return drop_negative(df, "commission") if s.drop_negative else df


def month_bounds(df: DataFrame, s: Settings) -> DataFrame:
    """(year, month, winsor_low, winsor_high): the clipping bounds of every month, exact, in one plan."""
    q = quantiles(df, "commission", [s.low_quantile, s.high_quantile], by=["year", "month"])

    def at(p: float) -> Column:
        return F.max(F.when(F.col("p") == float(p), F.col("value")))

    return q.groupBy("year", "month").agg(at(s.low_quantile).alias("winsor_low"), at(s.high_quantile).alias("winsor_high"))


def build(src: Sources, settings: Settings | None = None) -> Mart:
    """The mart of all months in ``src.trips`` as lazy frames; the clipping bounds alone are found and stored at once.

    The raw trips are read twice for the bounds, for the funnel, and for the mart itself, whatever the number of months.
    """
    s = settings or Settings()
    funnel = quality.removal_funnel(src.trips, s.provider_col, s.provider, sampled=sample_of(s))
    df = clean_trips(src.trips, s)
    bounds = None
    if s.winsorize:
        # One row per month.
        folder = scratch_dir(df.sparkSession, "month-bounds")
        found = month_bounds(df, s)
        found.write.parquet(folder)
        bounds = df.sparkSession.read.schema(found.schema).parquet(folder)
        bounded = df.join(F.broadcast(bounds), ["year", "month"], "left")
        limits = F.struct(F.col("winsor_low").alias("lo"), F.col("winsor_high").alias("hi"))
        df = winsorize_commission(bounded, limits).drop("winsor_low", "winsor_high")
        funnel = funnel.join(bounds, ["year", "month"], "left")
    else:
        nothing = F.lit(None).cast("double")
        funnel = funnel.withColumns({"winsor_low": nothing, "winsor_high": nothing})
    df, joined = joins.enrich(
        df, zones=src.zones, od=src.od, calendar=src.calendar, weather=src.weather, on_missing=s.on_missing, require=s.require
    )
    return Mart(prune_features(df, s.drop_labels) if s.prune else df, funnel, joined, bounds)


def build_month(src: Sources, year: int, month: int, settings: Settings | None = None) -> Mart:
    """The mart of one month, with only that month's trips, calendar and weather read."""
    weather, calendar = (
        f if f is None else f.where(in_month(F.col(joins.detect_date_key(f)), year, month)) for f in (src.weather, src.calendar)
    )
    return build(Sources(month_of(src.trips, year, month), src.zones, src.od, calendar, weather), settings)


def _chosen(months: Sequence[tuple[int, int]]) -> Column:
    """Whole years first, so that pruning needs few comparisons."""
    out = F.lit(False)
    for year in sorted({y for y, _ in months}):
        out = out | ((F.col("year") == year) & F.col("month").isin(*[m for y, m in months if y == year]))
    return out


def _stage(run: Run, src: Sources, months: Sequence[tuple[int, int]], s: Settings) -> tuple[list[tuple[Mart, DataFrame]], dict[tuple[int, int], str]]:
    """Stages the months in one job; each mart built with its removal summary, and months that fail with their error.

    If the job fails, the months are staged in halves, so that what breaks one of them is found in a few more jobs.
    """
    spark = src.trips.sparkSession
    try:
        mart = build(replace(src, trips=src.trips.where(_chosen(months))), s)
        problems = quality.check_mart(mart.trips, REQUIRED_OUTPUT, UNWANTED_OUTPUT)
        if problems["missing"] or problems["unwanted"]:
            raise ValueError(f"mart columns are wrong: {problems}")
        folder = scratch_dir(spark, "removal-summary")
        mart.funnel.write.parquet(folder)
        run.stage(mart.trips)
        return [(mart, spark.read.parquet(folder))], {}
    except (PySparkException, Py4JJavaError) as error:
        if isinstance(error, (AnalysisException, ValueError)):  # the plan, not a month
            raise
        if len(months) == 1:
            return [], {months[0]: str(getattr(error, "java_exception", error)).splitlines()[0]}
    done, failed = [], {}
    for half in (months[: len(months) // 2], months[len(months) // 2 :]):
        marts, errors = _stage(run, src, half, s)
        done, failed = done + marts, failed | errors
    return done, failed


def _verified(summary: dict, staged: dict, months: Sequence[tuple[int, int]], source_rows: dict[tuple[int, int], int]) -> dict[tuple[int, int], str]:
    """Months whose rows read, counted and staged don't agree."""
    wrong = {}
    for month in months:
        r = summary.get(month)
        raw, final = (r["raw_count"], r["final_rows"]) if r else (0, 0)
        if raw != source_rows.get(month, raw):
            wrong[month] = f"{raw} of {source_rows[month]} rows could be read"
        elif staged.get(month, 0) != final:
            wrong[month] = f"{staged.get(month, 0)} rows were written, {final} counted"
    return wrong


def run_batch(
    src: Sources,
    months: Sequence[tuple[int, int]],
    path: str,
    settings: Settings | None = None,
    reports: str | None = None,
    source_rows: dict[tuple[int, int], int] | None = None,
    set_aside: dict[tuple[int, int], str] | None = None,
) -> list[dict]:
    """All months in one job; returns one state per month: success, skipped (no trips) or failed.

    Months are staged, verified and then published one by one (``plans.publish``): a month fails if it can't be built,
    if its rows staged differ from those the funnel counts, or if fewer raw rows were read than ``source_rows`` has; the
    lake then keeps what it had of it, and the others are published. ``set_aside`` names months that failed before. A
    plan that can't be built (a missing feature table, wrong columns) fails every month, with nothing written. The
    reports are computed from the staged months and hold all published months of the batch in one table each.
    """
    s, spark = settings or Settings(), src.trips.sparkSession
    failed = dict(set_aside or {})
    wanted = [m for m in months if m not in failed]
    run = Run(spark, path)
    try:
        marts, errors = _stage(run, src, wanted, s) if wanted else ([], {})
    except (ValueError, KeyError, FileNotFoundError, AnalysisException) as error:
        return [{"year": y, "month": m, "status": "failed", "error": str(error)} for y, m in months]
    failed |= errors
    summary = {(r["year"], r["month"]): r for _, funnel in marts for r in funnel.collect()}  # one per month
    staged = run.staged_rows()
    failed |= _verified(summary, staged, [m for m in wanted if m not in failed], source_rows or {})
    good = [m for m in wanted if m not in failed and m in summary]
    told = _reports(run, marts, good) if reports is not None and good else {}
    for month in months:
        if month in failed:
            run.set_aside(*month, failed[month])
        elif staged.get(month):
            run.publish(*month, staged[month])
    for name, frame in told.items():
        write_report(frame.orderBy("year", "month"), f"{reports}/{name}")
    run.close()
    states = []
    for month in months:
        state = {"year": month[0], "month": month[1]}
        r = summary.get(month)
        if month in failed:
            state |= {"status": "failed", "error": failed[month]}
        elif r is None:
            state |= {"status": "skipped"}
        else:
            bounds = None if r["winsor_low"] is None else (r["winsor_low"], r["winsor_high"])
            mart = marts[0][0]
            state |= {"status": "success", "rows": r["final_rows"], "columns": len(mart.trips.columns), "joined": mart.joined, "bounds": bounds}
        states.append(state)
    return states


def _reports(run: Run, marts: Sequence[tuple[Mart, DataFrame]], months: Sequence[tuple[int, int]]) -> dict[str, DataFrame]:
    """Removal summary and coverage of staged months, both written, before anything is published."""
    spark = run.spark
    summary = marts[0][1]
    for _, more in marts[1:]:
        summary = summary.unionByName(more)
    out = {"removal_summary": summary.where(_chosen(months))}
    if run.staged_rows():
        folder = scratch_dir(spark, "coverage")
        quality.coverage(run.read_staged().where(_chosen(months)), by=["year", "month"]).write.parquet(folder)
        out["coverage"] = spark.read.parquet(folder)
    return out


def run_months(
    spark: SparkSession,
    months: dict[tuple[int, int], str],
    path: str,
    src: Sources | None = None,
    settings: Settings | None = None,
    reports: str | None = None,
) -> list[dict]:
    """``run_batch`` from one source folder per month; ``src`` brings the external features alone.

    Folders are judged by their footers first, so a month that is missing, unreadable or lacks a column fails without a
    job of its own, and a file that breaks off behind a sound footer fails its month by the count of its rows.
    """
    s = settings or Settings()
    gathered = gather_months(spark, months, [*REQUIRED_TRIP_COLUMNS, s.provider_col])
    if gathered.trips is None:
        return [{"year": y, "month": m, "status": "failed", "error": gathered.errors[y, m]} for y, m in months]
    year = F.lit(None).cast("int")
    month = year
    for i, (y, m) in enumerate(gathered.months):
        year, month = F.when(F.col("source") == i, y).otherwise(year), F.when(F.col("source") == i, m).otherwise(month)
    trips = gathered.trips.withColumns({"year": year, "month": month}).drop("source")
    rows = dict(zip(gathered.months, gathered.rows, strict=True))
    features = src or Sources(trips)
    return run_batch(replace(features, trips=trips), list(months), path, replace(s, normalised=False), reports, rows, gathered.errors)


def run_month(src: Sources, year: int, month: int, path: str, settings: Settings | None = None, reports: str | None = None) -> dict:
    """Build and publish one month with its reports, reading only its own trips, calendar and weather."""
    weather, calendar = (
        f if f is None else f.where(in_month(F.col(joins.detect_date_key(f)), year, month)) for f in (src.weather, src.calendar)
    )
    return run_batch(replace(src, weather=weather, calendar=calendar), [(year, month)], path, settings, reports)[0]
