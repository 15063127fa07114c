"""Two-phase writes of monthly lakes: stage, verify, publish month by month, keep a record.

A run writes its months below ``<lake>/_staging/<run>``, which readers of the lake don't see. Each staged month is
verified there. A good one is published by renames: the old folder moves to ``_replaced/<run>``, the staged one takes
its place. A record per month in ``_publications/<run>`` says what was done; a month that fails is set aside with its
error and the lake keeps what it had. A run that ended between the two renames is finished by ``recover``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareframe.sources import footers

RECORD = "run string, year int, month int, status string, rows bigint, error string"


class Files:
    """The few file system calls of publishing."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def move(self, source: str, target: str) -> None:
        self._fs.mkdirs(self._path(target).getParent())
        if not self._fs.rename(self._path(source), self._path(target)):
            raise OSError(f"cannot move {source} to {target}")

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def put(self, path: str, text: str) -> None:
        """The whole file or none: written beside and renamed."""
        beside = f"{path}.tmp-{uuid.uuid4().hex}"
        out = self._fs.create(self._path(beside))
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.delete(self._path(path), False)
        self.move(beside, path)

    def list(self, path: str) -> list[str]:
        return sorted(str(s.getPath().toString()) for s in self._fs.listStatus(self._path(path))) if self.exists(path) else []


def _folder(year: int, month: int) -> str:
    return f"year={year}/month={month}"


class Run:
    """One run over a lake of ``year=/month=`` folders."""

    def __init__(self, spark: SparkSession, path: str, name: str | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.name = name or uuid.uuid4().hex
        self.staging = f"{self.path}/_staging/{self.name}"
        self._files = Files(spark, self.path)

    def stage(self, df: DataFrame) -> None:
        """Adds months to the staging folder; the frame has ``year`` and ``month``."""
        df.hint("rebalance", F.col("year"), F.col("month")).write.mode("append").partitionBy("year", "month").parquet(self.staging)

    def staged_rows(self) -> dict[tuple[int, int], int]:
        """Rows of each staged month, from the files' footers. A month that has an unreadable file is left out."""
        if not self._files.exists(self.staging) or not any("year=" in p for p in self._files.list(self.staging)):
            return {}
        found = footers.read_footers(self.spark, self.staging)
        bad = {r.part for r in found.where("error is not null").select("part").distinct().collect()}
        rows = footers.partition_values(found).collect()  # one per month
        return {(r.year, r.month): r.rows for r in rows if _folder(r.year, r.month) not in bad}

    def read_staged(self) -> DataFrame:
        return self.spark.read.parquet(self.staging)

    def publish(self, year: int, month: int, rows: int) -> None:
        folder = _folder(year, month)
        self._record(year, month, "publishing", rows)
        self._swap(folder)
        self._record(year, month, "success", rows)

    def set_aside(self, year: int, month: int, error: str) -> None:
        self._record(year, month, "failed", None, error)

    def close(self) -> None:
        """Clears what was staged and replaced; months set aside are not kept."""
        self._files.remove(self.staging)
        self._files.remove(f"{self.path}/_replaced/{self.name}")

    def _swap(self, folder: str) -> None:
        """Each step is skipped if it was done before, so that a broken run can be taken up again."""
        staged, live, old = f"{self.staging}/{folder}", f"{self.path}/{folder}", f"{self.path}/_replaced/{self.name}/{folder}"
        if not self._files.exists(staged):
            return
        if self._files.exists(live):
            self._files.move(live, old)
        self._files.move(staged, live)

    def _record(self, year: int, month: int, status: str, rows: int | None, error: str | None = None) -> None:
        row = {"run": self.name, "year": year, "month": month, "status": status, "rows": rows, "error": error}
        self._files.put(f"{self.path}/_publications/{self.name}/{year}-{month:02d}.json", json.dumps(row))


def publications(spark: SparkSession, path: str) -> DataFrame:
    """The records of all runs over a lake: run, year, month, status, rows, error."""
    folders = Files(spark, path).list(f"{path.rstrip('/')}/_publications")
    return spark.read.schema(RECORD).json(folders) if folders else spark.createDataFrame([], RECORD)


def recover(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """Finishes months whose publication was begun and not ended; returns them. One record per such month is read."""
    open_ = publications(spark, path).where("status = 'publishing'").collect()
    for r in open_:
        run = Run(spark, path, r.run)
        run._swap(_folder(r.year, r.month))
        run._record(r.year, r.month, "success", r.rows)
    return [(r.year, r.month) for r in open_]
