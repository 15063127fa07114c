"""Tables written into the shared folder, which cut lineage and survive lost executors; code for Python workers."""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

import fareframe
from fareframe.sources.lake import scratch_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table under the session's shared folder, read back."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def extended(df: DataFrame, columns: str) -> T.StructType:
    """The frame's schema with further columns, given as DDL; the frame's own schema object is left alone."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(columns).fields])


_SHIPPED: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Hands the package's code to Spark, which delivers it to every Python worker; once per application. The archive
    lies in the shared folder.

    Also keeps the Arrow batches between the JVM and the workers small: batches of long texts otherwise take tens of
    megabytes several times over. A limit that the session has set itself stays.
    """
    if spark.conf.get(_BATCH) in (None, "67108864b"):  # Spark's own default
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(fareframe.__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.join("fareframe", os.path.relpath(path, root)))
    target = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark, "code") + "/fareframe_llm.zip")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(target)
    out.write(bytearray(packed.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(target.makeQualified(files.getUri(), files.getWorkingDirectory()).toString())
    _SHIPPED.add(app)
