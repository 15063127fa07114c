"""Folders for what jobs write between their steps."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the session's shared checkpoint folder, or under its warehouse where that is unset.

    Every session has a warehouse folder, and all machines of a cluster share it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        shared = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/fareframe-scratch"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
