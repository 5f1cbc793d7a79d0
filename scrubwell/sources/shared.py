"""The folder that driver and executors share, for what a query writes and rereads."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset, under a temporary folder in local mode (tests), else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="scrubwell-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Shuffles that lead to what is written inside go when it is written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def lean_kept(df: DataFrame, what: str) -> DataFrame:
    """``df`` from a new path, tightly packed; the shuffles that led to it go when it is written."""
    with lean(df.sparkSession):
        df.select("*").write.option("compression", "zstd").parquet(path := shared_path(df.sparkSession, what))
    return df.sparkSession.read.parquet(path)
