"""What several operators share: tables, shared folder, lineage cuts, ranks."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The white space that separates words, as a Java/RE2/Python character class.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, a temporary one in local mode (tests), else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="scrubwell-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise a compact table in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Whether Spark removes an execution's shuffle files when it ends, rather than when the driver's garbage is collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Executions that begin inside lose their shuffles when they end.  For what is written into the shared folder: nothing reads those shuffles again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def lean_cut(df: DataFrame) -> DataFrame:
    """As :func:`cut`, and the shuffles that led to the table go at once."""
    shared_dir(df.sparkSession)
    with lean(df.sparkSession):
        return df.select("*").checkpoint()  # a new execution, which takes the setting


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def fence() -> Column:
    """A column that, named in a filter, keeps the optimizer from copying costly expressions into it."""
    return F.monotonically_increasing_id()


def held(df: DataFrame, condition: Column, name: str = "_fence") -> DataFrame:
    """``df.filter(condition)``, evaluated above ``df``'s projection and not inside it."""
    return df.withColumn(name, fence()).filter(condition & (F.col(name) >= 0)).drop(name)


def salted_rank(df: DataFrame, keys: list[str], order: list[str], out: str, rows_per_task: int = 250_000) -> DataFrame:
    """Adds a gapless rank from 0 within ``keys``; a key with most of the rows is ranked by many tasks.

    Rows are dealt into hash buckets of the ``order`` columns, numbered inside
    (key, bucket), and shifted by the number of rows in the key's earlier buckets.
    ``keys`` must not be null.  ``df`` is read twice, so it should be materialised.
    """
    total = df.count()
    buckets = max(64, -(-total // rows_per_task))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    both = [*keys, "_bucket"]
    before = (
        df.groupBy(*both).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket")) - F.col("_n"))
        .drop("_n")
    )
    numbered = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*both).orderBy(*order)))
    return numbered.join(before, both).withColumn(out, F.col("_before") + F.col("_rn") - 1).drop("_bucket", "_before", "_rn")


def copies(df: DataFrame, n: str, out: str, chunk: int = 4_096) -> DataFrame:
    """Each row ``n`` times, numbered from 0 in ``out``; a row with very many copies is written by many tasks."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"cast(({n} - 1) div {chunk} as bigint)")))
    parts = df.withColumn("_chunk", at).repartition(*[F.col(c) for c in df.columns], "_chunk")
    upto = F.least(F.col(n).cast("long"), (F.col("_chunk") + 1) * chunk) - 1
    return parts.withColumn(out, F.explode(F.sequence(F.col("_chunk") * chunk, upto))).drop("_chunk")


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A driver-made table whose size the caller bounds, marked for broadcast; a literal, so no Python runs on executors."""
    fields = [x.split() for x in schema.split(", ")]
    text = json.dumps([dict(zip((n for n, _ in fields), r, strict=True)) for r in rows])
    kind = f"array<struct<{', '.join(f'{n}: {t}' for n, t in fields)}>>"
    return F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(text), kind))))


def ordinals(df: DataFrame, by: str, order: list[str], out: str, total: str | None = None) -> DataFrame:
    """Adds a gapless number from 0 within ``by``, in the order of ``order`` (nulls first), and the number of its rows.

    The rows are dealt into ranges of (by, order), which follow each other; each range
    is written to the shared folder with its number.  A window counts inside (by,
    range) and a table of one count for each of those says what lies before, so a
    value of ``by`` that holds most rows is numbered by many tasks.  ``by`` must not be
    null.  Rows equal in ``by`` and ``order`` are told apart by their place in the input.
    """
    tie, span = "_tie", [by, *order, "_tie"]
    path = scratch_path(df.sparkSession, "ordered")
    with lean(df.sparkSession):
        df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*span).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    whole = Window.partitionBy(by)
    counts = rows.groupBy(by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(by, "_range", (F.sum("_n").over(whole.orderBy("_range")) - F.col("_n")).alias("_before"), *([F.sum("_n").over(whole).alias(total)] if total else []))
    rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(by, "_range").orderBy(*order, tie)))
    return rows.join(counts, [by, "_range"]).withColumn(out, F.col("_before") + F.col("_rn") - 1).drop("_range", "_before", "_rn", tie)
