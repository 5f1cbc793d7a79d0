"""A surrogate map that a stream of entries keeps up: for each placeholder the last order wins.

Spark keeps the last entry of each placeholder as state, and each micro-batch writes
the placeholders that it changed into a folder named by query and batch.  A batch that
is replayed after a failure writes its folder anew, so nothing counts twice; entries
that come late or again change nothing, because the greatest order wins whenever it
comes.  The map is what the folders say together; :func:`compacted` puts them into one
for readers, and a ledger of finished batches says which folders count.

Defined results: null placeholders are left out; of equal orders the greater value
wins; an empty stream leaves an empty map.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "placeholder string, dummy_phi string, ord long"


def latest(entries: DataFrame) -> DataFrame:
    """placeholder, dummy_phi, ord: the entry of the greatest order; on a stream the state of each placeholder."""
    last = F.max(F.struct("ord", "dummy_phi")).alias("x")
    return entries.filter("placeholder IS NOT NULL").groupBy("placeholder").agg(last).select("placeholder", "x.dummy_phi", "x.ord")


def keep_up(entries: DataFrame, path: str, checkpoint: str, **trigger):
    """Starts the query that keeps the map under ``path`` up; ``trigger``: as of writeStream, all there is by default."""

    def write(batch: DataFrame, number: int) -> None:
        # the query's id stays over restarts from its checkpoint, a new checkpoint has a new one
        name = f"query={query_id(batch.sparkSession, checkpoint)}/batch={number}"
        batch.write.mode("overwrite").parquet(f"{path}/changes/{name}")
        done = batch.sparkSession.range(1).select(F.lit(name).alias("folder"))
        done.coalesce(1).write.mode("overwrite").json(f"{path}/ledger/{name}")

    return latest(entries).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id in a checkpoint's metadata."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]


def current(spark: SparkSession, path: str) -> DataFrame:
    """placeholder, dummy_phi, ord of the batches that the ledger names."""
    ledger = spark.read.schema("folder string").option("recursiveFileLookup", True).json(f"{path}/ledger")
    rows = spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{path}/changes")
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"(query=[^/]+/batch=[0-9]+)/[^/]*$", 1)
    return latest(rows.withColumn("folder", folder).join(ledger.distinct(), "folder", "left_semi"))


def compacted(spark: SparkSession, path: str, into: str) -> DataFrame:
    """The map as one table in a new folder; what the stream writes afterwards is read beside it by order."""
    current(spark, path).write.parquet(into)
    return spark.read.parquet(into)
