"""The note functions on a stream: stateless, so each batch or micro-batch is treated alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubwell.functions.cleaning import clean
from scrubwell.functions.dates import backdate, resolve, year_shift
from scrubwell.operators.placeholders import all_filled


def prepared(notes: DataFrame, text: str = "TEXT") -> DataFrame:
    """Adds ``prepared`` (cleaned, dates resolved and shifted) and ``all_filled``; works for batch and stream."""
    df = notes.withColumn("_t", resolve(clean(F.col(text)))).withColumn("_s", year_shift(F.col("_t")))
    return df.withColumn("prepared", backdate(F.col("_t"), F.col("_s"))).withColumn("all_filled", all_filled(F.col("prepared"))).drop("_t", "_s")


def append_batches(stream: DataFrame, path: str, checkpoint: str):
    """Writes a stream of prepared notes as parquet, appended batch by batch."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
