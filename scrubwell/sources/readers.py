"""Sources: CSV with quoted line breaks, header-less CSV, TSV, text lines, tagged XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scrubwell.sources import split_csv

PHI_TYPES = ["AGE", "DATE", "DOCTOR", "HOSPITAL", "ID", "LOCATION", "PATIENT", "PHONE"]


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True, sep: str = ",", blocks: bool = True) -> DataFrame:
    """Quoted, multi-line CSV or TSV; an empty field is null, quoted or not.

    With ``blocks`` a file is read by as many tasks as it has blocks
    (:mod:`scrubwell.sources.split_csv`), else by one, which needs one scan instead of two.
    """
    if not blocks:
        return spark.read.schema(schema).options(header=header, sep=sep, multiLine=True, quote='"', escape='"').csv(path)
    return split_csv.read(spark, path, T.StructType.fromDDL(schema) if isinstance(schema, str) else schema, header, sep)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True, blocks: bool = True) -> DataFrame:
    return read_csv(spark, path, schema, header, "\t", blocks)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string").csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """sample_index, text: lines with their number in the order of files (by path) and of their lines.

    Numbered in parallel: a block of a file is read by one task, so its lines have
    consecutive ids; the lines of earlier blocks come from a table with a row for
    each block (a million in 100 TB), which one window sees.
    """
    block = ["_path", "_start"]
    df = spark.read.text(path).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    blocks = df.groupBy(*block).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy(*block)) - F.col("_n")
    return df.join(blocks.select(*block, "_first", before.alias("_before")), block).select((F.col("_before") + F.col("_id") - F.col("_first")).alias("sample_index"), "text")


def extract_tags(df: DataFrame, text: str, types: list[str] = PHI_TYPES) -> DataFrame:
    """tag, value of each ``<PHI TYPE="T">value</PHI>`` span."""
    kinds = "|".join(types)
    spans = F.regexp_extract_all(F.col(text), F.lit(f'<PHI TYPE="(?:{kinds})">[^<]*</PHI>'), F.lit(0))
    df = df.select(F.explode(spans).alias("span"))
    return df.select(F.regexp_extract("span", '<PHI TYPE="([A-Z]+)">', 1).alias("tag"), F.regexp_extract("span", ">([^<]*)<", 1).alias("value"))
