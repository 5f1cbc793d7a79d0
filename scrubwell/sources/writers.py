"""Sinks: CSV, TSV, parquet, and training text partitioned by half, subset and variant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubwell.sources.shared import lean

#: Folders that a task writes side by side; only with more of them its rows are sorted by folder.
FOLDERS = 64
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",", append: bool = False) -> None:
    # blanks at the ends of values are data ("Physician "), which the writer would trim by default
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("append" if append else "overwrite").options(header=header, sep=sep, quote='"', escape='"', **kept).csv(path)


def write_tsv(df: DataFrame, path: str, header: bool = True, append: bool = False) -> None:
    write_csv(df, path, header, "\t", append)


def write_training_text(df: DataFrame, path: str, text: str = "sentence", by: tuple[str, ...] = ("half", "code", "anonymity"), append: bool = False, packed: bool = False) -> None:
    """One line a row, in folders named by ``by``, as gzip files if ``packed``; line breaks inside a row become spaces."""
    line = F.coalesce(F.col(text), F.lit(""))
    line = F.when(line.contains("\n") | line.contains("\r"), F.regexp_replace(line, r"[\r\n]+", " ")).otherwise(line)
    conf = df.sparkSession.conf
    before = conf.get(_WRITERS, "0")
    conf.set(_WRITERS, str(FOLDERS))
    try:
        with lean(df.sparkSession):
            df.select(*by, line.alias("value")).write.mode("append" if append else "overwrite").partitionBy(*by).text(path, compression="gzip" if packed else None)
    finally:
        conf.set(_WRITERS, before)


def parameter_path(base: str, **parameters: object) -> str:
    """A folder that names its parameters, so that readers of ``base`` get them back as columns."""
    return "/".join([base.rstrip("/"), *(f"{k}={v}" for k, v in parameters.items())])
