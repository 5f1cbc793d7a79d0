"""Seeded orders and global row numbers without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def seeded(key: Column, seed: int) -> Column:
    """The order of a seeded shuffle: md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def draw(key: Column, seed: int, n: int) -> Column:
    """A number from 0 to n - 1 that key and seed decide."""
    return F.pmod(F.conv(F.substring(seeded(key, seed), 1, 8), 16, 10).cast("bigint"), F.lit(n))


def global_rank(df: DataFrame, hashed: str, key: str, out: str, by: list[str] | None = None, digits: int = 3) -> DataFrame:
    """Row number from 1 in the order of (hashed, key), within ``by`` if given.

    ``hashed`` is a hexadecimal hash, so its first ``digits`` digits deal the rows
    evenly over 16^digits windows; the rows before each of them come from a table
    of as many counts (for each ``by``), so no task sees the whole input.  Three
    digits do for a billion rows, four (65,536 counts) for ten and more.
    """
    by = by or []
    df = df.withColumn("_b", F.substring(hashed, 1, digits))
    counts = df.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(*by, "_b", (F.sum("_n").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_b")) - F.col("_n")).alias("_before"))
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by, "_b").orderBy(hashed, key)))
    if not by:
        counts = F.broadcast(counts)
    return ranked.join(counts, [*by, "_b"]).withColumn(out, F.col("_before") + F.col("_rn")).drop("_b", "_n", "_before", "_rn")
