"""Disjoint halves and size- or diversity-limited train/test subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrubwell.operators.ranking import global_rank, seeded

#: Subset codes, and sizes of their train sides.
CODES = {"c1p2": "1M", "c0p2": "100k_less_c_div", "c1p1": "100k_less_p_div", "c1p0": "10k_least_p_div", "c0p1": "10k_less_c_less_p_div", "c0p0": "1k_less_c_least_p_div"}
SIZES = {"c1p2": 1_000_000, "c0p2": 100_000, "c1p1": 100_000, "c1p0": 10_000, "c0p1": 10_000, "c0p0": 1_000}
CATEGORIES = ["Physician ", "Discharge summary"]


def shuffled(df: DataFrame, key: str, seed: int, out: str = "rn") -> DataFrame:
    """Row number in a seeded shuffle."""
    return global_rank(df.withColumn("_hash", seeded(F.col(key), seed)), "_hash", key, out).drop("_hash")


def half_split(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Adds ``half``: hospital for the first half of a seeded shuffle, shadow for the rest."""
    n = df.groupBy().count()
    return shuffled(df, key, seed).crossJoin(F.broadcast(n)).withColumn("half", F.when(F.col("rn") <= F.floor(F.col("count") / 2), "hospital").otherwise("shadow")).drop("rn", "count")


def train_test(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """Adds in_train (the first ``size`` of a seeded shuffle) and in_test (the rest)."""
    return shuffled(df, key, seed).withColumns({"in_train": F.col("rn") <= size, "in_test": F.col("rn") > size}).drop("rn")


def rare_cutoff(df: DataFrame, subject: str, wanted: int, row: str) -> DataFrame:
    """threshold, n_patients, n_docs: see :func:`rare_cutoffs`."""
    return rare_cutoffs(df, subject, [wanted], row).drop("wanted")


def rare_cutoffs(df: DataFrame, subject: str, wanted: list[int], row: str) -> DataFrame:
    """wanted, threshold, n_patients, n_docs: the largest count of rows per subject whose subjects still hold more than ``wanted`` rows.

    -1 and the totals where all rows are not more than ``wanted``.  One aggregation
    for all sizes; the window runs over the histogram of counts.
    """
    per = df.filter(F.col(subject).isNotNull()).groupBy(subject).agg(F.count(row).alias("n"))
    hist = per.groupBy("n").agg(F.sum("n").alias("docs"), F.count(F.lit(1)).alias("patients"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.select("n", F.sum("docs").over(w).alias("cd"), F.sum("patients").over(w).alias("cp"))
    each = cum.withColumn("wanted", F.explode(F.array(*[F.lit(n).cast("long") for n in wanted])))
    over = F.max(F.when(F.col("cd") > F.col("wanted"), F.struct("n", "cp", "cd")))
    return each.groupBy("wanted").agg(over.alias("x"), F.max("cp").alias("p"), F.max("cd").alias("d")).select("wanted", F.coalesce("x.n", F.lit(-1)).cast("long").alias("threshold"), F.coalesce("x.cp", "p").cast("long").alias("n_patients"), F.coalesce("x.cd", "d").cast("long").alias("n_docs"))


def frequent_subjects(df: DataFrame, subject: str, wanted: int, row: str) -> DataFrame:
    """The rows of subjects with at least as many rows as the cut-off."""
    cut = rare_cutoff(df, subject, wanted, row)
    per = df.filter(F.col(subject).isNotNull()).groupBy(subject).agg(F.count(row).alias("_n"))
    ok = per.join(F.broadcast(cut), F.col("_n") >= F.col("threshold")).select(subject)
    return df.join(ok, subject, "left_semi")


def in_categories(column: str, categories: list[str] = CATEGORIES) -> Column:
    return F.col(column).isin(categories)


def flagged(df: DataFrame, flags: dict[str, DataFrame], key: str) -> DataFrame:
    """Adds a boolean for each name: whether the key is in that table."""
    for name, ids in flags.items():
        df = df.join(ids.select(F.col(key)).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return df


def any_flag(df: DataFrame, code: str) -> DataFrame:
    """The rows of a subset, train or test."""
    return df.filter(F.col(f"in_train_{CODES[code]}") | F.col(f"in_test_{CODES[code]}"))
