"""Name books: weights, merged popularity, vocabulary, products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalised(names: DataFrame, weight: str = "weight") -> DataFrame:
    """Weights that sum to 1 (a total in one row, broadcast; no global window)."""
    total = names.agg(F.sum(weight).alias("_total"))
    return names.crossJoin(F.broadcast(total)).withColumn(weight, F.col(weight) / F.col("_total")).drop("_total")


def merged(female: DataFrame, male: DataFrame) -> DataFrame:
    """name, weight: both sexes' popularity, half each; a missing name counts 0."""
    both = normalised(female).unionByName(normalised(male))
    return both.groupBy("name").agg((F.sum("weight") * 0.5).alias("weight"))


def in_vocab(names: DataFrame) -> DataFrame:
    return names.filter("n_tokens = 1")


def with_vocab_ids(names: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The names that are one token of ``vocabulary`` (token, vocab_id), with its id; case doesn't count."""
    return names.join(vocabulary.select(F.lower("token").alias("_t"), "vocab_id"), F.lower(names["name"]) == F.col("_t")).drop("_t")


def products(first: DataFrame, last: DataFrame) -> DataFrame:
    """All first with all last names, and the product of their weights: as many rows as the two (small) books multiply to."""
    return first.select(F.col("name").alias("first_name"), F.col("weight").alias("_w")).crossJoin(last.select(F.col("name").alias("last_name"), F.col("weight").alias("_v"))).select("first_name", "last_name", (F.col("_w") * F.col("_v")).alias("weight"))


def popularity(queries: DataFrame, first: DataFrame, last: DataFrame, name: str = "full_name") -> DataFrame:
    """Adds popularity: product of both names' weights, a star standing for any name."""
    parts = F.split(name, " ")
    df = queries.withColumns({"_f": parts[0], "_l": F.get(parts, 1)})
    df = df.join(first.select(F.col("name").alias("_f"), F.col("weight").alias("_fw")), "_f", "left").join(last.select(F.col("name").alias("_l"), F.col("weight").alias("_lw")), "_l", "left")
    one = lambda n, w: F.when(F.col(n) == "*", F.lit(1.0)).otherwise(F.col(w))
    return df.withColumn("popularity", one("_f", "_fw") * one("_l", "_lw")).drop("_f", "_l", "_fw", "_lw")
