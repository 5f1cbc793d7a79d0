"""Full-name mentions, gold tables, and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrubwell.functions.names import name_frequency, patient_info, predicted_name, titled


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row by ``order`` of each key (a partial aggregate, so a hot key doesn't meet in one task)."""
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_x"))
    return packed.select(*keys, "_x.*").select(*df.columns)


def with_names(notes: DataFrame, mapping: DataFrame, text: str, n_sentences: int = 5) -> DataFrame:
    """Adds full_name_mention, placeholders, patient_age, patient_full_name and its frequency in the text."""
    df = notes.withColumn("_i", patient_info(F.col(text), n_sentences)).select("*", "_i.*").drop("_i")
    for which in ("first", "last"):
        names = mapping.select(F.col("placeholder").alias(f"{which}_name_placeholder"), F.col("dummy_phi").alias(f"_{which}"))
        df = df.join(names, f"{which}_name_placeholder", "left")
    full = F.concat(F.coalesce("_first", F.lit("")), F.lit(" "), F.coalesce("_last", F.lit("")))
    freq = name_frequency(F.col(text), F.col("first_name_placeholder"), F.col("last_name_placeholder"))
    return df.withColumns({"patient_full_name": full, "patient_full_name_tfreq": freq}).drop("_first", "_last")


def mention_chain(notes: DataFrame, mapping: DataFrame, first: DataFrame, last: DataFrame, key: str, subject: str, text: str, n_sentences: int = 5) -> DataFrame:
    """Notes that name their patient, one for each different mention, with both names in the vocabulary, one for each subject; the first by ``key`` each time."""
    df = with_names(notes.select(key, subject, text), mapping, text, n_sentences).filter("patient_full_name_tfreq > 0")
    df = keep_first(df.select(key, subject, "full_name_mention", "patient_age", "patient_full_name"), ["full_name_mention"], [key])
    return keep_first(in_vocabulary(df, first, last, "patient_full_name"), [subject], [key])


def in_vocabulary(df: DataFrame, first: DataFrame, last: DataFrame, name: str) -> DataFrame:
    """Rows whose first and last name both are single-token names."""
    df = df.withColumns({"_f": F.substring_index(name, " ", 1), "_l": F.substring_index(name, " ", -1)})
    df = df.join(first.select(F.col("name").alias("_f")), "_f", "left_semi").join(last.select(F.col("name").alias("_l")), "_l", "left_semi")
    return df.drop("_f", "_l")


def predicted_names(samples: DataFrame, first: DataFrame, last: DataFrame, text: str = "text", skip_invalid: bool = False) -> DataFrame:
    """sample_index, patient_full_name, is_valid_full_name of the samples that name someone."""
    df = samples.select("sample_index", titled(predicted_name(F.col(text))).alias("patient_full_name")).filter(F.col("patient_full_name").isNotNull())
    parts = F.split("patient_full_name", " ")
    df = df.withColumns({"_f": F.when(F.size(parts) == 2, parts[0]), "_l": F.when(F.size(parts) == 2, F.get(parts, 1))})
    for c, names in (("_f", first), ("_l", last)):
        df = df.join(names.select(F.col("name").alias(c)).distinct().withColumn(f"{c}ok", F.lit(True)), c, "left")
    df = df.withColumn("is_valid_full_name", F.coalesce(F.col("_fok") & F.col("_lok"), F.lit(False)))
    df = df.filter("is_valid_full_name") if skip_invalid else df
    return df.select("sample_index", "patient_full_name", "is_valid_full_name")


def round_robin(items: DataFrame, prompts: DataFrame, n_prompts: int) -> DataFrame:
    """Item i gets prompt i mod n; few prompts are broadcast."""
    prompts = F.broadcast(prompts) if n_prompts <= 100_000 else prompts
    return items.join(prompts, F.pmod(items["item"], F.lit(n_prompts)) == prompts["prompt_index"])


def first_by_window(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """As :func:`keep_first`, for rows that can't be packed into a struct."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")
