"""Command line: the steps of the note engine over files.

``python -m scrubwell build notes.csv out`` and so on; every step reads and writes folders that Spark can reach.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubwell import schemas
from scrubwell.logs import logger
from scrubwell.operators import concepts, corpus, mentions, placeholders, subsets, surrogates
from scrubwell.sources import readers, writers

HALVES = tuple(surrogates.SEEDS)


def build(spark: SparkSession, a: argparse.Namespace) -> None:
    """Notes (CSV) to the corpus with a text for each half and its flags."""
    corpus.built(readers.read_csv(spark, a.input, schemas.NOTE_EVENTS)).write.mode("overwrite").parquet(a.output)


def flags(spark: SparkSession, a: argparse.Namespace) -> None:
    """The corpus to halves with the membership flags of all subsets."""
    sizes = {**subsets.SIZES, **{c: int(n) for c, n in (x.split("=") for x in a.size)}}
    df = corpus.flagged_subsets(corpus.halved(spark.read.parquet(a.input)), sizes=sizes)
    df.write.mode("overwrite").partitionBy("half").parquet(a.output)


def split(spark: SparkSession, a: argparse.Namespace) -> None:
    """The halves to a CSV for each subset: its train and its test rows."""
    df = spark.read.parquet(a.input)
    for half in HALVES:
        for code in subsets.CODES:
            writers.write_csv(subsets.any_flag(df.filter(F.col("half") == half), code), writers.parameter_path(a.output, half=half, code=code))


def training_text(spark: SparkSession, a: argparse.Namespace) -> None:
    """The halves to training text, a folder for each half, subset and variant."""
    writers.write_training_text(corpus.training_sentences(spark.read.parquet(a.input), private=a.private), a.output)


def fill(spark: SparkSession, a: argparse.Namespace) -> None:
    """Texts (key, text) with placeholders filled from a map (placeholder, value; the last wins)."""
    texts = readers.read_csv(spark, a.input, schemas.INDEXED_TEXT, header=False)
    mapping = readers.read_csv(spark, a.map, schemas.SURROGATE_MAP, header=False).withColumn("ord", F.monotonically_increasing_id())
    writers.write_csv(placeholders.fill(texts, placeholders.last_wins(mapping.fillna("")), "ROW_ID", "TEXT", "filled").select("ROW_ID", "filled"), a.output, header=False)


def names(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    return readers.read_names(spark, a.first_names), readers.read_names(spark, a.last_names)


def find_mentions(spark: SparkSession, a: argparse.Namespace) -> None:
    """The halves to mentions of full names, one a subject, for each half and subset."""
    df, (first, last) = spark.read.parquet(a.input), names(spark, a)
    for half in HALVES:
        own = df.filter(F.col("half") == half)
        mapping = surrogates.rule_map(placeholders.distinct_placeholders(own, "TEXT"), surrogates.SEEDS[half], surrogates.context_keys(own, "TEXT"))
        for code in subsets.CODES:
            found = mentions.mention_chain(subsets.any_flag(own, code), mapping, first, last, "ROW_ID", "SUBJECT_ID", "TEXT")
            writers.write_tsv(found, writers.parameter_path(a.output, half=half, code=code))


GAZETTEER = "term string, cui string, preferred_name string, semtype string"
MENTIONS = "ROW_ID long, SUBJECT_ID long, full_name_mention string, patient_age string, patient_full_name string"


def gold(spark: SparkSession, a: argparse.Namespace) -> None:
    """Mentions and a gazetteer (term, cui, preferred name, semantic type) to gold diseases and gold names."""
    terms = readers.read_tsv(spark, a.gazetteer, GAZETTEER)
    found = concepts.gold_diseases(readers.read_tsv(spark, a.input, MENTIONS), terms, "ROW_ID", subject="SUBJECT_ID").withColumnRenamed("SUBJECT_ID", "subject_id")
    writers.write_tsv(found, f"{a.output}/diseases")
    writers.write_tsv(concepts.gold_names(found), f"{a.output}/names")


def predictions(spark: SparkSession, a: argparse.Namespace) -> None:
    """Samples (a line each) to the names and diseases in them."""
    first, last = names(spark, a)
    found = concepts.predictions(readers.read_lines(spark, a.input), readers.read_tsv(spark, a.gazetteer, GAZETTEER), first, last, a.skip_invalid_full_names)
    writers.write_tsv(found, a.output)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="scrubwell", description=__doc__.split("\n")[0])
    out.add_argument("--log", help="a file for the log")
    steps = out.add_subparsers(dest="step", required=True)
    more = {
        "build": (build, []), "flags": (flags, [("--size", {"action": "append", "default": [], "help": "code=rows, for other train sizes"})]), "split": (split, []),
        "training-text": (training_text, [("--private", {"default": "TEXT_WITH_DUMMY_PHI_HOSPITAL", "help": "the text column of the variant that isn't anonymised"})]),
        "fill": (fill, [("map", {})]), "mentions": (find_mentions, [("first_names", {}), ("last_names", {})]), "gold": (gold, [("gazetteer", {})]),
        "predictions": (predictions, [("gazetteer", {}), ("first_names", {}), ("last_names", {}), ("--skip-invalid-full-names", {"action": "store_true"})]),
    }
    for name, (f, arguments) in more.items():
        step = steps.add_parser(name, help=f.__doc__)
        step.add_argument("input")
        for flag, how in arguments:
            step.add_argument(flag, **how)
        step.add_argument("output")
        step.set_defaults(run=f)
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    log = logger(path=a.log)
    spark = spark or SparkSession.builder.appName(f"scrubwell {a.step}").getOrCreate()
    log.info("%s: %s -> %s", a.step, a.input, a.output)
    a.run(spark, a)
    log.info("%s: done", a.step)


if __name__ == "__main__":
    main()
