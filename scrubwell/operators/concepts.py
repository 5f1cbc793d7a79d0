"""Concepts in text: a gazetteer in place of an external extractor, surfaces, stop words, gold tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubwell.operators.mentions import keep_first, predicted_names

#: Surfaces that are never a disease, and the semantic types that are.
NOT_DISEASES = ["was", "IV", "arms", "call", "NS", "NC", "a, o", "this"]
DISEASE_TYPES = ["dsyn", "mobd", "neop"]
#: A gazetteer of up to so many terms is broadcast.
BROADCAST_ROWS = 500_000


def positions(pos_info: Column) -> Column:
    """``start/length`` pairs as structs."""
    whole = F.regexp_extract_all(pos_info, F.lit("([0-9]+)/([0-9]+)"), F.lit(0))
    return F.transform(whole, lambda x: F.struct(F.substring_index(x, "/", 1).cast("int").alias("start"), F.substring_index(x, "/", -1).cast("int").alias("len")))


def surfaces(sentence: Column, pos_info: Column) -> Column:
    return F.transform(positions(pos_info), lambda p: F.substring(sentence, p["start"], p["len"]))


def valid(superficials: Column) -> Column:
    return ~F.arrays_overlap(superficials, F.array(*[F.lit(x) for x in NOT_DISEASES]))


def gazetteer_matches(texts: DataFrame, gazetteer: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, the gazetteer's columns, n: words of the text that are in the gazetteer (term, cui, preferred_name, semtype)."""
    words = texts.select(key, F.explode(F.split(F.lower(text), "[^a-z]+")).alias("term")).filter("term <> ''")
    known = gazetteer.select("term").distinct()
    if known.count() <= BROADCAST_ROWS:  # most words go before any shuffle
        words = words.join(F.broadcast(known), "term", "left_semi")
    return words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n")).join(gazetteer, "term")


def extracted(texts: DataFrame, key: str, text: str, extract: Callable[[str], list[tuple]]) -> DataFrame:
    """``key``, pos, kind, cui, preferred_name, semtype, score, superficials: what an outside extractor finds in each text.

    ``extract`` takes a text and gives (kind, cui, preferred name, semantic type,
    score, surfaces) for each concept.  An IndexError, which such tools raise at
    invalid characters, stands for no concept.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b["_key"], b["_text"], strict=True):
                try:
                    found = extract(t)
                except IndexError:
                    found = []
                rows += [(k, pos, *x) for pos, x in enumerate(found)]
            yield pd.DataFrame(rows, columns=[key, "pos", "kind", "cui", "preferred_name", "semtype", "score", "superficials"])

    kind = dict(texts.dtypes)[key]
    return texts.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInPandas(run, f"{key} {kind}, pos int, kind string, cui string, preferred_name string, semtype string, score double, superficials array<string>")


def of_kind(found: DataFrame, kind: str = "MMI") -> DataFrame:
    """Only concepts of the kind that names positions; others are skipped."""
    return found.filter(F.col("kind") == kind)


def gold_diseases(chain: DataFrame, gazetteer: DataFrame, key: str, mention: str = "full_name_mention", subject: str = "subject_id") -> DataFrame:
    """A row for each mention and concept of a disease type, with the subject, its name and age, and the surfaces joined by commas."""
    found = gazetteer_matches(chain, gazetteer, key, mention).filter(F.col("semtype").isin(DISEASE_TYPES))
    found = found.groupBy(key, "cui", "preferred_name", F.col("semtype").alias("semtypes")).agg(F.array_join(F.array_sort(F.collect_list("term")), ", ").alias("superficials"), F.sum("n").alias("score"))
    return found.join(chain, key).select(F.col(key).alias("document_id"), subject, "patient_full_name", F.col("patient_age").alias("patiant_age"), "superficials", "semtypes", "score", "cui", "preferred_name", mention)


def gold_names(diseases: DataFrame, mention: str = "full_name_mention", subject: str = "subject_id") -> DataFrame:
    """The first document of each full name that has a disease."""
    return keep_first(diseases.select("document_id", subject, "patient_full_name", mention), ["patient_full_name"], ["document_id"])


def predictions(samples: DataFrame, gazetteer: DataFrame, first: DataFrame, last: DataFrame, skip_invalid: bool = False) -> DataFrame:
    """patient_full_name, cui, preferred_name, sample_index, is_valid_full_name: the diseases of every sample that names someone."""
    named = predicted_names(samples, first, last, skip_invalid=skip_invalid)
    found = gazetteer_matches(samples.join(named.select("sample_index"), "sample_index", "left_semi"), gazetteer, "sample_index", "text")
    found = found.filter(F.col("semtype").isin(DISEASE_TYPES)).select("sample_index", "cui", "preferred_name").distinct()
    return found.join(named, "sample_index").select("patient_full_name", "cui", "preferred_name", "sample_index", "is_valid_full_name")


def gold(matches: DataFrame, key: str) -> DataFrame:
    """One row for each text and concept of a disease type, its surfaces joined by commas."""
    return matches.filter(F.col("semtype").isin(DISEASE_TYPES)).groupBy(key, "cui", "preferred_name").agg(F.array_join(F.array_sort(F.collect_list("term")), ", ").alias("superficials"), F.sum("n").alias("score"))
