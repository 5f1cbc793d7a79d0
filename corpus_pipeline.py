"""The corpus pipeline: documents through five training-data operators, each stage written and reread.

What holds for every stage: it takes all rows that its predecessor kept, whole
texts included.  A null text counts as empty; a null doc_id, source or lang is a
value like any other; rows that are repeated are judged alike; very long texts are
handled whole; an empty table gives an empty result; columns beside doc_id, text
and source are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubwell.llm import mixing, packing, rule_ensemble, simhash, weak_rules
from scrubwell.llm.common import scratch_path, table
from scrubwell.llm.queries import OTHER_TARGET, TARGETS


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts; it learns from the labelled ones among them.

    Labels without a document, null labels and null ids are left out; of labels that
    disagree the better counts; without labels of both kinds every document has the
    same score.  Empty texts are scored from statistics of zero.
    """
    return rule_ensemble.keep_accepted(docs, rule_ensemble.train(docs, table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are probably good by the weighed votes.

    Null and empty texts fail the base rule and go.  Equal texts go or stay together.
    """
    return weak_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked by 0.8 or more of their five-word shingles.

    The least doc_id of a group stays, a null one only where there is no other; rows
    equal in doc_id and text are one document and all stay; empty texts are one group;
    a text of fewer than five words is one shingle.
    """
    return simhash.one_of_near(docs, similarity=0.8, shingle=5)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix to the target weights of the sources.

    Null sources are one source; sources without a target have OTHER_TARGET; rows
    equal in doc_id, text and all else follow each other.
    """
    return mixing.mixed(docs, targets=TARGETS, default=OTHER_TARGET)


def packed_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their bins: doc_id, piece, length, bin_id, capacity, offset.

    Pieces of equal length take their places in the order in which the documents were
    written, which is that of the mix; documents that are no files have no such order.
    Null and empty texts have no piece; repeated rows are packed separately.
    """
    ordered = "_written" + "_" * max(len(c) for c in docs.columns)  # a free name
    try:
        file = docs.metadataColumn("_metadata")
        number = F.regexp_extract(file["file_name"], r"^part-([0-9]+)", 1).try_cast("long")
        docs = docs.select("*", F.struct(number, file["file_name"], file["row_index"]).alias(ordered))
    except AnalysisException:
        return packing.packed(docs)
    return packing.packed(docs, order=ordered)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("simhash", near_duplicates),
    ("pfair_mix", source_mix),
    ("best_fit", packed_bins),
]

#: The stages train models and iterate; SQL can't say that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
