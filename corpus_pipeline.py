"""The corpus pipeline: classify, drop copies and near copies, decontaminate, pack.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the
last return the columns of documents, and further columns, whatever their names, as they came.

Common to all stages: a null text counts as an empty one; rows without a ``doc_id`` are kept unless
their own text condemns them; an empty table gives an empty result; repeated rows are rows like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from codeloom.llm.common import small_batches, stored, table

#: Percentage of common five-word shingles from which the pipeline takes documents for near copies.
NEAR_PERCENT = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the labelled sample, does not reject.

    Without labels, or with those of one grade only, all documents share the prior's verdict.
    """
    small_batches(spark)
    return quality.keep_selected(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the smallest identifier; null and blank texts are one group."""
    small_batches(spark)
    return exact_dedup.keep_one_of_each(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest identifier of each component of near duplicates; documents without words or identifier stay."""
    small_batches(spark)
    return near_dedup.keep_one_of_each_group(docs, percent=NEAR_PERCENT)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate; an empty benchmark lets all pass.

    Of rows that share an identifier, all go when one of them is contaminated.
    """
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents left, with their places in sequences; an empty text is its end token alone."""
    small_batches(spark)
    return packing.best_fit_packing(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("best-fit packing", packing_stage),
]

#: SQL cannot fit the classifier, draw the sketches' buckets or run the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is kept as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
