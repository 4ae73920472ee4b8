"""A corpus through five stages: quality, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, which is written as Parquet and read again for the next one;
all but the last return the columns of documents. run() applies them to the documents table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagelab.llm import common, decontaminate, neardup, packing, pii, quality


def _sized(df: DataFrame) -> DataFrame:
    """n_chars anew, after texts have changed."""
    return df.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in df.columns else df


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the bounded sample of labelled documents outside the held-out fold.

    Null and empty texts are scored as texts without words; null ids and repeated rows are rows like others; long texts are scored
    whole; an empty table stays empty."""
    model = quality.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates.

    Null and empty texts are copies of each other, and so are repeated rows, of which one stays; null ids are kept last; long texts
    are compared whole; an empty table stays empty."""
    return neardup.without_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that they share with the benchmark; those that are half benchmark go as a whole.

    Null texts stay null; null ids and repeated rows are rows like others; long texts are cleaned whole; empty tables of either kind
    change nothing."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _sized(decontaminate.decontaminated(docs, benchmark, max_coverage=0.5))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by marks.

    Null texts stay null; null ids and repeated rows are rows like others; long texts are read whole; an empty table stays empty."""
    return _sized(pii.redacted(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of 2048.

    A null text gives its end id; null ids and repeated rows are packed like others; long texts are cut to sequences; an empty
    table gives none."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: Shingle classes, a trained classifier and a tokenizer's ids aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
