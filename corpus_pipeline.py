"""Corpus pipeline: quality, near duplicates, benchmark leaks, personal data, packing.

Each stage takes the documents that the one before kept, written as Parquet and read again. All but the last
return documents with their own columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from partgraph.llm import classifier, decontam, near, packing, pii
from partgraph.llm.common import Scratch, read, tune

#: The 85 of op7 is its own contract.
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return classifier.accept(docs, classifier.fit(docs, read(tune(spark), sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: similarity of word shingles from NEAR_PERCENT."""
    return near.one_of_each(docs, Scratch(tune(spark), "pipeline-near"), NEAR_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontam.without_leaks(docs, read(tune(spark), sf_dir, "benchmark"), Scratch(spark, "pipeline-leaks"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    tune(spark)
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of one window."""
    tune(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mask_pii", mask_pii), ("pack", pack)]

#: SQL can't train the classifier; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch, docs = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        docs = kept if i == len(STAGES) - 1 else scratch.save(kept, name)
    return docs
