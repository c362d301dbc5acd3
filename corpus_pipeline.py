"""The corpus pipeline: STAGES over documents, each on the whole of what the one before kept.

Every stage but the last returns the columns of documents; what a stage returns is written as Parquet and read again,
so lineage ends there and a lost executor costs the tasks of one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from helixmill.llm import langid, packing, quality, similar, suffix
from helixmill.llm.common import forget, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: failing lines go, and so do the documents that it rejects."""
    return quality.cleaned(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7, learnt from the labelled documents that are not held out: documents without a language, or less like
    theirs than the calibrated limit, go."""
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4 over sets of five-word shingles at similarity 0.8: the document of the smallest doc_id of each group of
    near-duplicates stays."""
    return similar.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: bytes covered by 50-byte strings of a document with a smaller doc_id go."""
    return suffix.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the pieces of all documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", pack),
]
#: Language models, fingerprints and tokens can't be expressed in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{k}")
            forget(*before)
            before = [docs]
    forget(*before)  # the last stage has written its pieces
    return docs
