"""The corpus pipeline: quality, exact and near duplicates, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and read
back as the next stage's ``docs``. All but the last return the columns of ``documents``.

In every stage a null text is an empty one, texts of any length are read whole, an empty table
gives an empty result, and columns of any further name are kept. What a stage does with ids,
repeated rows and ties is stated with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from repolytics.llm import decontam, exact_dedup, minhash, packing, quality
from repolytics.llm.queries import vocabulary
from repolytics.llm.registry import table
from repolytics.llm.shared import written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier accepts; it is fitted on the labelled rows among ``docs``.

    Rows are judged one by one: repeated rows stay or go together, a null id is never a labelled
    row. A score equal to the threshold is accepted; without any label every row is.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id.

    A null id is smaller than any other. Of rows that share text and id the one whose other columns
    are largest stays.
    """
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked on five-word shingles at 0.8 or more, the one with the smallest id.

    Documents without words and rows without id are linked with nothing and stay. Rows that share an id
    stay or go together.
    """
    return minhash.keep_one(docs, spec=minhash.NearDup(width=5, percent=80))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not cover a test item to 0.6 or more; repeated rows stay or go together."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 1024 tokens.

    An empty text is its end token. Repeated rows are packed as documents of their own under one id; which of
    several pieces of one length goes to which sequence follows the order in which tasks read them.
    """
    return packing.pack(docs, vocabulary(), end=0, window=1024)


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminated),
    ("packing", packed),
]

# a fitted classifier and a least-squares plan are beyond SQL: tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
