"""The corpus pipeline: quality, exact copies, near copies, mixing by source, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet and read again as the next
stage's documents.  All stages but the last return the columns of ``documents``.  A document that the mix repeats is one
row for each time it is taken, so packing sees it as often.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import exact_dedup, jaccard_join, mixing, packing, quality
from panelspark.llm.common import fresh_names, stage
from panelspark.llm.queries import crc_of_id, vocabulary

THRESHOLD = 0.5


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at the threshold or more; fitted on labels of two thirds of the ids."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, learnable=crc_of_id("label_id") % 3 != 1)
    score, = fresh_names(docs, "__score")
    return quality.scored(docs, model, score).where(F.col(score) >= THRESHOLD).drop(score)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text that is equal after lower-casing A-Z: the one with the smallest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word Jaccard similarity 0.75 or more."""
    return jaccard_join.drop_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those it does not take go."""
    return mixing.mixed_documents(docs, F.array("source"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=1, crc=True)


STAGES = [("quality_filter", quality_filter), ("exact_copies", exact_copies), ("near_copies", near_copies),
          ("source_mix", source_mix), ("pack", pack)]

#: The classifier is trained, which SQL does not express.  tests/llm/test_pipeline_brute.py holds exact and near copies
#: against plain Python, mixing and packing against what they promise.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
