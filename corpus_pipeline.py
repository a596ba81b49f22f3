"""The corpus pipeline: toxicity, quality, near-duplicates, benchmark leaks, packing; each stage's result is written and reread.

All stages take null ids, null, empty and very long texts, repeated rows, empty tables and further columns, which all
but the last keep. What becomes of them is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chartwright.llm import decontaminate, quality, simhash, toxicity
from chartwright.llm.common import discard, materialize, read_table
from chartwright.llm.queries import packed_digest


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labelled ones among them, doesn't find toxic. Null and empty texts
    stay; repeated rows go or stay alike."""
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling, as many as the labels' share of target documents. Null and empty texts
    have weight 1; rows of one id and text are drawn alike; ties with the last key stay."""
    return quality.keep_sampled(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each SimHash class; one row where an id or a null repeats. Null and empty texts are a
    class."""
    return simhash.keep_representatives(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; null and empty texts stay."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in windows of 1024 tokens; a null or empty text has its end only."""
    return packed_digest(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]
#: Trained models and token ids can't be expressed in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), name)
        discard(docs)  # what the stage before wrote
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
