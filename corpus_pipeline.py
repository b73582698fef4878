"""From raw documents to packed training sequences, stage by stage.

Each stage works on everything its predecessor kept. Its result is written to the shared folder and
read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from forklore.llm import linededup, mixing, packing, quality, simhash
from forklore.llm.common import table
from forklore.session import materialize


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.3 or more."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that five documents or more hold; the largest doc_id keeps them.

    ``n_chars`` is counted anew where it is a column and lines went.
    """
    return linededup.without_common_lines(docs, min_docs=5, min_chars=40)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near duplicates, linked as in the query of that operator."""
    return simhash.keep_one(docs, width=3, reach=3)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources ask for."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in which training sequence."""
    return packing.pack(docs, capacity=4096)


STAGES = [
    ("quality_classifier", good),
    ("line_dedup", own_lines),
    ("simhash_near_dedup", distinct),
    ("mix_sources", mixed),
    ("best_fit_packing", packed),
]

#: The first stage is a trained classifier and the last a tokenizer: no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
