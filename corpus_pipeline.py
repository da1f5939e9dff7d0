"""From raw documents to encoded training rows. Each stage's table is written and read again by the next.

In every stage a null text is an empty one and a null in another column is a value like any; repeated rows are documents
of their own; columns besides those of documents stay as they are; an empty table gives an empty one. Very long texts are
whole throughout. What each stage does with ties is told with it.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioq.llm import mixing, piece_codec, quality, simhash
from folioq.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rule or the learned decision list rejects: empty texts fall under the base rule, copies are judged alike."""
    return quality.kept(docs, quality.fit(docs, spark.read.parquet(os.path.join(sf_dir, "labels.parquet"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that of the smallest doc_id, nulls last, of equal ones any; empty texts are one group."""
    return simhash.deduplicated(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the documents out by the sources' target weights; those beyond their source's share go, others come twice.

    A null source is one of its own. Ties in the order go by the shuffled order's hash, then by row. Texts without words go.
    """
    return mixing.mixed(docs)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each text's piece ids, their number and that of its chunks; an empty text has none. Equal texts get equal ids."""
    return piece_codec.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", piece_encoding),
]

#: Fingerprints, learned rules and piece encoding are beyond SQL: tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
