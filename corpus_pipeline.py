"""A corpus from raw documents: toxicity filter, exact dedup, near-duplicate join, source mix, token ids.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.

Defined results: null and empty texts count as empty; they are scored like any other, are equal to each other in the exact
stage, never near copies, have size 0 in the mix (so none is taken) and no tokens. Repeated rows are judged each; of rows that
repeat doc_id and text one stays in the exact stage. A null doc_id stays only where its group has no other. An empty table
goes through as one. Further columns, whatever their names and types, stay up to the last stage, which returns doc_id,
n_tokens, round_trip and ids. Without both classes among the labels nothing or all is toxic, by the share of toxic ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import exact_dedup, mixing, ngram_join, pieces, toxicity
from weftline.llm.common import new_path, table, unused, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on this input, does not call toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    (own,) = unused(docs.columns, "__score")
    return toxicity.score(docs, model, score_col=own).filter(F.col(own) < 0.5).drop(own)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that of the largest doc_id."""
    return exact_dedup.deduplicate(docs, exact_dedup.DigestIndex(spark, new_path(spark, "digest-index")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id."""
    return ngram_join.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's token ids."""
    return pieces.encode(docs).select("doc_id", "n_tokens", "round_trip", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Trained trees and drawn samples have no SQL; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
