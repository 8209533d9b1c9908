"""Corpus cleaning in stages: toxicity, near duplicates, repeated passages, benchmark leaks, token ids.

Each stage is a function of (spark, docs, sf_dir); its rows are written as Parquet and read again as the next one's docs. All but the last return
the columns of documents. The shared folder of the session holds what is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import bag_minhash, bpe_automaton, decontamination, gated_toxicity, suffix_repeats
from tickloom.llm.common import documents, stored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the labels of the corpus train the score."""
    return gated_toxicity.without_toxic(docs, documents(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that with the least doc_id."""
    return bag_minhash.without_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 200 bytes that stand more than once go; all documents stay, some shorter."""
    return suffix_repeats.without_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a test item, word for word or edited, go."""
    return decontamination.without_leaks(docs, documents(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length and digests of the token ids of each document left, and of the text decoded from them."""
    return bpe_automaton.token_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("token_ids", token_ids),
]

#: The toxicity score, the signatures and the token ids have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
