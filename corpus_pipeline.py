"""A corpus in five stages: reject toxic documents, drop near-duplicates, replace personal data, mix, encode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import bpe, mixing, neardup, pii, queries, toxicity
from weftgraph.llm.common import materialise, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold stay, fitted on the labelled ones among ``docs``."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies stays: shingles of five words, similarity 0.8."""
    return neardup.drop(docs, 5, 80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates in place of personal data; no document goes."""
    return pii.anonymise(docs, queries.pii_key(spark))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target weights; one of a further epoch is one more row."""
    return mixing.mix(docs, queries.domain(), queries.WEIGHTS).drop("mix_epoch")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, their number, and digests of the ids and of the text they decode to."""
    return bpe.digests(docs, queries.tokenizer(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: Trained scores, sketches, keyed surrogates and BPE are beyond SQL; tests compare run() with the stages one by one in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
