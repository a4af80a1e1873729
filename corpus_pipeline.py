"""A corpus from documents: each stage works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, mixing, ngram_join, pii, toxicity
from lodestone.llm.common import Scratch, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain takes for toxic go."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least doc_id."""
    return ngram_join.dedupe(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind."""
    return pii.apply(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its fitted rate says."""
    return mixing.apply(docs, table(spark, sf_dir, "labels"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids."""
    return bpe.encode(docs)


STAGES = [("toxicity", reject_toxic), ("ngram_join", drop_near_duplicates), ("pii", redact), ("mixing", mix), ("bpe", encode)]
#: Neither the classifiers nor the tokenizer can be put in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage returns is written and read again.

    Rows with a null text or doc_id stay until mixing, which gives a null or empty text the rate
    of the prior; the last stage gives a null text null token_ids. Repeated rows stay or
    go together. Long texts are handled whole. An empty table gives no rows. Extra columns
    are carried as they are and dropped by the last stage; names that begin with __chain_,
    __mix_ or __drop_ are kept for the stages' own use.
    """
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir))
        if hasattr(before, "_scratch_path"):
            scratch.drop(before)
    return docs
