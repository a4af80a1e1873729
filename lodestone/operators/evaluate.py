"""Evaluation of answers and leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X


def evaluate(predictions: DataFrame, truth: DataFrame, method: str, key: str = "query_id") -> DataFrame:
    """The evaluation table: predictions (key, answer, confidence, seconds) against truth (key, question, truth)."""
    both = truth.join(predictions, key)
    right = F.when(X.numeric_close(F.col("answer"), F.col("truth")), "Y").otherwise("N")
    return both.select(
        key,
        F.col("question").alias("Question"),
        F.lit(method).alias("Method"),
        F.col("answer").alias("Answer"),
        F.col("confidence").cast("double").alias("Confidence"),
        F.round("seconds", 3).alias("Time (s)"),
        right.alias("Correct (Y/N)"),
        F.col("truth").alias("GroundTruth"),
    )


def accuracy(results: DataFrame) -> DataFrame:
    """(method, total, correct, accuracy)"""
    right = F.count_if(F.col("Correct (Y/N)") == "Y")
    return results.groupBy(F.col("Method").alias("method")).agg(
        F.count("*").alias("total"), right.alias("correct"), (100.0 * right / F.greatest(F.count("*"), F.lit(1))).alias("accuracy")
    )


def leaderboard(results: DataFrame) -> DataFrame:
    """(method, score), the score a mean share in percent."""
    return results.groupBy(F.col("Method").alias("method")).agg((F.avg((F.col("Correct (Y/N)") == "Y").cast("double")) * 100).alias("score"))


def union(*results: DataFrame) -> DataFrame:
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in the stated order."""
    return df.orderBy(*order).limit(n)
