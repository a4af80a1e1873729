"""Sinks: indices, results, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import index

INDEX = ("chunks", "postings", "idf", "stats")


def write_index(chunks: DataFrame, path: str) -> None:
    """Chunks and their sparse index, each a table of its own."""
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    kept = chunks.sparkSession.read.parquet(f"{path}/chunks")
    tf = index.postings(kept) if index.unique(kept) else index.term_frequency(kept)
    tf.write.mode("overwrite").parquet(f"{path}/postings")
    counted = index.frequencies(kept)
    index.idf(kept, counted).write.mode("overwrite").parquet(f"{path}/idf")
    index.stats_of(counted).write.mode("overwrite").parquet(f"{path}/stats")


def write_results(results: DataFrame, path: str) -> None:
    """Evaluation results as CSV files of a folder, each with a header and of the size that Spark advises; no task holds them all."""
    results.hint("rebalance").write.mode("overwrite").csv(path, header=True)


def write_reports(reports: DataFrame, path: str, skip_years: tuple[int, ...] = (2023, 2024)) -> None:
    """Rendered reports by file name; those of the skipped years are left out."""
    kept = reports.where(F.col("year").isNull() | ~F.col("year").isin(*skip_years))
    kept.select("out_name", F.col("rendered").alias("value")).write.mode("overwrite").partitionBy("out_name").text(path)
