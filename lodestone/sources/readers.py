"""Scans: folders of documents, question tables, persisted indices."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X


class ModelNotAvailable(RuntimeError):
    """A step needs a model or a parser that isn't part of this library; pass one in."""


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def _utf8(content: Column) -> Column:
    """Bytes as text; those that aren't UTF-8 are dropped."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))


def read_txt(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of the .txt files of a folder; bytes that aren't UTF-8 are dropped; texts aren't cleaned."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[tT][xX][tT]").load(path)
    text = _utf8(F.col("content"))
    return files.select(stem(F.col("path")).alias("doc_id"), text.alias("text"))


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of the HTML files of a folder, without tags, cleaned."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[hH][tT][mM]*").load(path)
    return files.select(stem(F.col("path")).alias("doc_id"), X.strip_html(_utf8(F.col("content"))).alias("text"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of the .csv files of a folder: header and rows as lines, cells parted by blanks, cleaned."""
    rows = spark.read.option("pathGlobFilter", "*.[cC][sS][vV]").text(path, wholetext=True).select(stem(F.input_file_name()).alias("doc_id"), F.col("value"))
    lines = F.transform(F.split("value", "\r?\n"), lambda x: F.array_join(F.transform(F.split(x, ",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"), lambda c: F.regexp_replace(c, '^"|"$', "")), " "))
    return rows.select("doc_id", X.clean_text(F.array_join(lines, "\n")).alias("text"))


def read_pdf(spark: SparkSession, path: str, extract: Callable[[bytes], str] | None = None) -> DataFrame:
    """(doc_id, text) of the .pdf files of a folder by extract(bytes), which runs on the executors."""
    if extract is None:
        raise ModelNotAvailable("pass extract(bytes) -> str, such as a PDF parser or OCR")
    @F.pandas_udf("string")
    def run(content: pd.Series) -> pd.Series:
        return content.map(extract)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    return files.select(stem(F.col("path")).alias("doc_id"), X.norm_ws(run("content")).alias("text"))


def read_dir(spark: SparkSession, path: str, extract_pdf: Callable[[bytes], str] | None = None) -> DataFrame:
    """(doc_id, text) of all files of a folder that can be read, one for each stem; PDFs only with an extractor.

    Of several files with one stem the one whose kind comes last in txt, pdf, html, csv counts.
    """
    readers = [read_txt, *([lambda s, p: read_pdf(s, p, extract_pdf)] if extract_pdf else []), read_html, read_csv]
    out = None
    for k, read in enumerate(readers):
        one = read(spark, path).withColumn("kind", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("doc_id").agg(F.max_by("text", "kind").alias("text"))


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """(question, answer) of a CSV file whose columns may have any case; rows with a null are dropped."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    by = {c.lower(): c for c in df.columns}
    return df.select(F.col(by.get("question", "question")).alias("question"), F.col(by.get("answer", "answer")).alias("answer")).na.drop()


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The tables that write_index wrote, or None unless all of them are there."""
    from lodestone.sources.writers import INDEX

    hadoop = spark._jvm.org.apache.hadoop.fs
    base = hadoop.Path(path)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not all(fs.exists(hadoop.Path(f"{path}/{name}/_SUCCESS")) for name in INDEX):
        return None
    return {name: spark.read.parquet(f"{path}/{name}") for name in INDEX}


def cached_index(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> dict[str, DataFrame]:
    """The index under the path, built from build() and written where it isn't there yet."""
    from lodestone.sources.writers import write_index

    found = read_index(spark, path)
    if found is None:
        write_index(build(), path)
        found = read_index(spark, path)
    return found
