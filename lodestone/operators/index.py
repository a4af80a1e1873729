"""Sparse and dense indices as tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.sources.shared import keep

EPSILON, K1, B = 0.25, 1.5, 0.75
#: Chunks whose words a task counts at once.
TILE = 1000
KEY = ["doc_id", "start"]


def words(chunks: DataFrame) -> DataFrame:
    """(doc_id, start, words) of each chunk."""
    return chunks.select(*KEY, X.ws_tokenize(F.col("text")).alias("words"))


def term_frequency(chunks: DataFrame) -> DataFrame:
    return words(chunks).select(*KEY, F.explode("words").alias("term")).groupBy(*KEY, "term").agg(F.count("*").alias("tf"))


def stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks and mean words of a chunk."""
    return words(chunks).agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("avgdl"))


def unique(chunks: DataFrame) -> bool:
    """Whether no two chunks have one key."""
    return chunks.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def split(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """The words of a batch of chunks, as ws_tokenize() cuts them, and the chunk that each is of."""
    lists = pc.ascii_split_whitespace(batch.column(batch.schema.get_field_index("text")))
    flat, chunk = lists.flatten(), pc.list_parent_indices(lists)
    some = pc.not_equal(flat, "")
    return flat.filter(some), chunk.filter(some).to_numpy(zero_copy_only=False)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(s, TILE) for whole in batches for s in range(0, whole.num_rows, TILE)):
        flat, chunk = split(batch)
        coded = flat.dictionary_encode()
        n = max(len(coded.dictionary), 1)
        both, tf = np.unique(chunk.astype(np.int64) * n + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        at = pa.array(both // n)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), coded.dictionary.take(pa.array(both % n)), pa.array(tf)], names=[*KEY, "term", "tf"])


def postings(chunks: DataFrame) -> DataFrame:
    """term_frequency() of chunks whose keys are unique: counted within each chunk, so that nothing is shuffled."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.select(*KEY).schema)
    return chunks.select(*KEY, "text").mapInArrow(_postings, kinds + ", term string, tf long")


def frequencies(chunks: DataFrame) -> DataFrame:
    """(term, df, words, sized), worked out in one pass and kept; the row of the empty term counts the chunks, their words, and those that have a text."""
    listed = chunks.select(X.ws_tokenize(F.col("text")).alias("words"))
    terms = F.concat(F.coalesce(F.array_distinct("words"), F.array().cast("array<string>")), F.array(F.lit("")))
    each = listed.select(F.size("words").alias("dl"), F.explode(terms).alias("term"))
    return keep(each.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("words"), F.count("dl").alias("sized")), "frequencies")


def stats_of(counted: DataFrame) -> DataFrame:
    """stats() of frequencies()."""
    own = counted.where("term = ''")
    return own.agg(F.coalesce(F.max("df"), F.lit(0)).cast("long").alias("n"), (F.max("words") / F.nullif(F.max("sized"), F.lit(0))).alias("avgdl"))


def idf(chunks: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """(term, df, idf); terms in more than half of the chunks get a share of the mean instead of a negative weight. counted is frequencies(chunks), if known."""
    counted = frequencies(chunks) if counted is None else counted
    df, n = counted.where("term <> ''").select("term", "df"), stats_of(counted).select("n")
    raw = df.crossJoin(F.broadcast(n)).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def dot(a: Column, b: Column) -> Column:
    """Inner product, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def normalise(v: Column) -> Column:
    """The vector at length 1; a zero vector stays zero."""
    length = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double")))
