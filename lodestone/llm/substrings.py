"""Substring deduplication by sliding spans of sentences.

From every sentence on, the run of several consecutive sentences that is long
enough is hashed: at least MIN_SENTENCES of them and at least MIN_WORDS words. A
run's extent follows from its own text, and a sentence beyond LONG_SENTENCE falls into clauses, or where
it has none into stretches that end at words chosen by their hash; so equal
passages have equal runs wherever they stand, from the first whole part in them
to the last. The runs are joined over all documents, and sentences covered by a run that occurs
earlier, in the order of (doc_id, place), are removed. A single repeated sentence
that is shorter than MIN_WORDS stays.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import column, lean, slices, small_batches

MIN_SENTENCES, MIN_WORDS, LONG_SENTENCE = 2, 20, 12
#: Odd, so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
#: A sentence with the white space after it.
SENTENCE = re.compile(r"[^\n.!?]*(?:[.!?]+(?=[^\s.!?])[^\n.!?]*)*(?:[.!?]+\s*|\n\s*|$)")


CLAUSE = re.compile(r"[^,;:]*(?:[,;:]+(?=[^\s,;:])[^,;:]*)*(?:[,;:]+\s*|$)")
WORD = re.compile(r"\S+\s*|\s+")
#: A stretch ends at about one word in so many, and at the latest after so many words.
STRETCH, LONGEST = 6, 12


def stretches(clause: str) -> list[str]:
    """A long clause without marks, cut after words that depend on nothing but themselves."""
    out, at, n = [], 0, 0
    for m in WORD.finditer(clause):
        n += 1
        if n == LONGEST or zlib.crc32(m.group().strip().lower().encode()) % STRETCH == 0:
            out.append(clause[at : m.end()])
            at, n = m.end(), 0
    return out + [clause[at:]] if at < len(clause) else out


def sentences(text: str) -> list[str]:
    """The parts of a text, which join to the very text again: sentences, and the clauses or stretches of long ones."""
    out = []
    for s in SENTENCE.findall(text):
        if s and s.count(" ") < LONG_SENTENCE:
            out.append(s)
        elif s:
            for c in CLAUSE.findall(s):
                if c and c.count(" ") < LONG_SENTENCE:
                    out.append(c)
                elif c:
                    out += stretches(c)
    return out


def runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first sentence, sentences, hash) of every run.

    A run's hash is that of the hashes of its sentences: the difference of two sums over
    the sentences before, each weighted by a power of BASE, brought to the power 0.
    """
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    doc, place, size, key = [], [], [], []
    for k, text in enumerate(texts):
        for i, s in enumerate(sentences(text)):
            if words := s.lower().split():
                doc.append(k)
                place.append(i)
                size.append(len(words))
                key.append(digest(" ".join(words)))
    n = len(doc)
    doc, place = np.array(doc, dtype=np.int64), np.array(place, dtype=np.int64)
    total = np.concatenate([[0], np.cumsum(np.array(size, dtype=np.int64))])
    first = np.arange(n)
    stop = np.maximum(np.searchsorted(total, total[:-1] + MIN_WORDS), first + MIN_SENTENCES)
    whole = (stop <= n) & (doc[np.minimum(stop, n) - 1] == doc)
    first, stop = first[whole], stop[whole]
    up, down = (np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, b, dtype=np.uint64))) for b in (BASE, pow(BASE, -1, 1 << 64)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.array(key, dtype=np.uint64) * up[:n], dtype=np.uint64)])
    hashes = (sums[stop] - sums[first]) * down[first]
    return doc[first], place[first], place[stop - 1] - place[first] + 1, hashes


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 4 << 20):
            doc, first, count, key = runs(column(batch, "text").to_pylist())
            take = pa.array(doc)
            ids, versions = column(batch, "doc_id").take(take), column(batch, "version").take(take)
            yield pa.RecordBatch.from_arrays([ids, versions, pa.array(first << 32 | count), pa.array(key.view(np.int64))], names=["doc_id", "version", "run", "key"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 4 << 20):
            texts, gone = column(batch, "text").to_pylist(), []
            for k, covered in enumerate(column(batch, "covered").to_pylist()):
                if texts[k] is None or not covered:
                    gone.append(None if texts[k] is None else 0)
                    continue
                parts = sentences(texts[k])
                out = set()
                for run in covered:
                    out.update(range(run >> 32, (run >> 32) + (run & 0xFFFFFFFF)))
                texts[k] = "".join(s for i, s in enumerate(parts) if i not in out)
                gone.append(len(out))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(texts, pa.string()), pa.array(gone, pa.int32())], names=["doc_id", "text", "n_removed"])


def dedupe(docs: DataFrame) -> DataFrame:
    """doc_id, text less the repeated sentences, and n_removed, for every row of docs.

    The first occurrence in the order of (doc_id, place) stays. A null text stays
    null (n_removed null), an empty one empty. Rows of one doc_id and text are one
    document, of which nothing is removed for another copy's sake; texts that
    share a doc_id are told apart by a hash. Rows without a doc_id are left as
    they are and don't count. Texts are handled whole; other columns are ignored;
    an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = base.withColumn("version", F.xxhash64("text"))
    known = base.where("doc_id is not null and length(text) > 0")
    found = known.mapInArrow(lean(_runs), "doc_id long, version long, run long, key long")
    # one shuffle, and a window that holds no more than a row: the first place has rank 1, that of a repeated row too
    rank = F.dense_rank().over(Window.partitionBy("key").orderBy("doc_id", "version", "run"))
    later = found.withColumn("rank", rank).where("rank > 1")
    covered = later.groupBy("doc_id", "version").agg(F.collect_set("run").alias("covered"))
    return base.join(covered, ["doc_id", "version"], "left").select("doc_id", "text", "covered").mapInArrow(lean(_cut), "doc_id long, text string, n_removed int")
