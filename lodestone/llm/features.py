"""Word and shape features of texts, and the linear models trained on them.

A feature is a word (lower case, without punctuation around it) or the shape of
a token as written: runs of capitals, small letters and digits become A, a and 0.
Heavy string work is done once for each distinct token of a batch.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import lean, small_batches

N_DENSE = 6
SHAPE = "\x00"


@dataclass
class Tokens:
    """The tokens of n texts: doc and code of each; word and shape of each code."""

    n: int
    doc: np.ndarray
    code: np.ndarray
    words: pa.Array
    shapes: pa.Array
    lengths: np.ndarray

    def rows(self, keep: np.ndarray) -> Tokens:
        """The tokens of the texts that the mask keeps."""
        own, at = keep[self.doc], np.cumsum(keep) - 1
        return Tokens(int(keep.sum()), at[self.doc[own]], self.code[own], self.words, self.shapes, self.lengths)

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n)


def tokens(texts: pa.Array) -> Tokens:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    values, doc = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.not_equal(pc.binary_length(values), 0)
    values, doc = values.filter(full), doc.filter(full)
    coded = values.dictionary_encode()
    distinct = coded.dictionary
    words = pc.replace_substring_regex(pc.utf8_lower(distinct), r"^[^\pL\pN]+|[^\pL\pN]+$", "")
    shapes = distinct
    for kind, mark in ((r"\p{Lu}+", "A"), (r"\p{Ll}+", "a"), (r"\p{N}+", "0")):
        shapes = pc.replace_substring_regex(shapes, kind, mark)
    shapes = pc.binary_join_element_wise(pa.scalar(SHAPE), pc.utf8_slice_codeunits(shapes, 0, 6), "")
    return Tokens(len(texts), doc.to_numpy().astype(np.int64), coded.indices.to_numpy().astype(np.int64), words, shapes, pc.utf8_length(distinct).to_numpy())


def dense(t: Tokens) -> np.ndarray:
    """Of each text: log of its tokens, share of distinct ones, of capitals, of symbols, of digits, mean length."""
    n = np.maximum(t.counts, 1)
    shapes = t.shapes
    caps = pc.match_substring_regex(shapes, r"^\x00[^a0]*A[^a]*$").to_numpy(zero_copy_only=False)
    letters = pc.match_substring_regex(shapes, r"[Aa]").to_numpy(zero_copy_only=False)
    digits = pc.match_substring_regex(shapes, r"0").to_numpy(zero_copy_only=False)
    mean = lambda x: np.bincount(t.doc, weights=x[t.code].astype(float), minlength=t.n) / n
    first = np.unique(t.doc * max(len(shapes), 1) + t.code) // max(len(shapes), 1)
    distinct = np.bincount(first, minlength=t.n) / n
    return np.column_stack([np.log1p(t.counts), distinct, mean(caps), mean(~letters & ~digits), mean(digits), mean(t.lengths)]).astype(np.float32)


def bag(t: Tokens, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, times) of the features that are in the vocabulary, in order of the text."""
    keys, size = [], max(len(vocabulary), 1)
    for names in (t.words, t.shapes):
        ids = pc.fill_null(pc.index_in(names, value_set=vocabulary), -1).to_numpy()[t.code]
        found = ids >= 0
        keys.append(t.doc[found] * size + ids[found])
    key, times = np.unique(np.concatenate(keys), return_counts=True)
    return key // size, key % size, times


#: Min-hashes of a text, how many of them together make it a candidate, and how many of all near copies agree on.
HASHES, BAND, AGREE = 64, 4, 45


def minhash_groups(t: Tokens, seed: int = 7) -> np.ndarray:
    """A number for each text that its near copies share: texts whose sets of words agree on AGREE of HASHES min-hashes (a Jaccard of about 0.7), and what these lead to."""
    coded = t.words.dictionary_encode()
    ids = coded.indices.to_numpy()[t.code]
    starts = np.flatnonzero(np.append(True, t.doc[1:] != t.doc[:-1])) if len(t.doc) else np.zeros(0, np.int64)
    least = np.full((t.n, HASHES), -1, dtype=np.int32)  # texts without words are alike
    for k in range(HASHES if len(starts) else 0):
        order = np.random.default_rng(seed + k).permutation(len(coded.dictionary)).astype(np.int32)
        least[t.doc[starts], k] = np.minimum.reduceat(order[ids], starts)
    group = np.arange(t.n)

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for k in range(0, HASHES, BAND):
        _, band = np.unique(least[:, k : k + BAND], axis=0, return_inverse=True)
        band = band.reshape(-1)
        order = np.argsort(band, kind="stable")
        for left in np.split(order, np.flatnonzero(np.diff(band[order])) + 1) if t.n else []:
            while len(left) > 1:
                near = (least[left] == least[left[0]]).sum(1) >= AGREE
                for i in left[near]:
                    a, b = root(left[0]), root(i)
                    group[max(a, b)] = min(a, b)
                left = left[~near]
    return np.array([root(i) for i in range(t.n)], dtype=np.int64)


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int, seed: int) -> DataFrame:
    """doc_id, text, quality and toxic of up to bound labelled documents, the same ones whenever the tables are the same.

    Labels with a null and documents without a text are left out; of several labels
    of one doc_id the greatest counts, of several texts that of the greatest hash. Only the bounded sample, never the labels as
    a whole, is broadcast.
    """
    one = labels.select("doc_id", "quality", "toxic").na.drop().groupBy("doc_id").agg(*(F.max(x).cast("long").alias(x) for x in ("quality", "toxic")))
    some = thinned(one, bound, F.xxhash64("doc_id", F.lit(seed))).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(bound)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    found = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", "quality", "toxic").agg(F.max_by("text", F.xxhash64("text")).alias("text"))
    return found.select("doc_id", "text", "quality", "toxic")


def thinned(df: DataFrame, bound: int, key: Column) -> DataFrame:
    """The rows of the least keys, well over the bound of them, so that a later sort by the key and limit to the bound gives what it gave on all rows, from few."""
    small_batches(df.sparkSession)
    n = df.count()
    share = (2 * bound + 100) / max(n, 1)
    return df if share >= 1 else df.where(key <= F.lit(int(-(2**63) + 2**64 * share)).cast("long"))


def settled(sample: pa.Table) -> pa.Table:
    """The sample in a fixed order, with one text, the one of the greatest hash, for each doc_id."""
    order = np.lexsort([np.array([hash_text(x) for x in sample["text"].to_pylist()], dtype=np.uint64), sample["doc_id"].to_numpy()]) if sample.num_rows else []
    sample = sample.take(pa.array(order, pa.int64()))
    ids = sample["doc_id"].to_numpy()
    return sample.filter(pa.array(np.append(ids[1:] != ids[:-1], True) if len(ids) else np.zeros(0, bool)))


LABELLED = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("quality", pa.int64()), ("toxic", pa.int64())])


def trained(sample: DataFrame, train, schema: pa.Schema = LABELLED, settle=settled):
    """train(table), worked out by one task where the bounded sample is; only the model comes to the driver."""

    def run(batches):
        held = [pa.RecordBatch.from_arrays([b.column(k).cast(t) for k, t in enumerate(schema.types)], schema=schema) for b in batches]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(settle(pa.Table.from_batches(held, schema))))], pa.binary())], names=["model"])

    found = sample.repartition(1).mapInArrow(lean(run), "model binary").collect()
    return pickle.loads(found[0].model) if found else train(schema.empty_table())


def hash_text(x: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(x.encode())


@dataclass
class Selected:
    """A vocabulary chosen on a sample, and how the columns are scaled."""

    vocabulary: pa.Array
    scale: np.ndarray
    shift: np.ndarray
    z: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def matrix(self, texts: pa.Array, t: Tokens | None = None) -> np.ndarray:
        return self.filled(self.parts(t or tokens(texts)))

    def parts(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What a matrix is filled with, in a tenth of its memory."""
        doc, feature, times = bag(t, self.vocabulary)
        return doc.astype(np.int32), feature.astype(np.int32), np.log1p(times).astype(np.float32), dense(t)

    def filled(self, parts: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        doc, feature, value, rest = parts
        x = np.zeros((len(rest), len(self.vocabulary) + N_DENSE), dtype=np.float32)
        x[doc, feature] = value
        x[:, len(self.vocabulary) :] = rest
        x -= self.shift
        x *= self.scale
        return x


def select(t: Tokens, classes: np.ndarray, most: int = 1024, least_z: float = 4.0, least_df: int = 5) -> Selected:
    """The features whose share of texts differs most, in standard errors, between a class and the rest."""
    n = t.n
    names, dfs = [], []
    for part in (t.words, t.shapes):
        coded = part.dictionary_encode()
        size = max(len(coded.dictionary), 1)
        key = np.unique(t.doc * size + coded.indices.to_numpy()[t.code])
        doc, word = key // size, key % size
        names.append(coded.dictionary)
        dfs.append(np.stack([np.bincount(word, weights=classes[doc, k], minlength=size) for k in range(classes.shape[1])] + [np.bincount(word, minlength=size)])[:, : len(coded.dictionary)])
    name, df = pa.concat_arrays(names), np.concatenate(dfs, axis=1)
    total, by = df[-1], df[:-1]
    size = classes.sum(0)[:, None]
    p1, p0, p = by / np.maximum(size, 1), (total - by) / np.maximum(n - size, 1), total / max(n, 1)
    z = (p1 - p0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / np.maximum(size, 1) + 1 / np.maximum(n - size, 1)))
    best = np.abs(z).max(0, initial=0) * (total >= least_df) * np.asarray(pc.not_equal(pc.binary_length(name), 0).to_numpy(zero_copy_only=False))
    chosen = np.argsort(-best, kind="stable")[:most]
    chosen = chosen[best[chosen] >= least_z]
    out = Selected(name.take(pa.array(chosen)), np.ones(1, np.float32), np.zeros(1, np.float32), z[:, chosen])
    raw = out.matrix(None, t)
    out.shift, out.scale = raw.mean(0), 1 / np.maximum(raw.std(0), 0.1)
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, l2: float = 0.003, steps: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offset of a logistic model (y of 0 and 1) or a softmax one (a column a class), by Nesterov's method."""
    many = y.ndim == 2
    y = y.astype(np.float32) if many else y.astype(np.float32)[:, None]
    n = max(len(x), 1)
    v = np.ones(x.shape[1], dtype=np.float32)
    for _ in range(12):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) + 1e-9
    bound = float(np.linalg.norm(x @ v) ** 2) / n * (0.5 if many else 0.25) + 0.25 + l2
    p = np.clip(y.mean(0), 1e-4, 1 - 1e-4)
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), (np.log(p) if many else np.log(p / (1 - p))).astype(np.float32)
    u, c = w, b
    for k in range(steps):
        z = x @ u + c
        e = ((softmax(z) if many else sigmoid(z)) - y) / n
        w1, b1 = u - (x.T @ e + l2 * u) / bound, c - e.sum(0) / bound
        m = k / (k + 3)
        u, c = w1 + m * (w1 - w), b1 + m * (b1 - b)
        w, b = w1, b1
    return (w, b) if many else (w[:, 0], b[0])
