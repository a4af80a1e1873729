"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A bounded sample of labelled documents gives weighted counts of words, shapes and
ranges of a few statistics (length, share of distinct words, of symbols), whose leading singular vectors span the latent space. Its labelled vectors are
broadcast (their number and width are parameters). Every document is projected,
its cosine with every labelled vector is computed exactly, block by block, and
its nearest neighbours vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import features as X
from lodestone.llm.common import column, lean, slices
from lodestone.llm.toxicity import pick_threshold

#: Labelled documents, at most; features; width of the latent space; neighbours that vote.
SAMPLE, VOCABULARY, WIDTH, NEIGHBOURS = 4096, 6000, 64, 15
#: Ranges that each statistic is cut into, and what such a range weighs against a word.
RANGES, RANGE_WEIGHT = 10, 2.0
PRECISION = 0.9
OUT = "doc_id long, quality_score double, nearest double, keep boolean"


def weights(t: X.Tokens, vocabulary: pa.Array, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, weight) in order of the text; the ranges of the statistics follow the vocabulary."""
    doc, feature, times = X.bag(t, vocabulary)
    stats, some = X.dense(t), np.flatnonzero(t.counts)
    more = [len(vocabulary) + k * RANGES + np.searchsorted(edges[k], stats[some, k]) for k in range(stats.shape[1])]
    doc = np.concatenate([doc, *[some] * len(more)])
    feature = np.concatenate([feature, *more])
    w = np.concatenate([np.log1p(times), np.full(len(some) * len(more), RANGE_WEIGHT)]).astype(np.float32)
    order = np.argsort(doc, kind="stable")
    return doc[order], feature[order], w[order]


@dataclass
class Neighbours:
    vocabulary: pa.Array
    edges: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    threshold: float

    def project(self, texts: pa.Array) -> np.ndarray:
        """Unit vectors; zero where a text has none of the features."""
        t = X.tokens(texts)
        doc, feature, w = weights(t, self.vocabulary, self.edges)
        out = np.zeros((t.n, self.projection.shape[1]), dtype=np.float32)
        if len(doc):
            starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            step, edges = 1 << 18, np.append(starts, len(doc))
            at = 0
            while at < len(starts):  # blocks of whole texts, so that the gathered rows stay small
                to = max(at + 1, int(np.searchsorted(edges, edges[at] + step, side="right")) - 1)
                s, e = edges[at], edges[to]
                out[doc[starts[at:to]]] = np.add.reduceat(self.projection[feature[s:e]] * w[s:e, None], starts[at:to] - s, axis=0)
                at = to
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.where(norm > 1e-9, out / np.maximum(norm, 1e-9), 0)

    def vote(self, z: np.ndarray, own: bool = False, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """(share of the neighbours' weight on quality 1, cosine of the nearest); own leaves out the vector itself."""
        score, nearest = np.zeros(len(z)), np.zeros(len(z))
        k = min(NEIGHBOURS, len(self.vectors) - own)
        for at in range(0, len(z), block):
            s = z[at : at + block] @ self.vectors.T
            if own:
                s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            sim = np.take_along_axis(s, best, 1)
            last = sim.min(1, keepdims=True)
            tied = np.flatnonzero((s == last).sum(1) > (sim == last).sum(1))
            if len(tied):  # more are as near as the last: those of the least doc_id vote
                best[tied] = np.argsort(-s[tied], axis=1, kind="stable")[:, :k]
                sim[tied] = np.take_along_axis(s[tied], best[tied], 1)
            w = np.maximum(sim, 1e-6)
            score[at : at + block] = (w * self.labels[best]).sum(1) / w.sum(1)
            nearest[at : at + block] = sim.max(1)
        return score, nearest


def train(sample: pa.Table, seed: int = 5) -> Neighbours | None:
    if sample.num_rows:
        _, first = np.unique(X.minhash_groups(X.tokens(sample["text"])), return_index=True)
        sample = sample.take(pa.array(np.sort(first)))
    y = (sample["quality"].to_numpy() > 0).astype(float)
    if len(y) < 2:
        return None
    t = X.tokens(sample["text"])
    names = []
    for part in (t.words, t.shapes):
        coded = part.dictionary_encode()
        key = np.unique(t.doc * len(coded.dictionary) + coded.indices.to_numpy()[t.code]) % max(len(coded.dictionary), 1)
        df = np.bincount(key, minlength=len(coded.dictionary))
        full = pc.not_equal(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)
        order = np.lexsort((np.array(coded.dictionary.to_pylist(), dtype=object).astype(str), -df * full))[:VOCABULARY]
        names.append((coded.dictionary.take(pa.array(order)), df[order] * full[order]))
    vocabulary, df = pa.concat_arrays([n for n, _ in names]), np.concatenate([d for _, d in names])
    some = df >= min(3, len(y))
    vocabulary = vocabulary.filter(pa.array(some))
    stats = X.dense(t)
    edges = np.quantile(stats, np.linspace(0, 1, RANGES + 1)[1:-1], axis=0).T
    x = np.zeros((t.n, len(vocabulary) + RANGES * stats.shape[1]), dtype=np.float32)
    doc, feature, w = weights(t, vocabulary, edges)
    df = np.bincount(feature, minlength=x.shape[1])
    idf = (np.log((1 + t.n) / (1 + df)) + 0.1).astype(np.float32)
    x[doc, feature] = w
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    width = min(WIDTH, *x.shape)
    q = np.random.default_rng(seed).standard_normal((x.shape[1], min(width + 16, x.shape[1]))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    basis = (q @ v.T)[:, :width]
    out = Neighbours(vocabulary, edges, (idf[:, None] * basis).astype(np.float32), np.zeros((0, width)), y, 0.5)
    out.vectors = out.project(sample["text"])
    score, _ = out.vote(out.vectors, own=True)
    if 0 < y.sum() < len(y):
        out.threshold = 1 - pick_threshold(1 - score, y == 0, PRECISION)
    return out


def classify(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, seed: int = 5) -> DataFrame:
    """doc_id, quality_score (0 to 1), nearest (cosine of the nearest neighbour) and keep, for every row of docs.

    keep is false where the score is under the threshold, which is the one that finds
    low quality best among the sample's own vectors, each voted on by the
    others. Null texts have null scores and aren't kept; empty texts and those
    without a known feature have score 0, nearest 0 and aren't kept. With fewer
    than two labelled documents scores are null and every text is kept. Of labelled
    documents as near as the last neighbour those of the least doc_id vote. Long texts
    are projected whole; an empty table gives no rows. Repeated rows and equal or null doc_ids keep a row each; other columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = X.trained(X.labelled_sample(base, labels, bound, seed), lambda sample: train(sample, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = column(batch, "text")
                null = texts.is_null().to_numpy(zero_copy_only=False)
                if found is None:
                    nothing = pa.nulls(len(texts), pa.float64())
                    cols = [nothing, nothing, pa.array(~null)]
                else:
                    z = found.project(texts)
                    score, nearest = found.vote(z)
                    known = np.abs(z).sum(1) > 0
                    score, nearest = np.where(known, score, 0), np.where(known, nearest, 0)
                    keep = known & ~null & (score > found.threshold)
                    cols = [pa.array(np.round(score, 6), mask=null), pa.array(np.round(nearest, 6).astype(float), mask=null), pa.array(keep)]
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *cols], names=["doc_id", "quality_score", "nearest", "keep"])

    return base.mapInArrow(lean(run), OUT)
