"""Toxicity by a classifier chain.

The categories are predicted one after another by linear models; each model has
the probabilities of the categories before it among its features. In training
these are out-of-fold predictions, so that a later model sees them as they will
be on new documents. What a fold's models see of a held-out row, they see
without its labels: features are selected, and the third category is defined, on
the rows of the fold's training part alone. The labelled table has two categories, low quality and
toxic; severe toxicity is a toxic document with several distinct words that
the selection finds on toxic documents. Near copies in the sample count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import features as X
from lodestone.llm.common import column, lean, slices

CATEGORIES = ("low_quality", "toxic", "severe_toxic")
#: Documents of the labelled table that the chain is trained on, at most.
SAMPLE = 8192
FOLDS = 5
#: A document is rejected from the probability of toxic at which the out-of-fold predictions are so precise.
PRECISION = 0.9
#: Distinct words found on toxic documents that make a toxic document a severe one.
SEVERE = 3


@dataclass
class Chain:
    selected: X.Selected
    weights: list[tuple[np.ndarray, float]]
    threshold: float

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities, a column a category, and which texts have any token."""
        t = X.tokens(texts)
        x = self.selected.matrix(texts, t)
        out = np.zeros((t.n, len(self.weights)))
        for k, (w, b) in enumerate(self.weights):
            out[:, k] = X.sigmoid(x @ w + b)
            x = np.column_stack([x, X.logit(out[:, k]).astype(np.float32)])
        some = t.counts > 0
        out[~some] = 0
        return out, some


def pick_threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The cut with the best F1 among those that are precise enough, halfway to the next lower score."""
    if not len(p) or not y.any():
        return 2.0
    order = np.argsort(-p, kind="stable")
    s, hit = p[order], np.cumsum(y[order])
    n = np.arange(1, len(s) + 1)
    f1 = 2 * hit / (n + y.sum())
    last = np.append(s[1:] != s[:-1], True)
    good = last & (hit / n >= precision)
    f1 = np.where(good if good.any() else last, f1, -1)
    k = int(np.argmax(f1))
    return float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k] / 2)


def prepared(t: X.Tokens, low: np.ndarray, toxic: np.ndarray, own: np.ndarray) -> tuple[X.Selected, np.ndarray]:
    """The features selected on the rows of the mask, and the labels of these rows, a column a category."""
    part = t.rows(own)
    chosen = X.select(part, np.column_stack([low, toxic])[own].astype(float))
    doc, feature, _ = X.bag(part, chosen.vocabulary)
    marked = np.bincount(doc[np.isin(feature, np.flatnonzero(chosen.z[1] >= 8))], minlength=part.n) >= SEVERE
    return chosen, np.column_stack([low[own], toxic[own], toxic[own] & marked])


def train(sample: pa.Table, seed: int = 13) -> Chain | None:
    """The chain, or None where the sample lacks toxic or other documents."""
    if sample.num_rows:
        _, first = np.unique(X.minhash_groups(X.tokens(sample["text"])), return_index=True)
        sample = sample.take(pa.array(np.sort(first)))
    toxic = sample["toxic"].to_numpy().astype(float) > 0
    if not toxic.any() or toxic.all():
        return None
    low = sample["quality"].to_numpy().astype(float) <= 0
    t = X.tokens(sample["text"])
    fold = np.random.default_rng(seed).permutation(t.n) % FOLDS
    parts = [prepared(t, low, toxic, fold != k) for k in range(FOLDS)]
    filling = [chosen.parts(t) for chosen, _ in parts]
    held = np.zeros((t.n, len(CATEGORIES)))
    for c in range(len(CATEGORIES)):
        for k, (chosen, labels) in enumerate(parts):
            x = np.column_stack([chosen.filled(filling[k]), X.logit(held[:, :c]).astype(np.float32)])
            w, b = X.fit(x[fold != k], labels[:, c])
            held[fold == k, c] = X.sigmoid(x[fold == k] @ w + b)
    chosen, labels = prepared(t, low, toxic, np.ones(t.n, bool))
    x = np.column_stack([chosen.matrix(None, t), X.logit(held).astype(np.float32)])
    width = x.shape[1] - len(CATEGORIES)
    weights = [X.fit(x[:, : width + c], labels[:, c]) for c in range(len(CATEGORIES))]
    return Chain(chosen, weights, pick_threshold(held[:, 1], toxic, PRECISION))


def with_scores(docs: DataFrame, chain: Chain | None, prefix: str = "") -> DataFrame:
    """docs with the probabilities and is_toxic behind its columns, each under the prefix."""
    names = [f"{prefix}p_{c}" for c in CATEGORIES] + [f"{prefix}is_toxic"]
    kinds = [T.DoubleType()] * len(CATEGORIES) + [T.BooleanType()]
    schema = T.StructType([*docs.schema, *(T.StructField(n, k) for n, k in zip(names, kinds))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = column(batch, "text")
                if chain is None:
                    scores, flag = [pa.nulls(len(texts), pa.float64())] * len(CATEGORIES), np.zeros(len(texts), bool)
                else:
                    p, _ = chain.predict(texts)
                    null = texts.is_null().to_numpy(zero_copy_only=False)
                    scores = [pa.array(np.round(p[:, k], 6), mask=null) for k in range(p.shape[1])]
                    flag = (p[:, 1] >= chain.threshold) & ~null
                yield pa.RecordBatch.from_arrays([*batch.columns, *scores, pa.array(flag)], names=[*batch.schema.names, *names])

    return docs.mapInArrow(lean(run), schema)


def model(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, seed: int = 13) -> Chain | None:
    return X.trained(X.labelled_sample(docs, labels, bound, seed), lambda sample: train(sample, seed))


def classify(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, seed: int = 13) -> DataFrame:
    """doc_id, a probability for each category and is_toxic, for every row of docs.

    Severe toxicity is no label of its own: it is a label of toxic on a document with
    SEVERE of the words found on toxic documents. A null text has null probabilities, one without a token has 0; neither is
    toxic. Long texts are scored whole. A probability equal to the threshold is toxic. An empty table of documents gives no rows. Where the labels don't have both toxic and other documents, no row is
    toxic and all probabilities are null. Repeated rows and equal or null
    doc_ids keep a row each; other columns of either table are ignored.
    """
    chain = model(docs, labels, bound, seed)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_scores(base, chain).drop("text")


def reject(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, seed: int = 13) -> DataFrame:
    """The rows of docs that aren't toxic, with the columns of docs."""
    chain = model(docs, labels, bound, seed)
    return with_scores(docs, chain, "__chain_").where("not __chain_is_toxic").select(*docs.columns)
