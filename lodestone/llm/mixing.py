"""Mixing sources to target weights with soft memberships.

A softmax classifier trained on the labelled table gives every document a
posterior over the domains (high quality, low quality, toxic). Each document
gets a nonnegative rate; rates start at 1 and are fitted by projected gradient
steps on

    1/2 |S(r) - target|^2 + RIDGE/2 * sum_i (n_i / N) (r_i - 1)^2,   S(r) = sum_i r_i (n_i / N) p_i,

n_i being the tokens of a document and N those of all. The sum S is the only
thing that a step takes from the whole corpus: one distributed sum of as many
numbers as there are domains. A document's rate follows from its posterior and
from the sums of the steps before, so no rates are kept between steps. The steps
are Nesterov's, measured in the norm weighted by n_i / N, so that the step
length doesn't depend on the size of the corpus or of its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import features as X
from lodestone.llm.common import Scratch, column, lean, slices

DOMAINS = ("high_quality", "low_quality", "toxic")
#: Shares of all tokens that the mixture shall have.
TARGET = (0.92, 0.08, 0.0)
SAMPLE = 8192
RIDGE = 1e-3
#: The fit ends when no domain's share of the tokens is further from its target than this, when
#: the steps move none by more than a quarter of it; where it hasn't after so many steps, that is an error.
TOLERANCE, STEPS = 1e-4, 200


class Posterior:
    def __init__(self, sample: pa.Table):
        self.selected, self.w = None, None
        if sample.num_rows:
            _, first = np.unique(X.minhash_groups(X.tokens(sample["text"])), return_index=True)
            sample = sample.take(pa.array(np.sort(first)))
        toxic, good = sample["toxic"].to_numpy() > 0, sample["quality"].to_numpy() > 0
        y = np.column_stack([good & ~toxic, ~good & ~toxic, toxic]).astype(np.float32)
        self.prior = ((y.sum(0) + 1) / (len(y) + len(DOMAINS))).astype(float)
        if (y.sum(0) > 0).sum() > 1:
            t = X.tokens(sample["text"])
            self.selected = X.select(t, y.astype(float))
            self.w, self.b = X.fit(self.selected.matrix(None, t), y)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors and numbers of tokens."""
        t = X.tokens(texts)
        if self.w is None:
            return np.tile(self.prior, (t.n, 1)), t.counts
        p = X.softmax((self.selected.matrix(texts, t) @ self.w + self.b).astype(float))
        p[t.counts == 0] = self.prior
        return p, t.counts


def rates(p: np.ndarray, duals: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rate, point that the next gradient is taken at) after the steps with these sums less the target."""
    r = y = np.ones(len(p))
    eta = 1 / (1 + RIDGE)
    for k, g in enumerate(duals):
        new = np.maximum(0, y - eta * (p @ g + RIDGE * (y - 1)))
        y = new + k / (k + 3) * (new - r)
        r = new
    return r, y


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([column(batch, f"p_{d}").to_numpy() for d in DOMAINS])


def totals(slim: DataFrame, duals: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens of each domain at the rates, and at the point of the next gradient."""
    names = [f"{kind}_{d}" for kind in "ry" for d in DOMAINS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * len(DOMAINS))
        for batch in batches:
            p, n = _matrix(batch), column(batch, "n_tokens").to_numpy().astype(float)
            r, y = rates(p, duals)
            total += np.concatenate([(r * n) @ p, (y * n) @ p])
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names=names)

    parts = slim.select("n_tokens", *(f"p_{d}" for d in DOMAINS)).mapInArrow(lean(run), ", ".join(f"{n} double" for n in names))
    row = parts.agg(*(F.sum(n).alias(n) for n in names)).first()
    both = np.array([row[n] or 0.0 for n in names])
    return both[: len(DOMAINS)], both[len(DOMAINS) :]


def fit_rates(slim: DataFrame, target: np.ndarray, grow: bool = True) -> list[np.ndarray]:
    """The sums less the target of each step, from which rates() gives any document's rate.

    Where the first domain has more than its share already and grow is set, all targets are raised in proportion
    until it needs no thinning: the mixture grows by the others rather than lose what it wants most.
    A fit that doesn't settle within STEPS steps raises RuntimeError.
    """
    n = slim.agg(F.sum("n_tokens")).first()[0] or 0
    duals: list[np.ndarray] = []
    if not n:
        return duals
    last = None
    for _ in range(STEPS):
        at_r, at_y = totals(slim, duals)
        s = at_r / n
        if grow and last is None and target[0] > 0:
            target = target * max(1.0, s[0] / target[0])
        if np.abs(s - target).max() < TOLERANCE or (last is not None and np.abs(s - last).max() < TOLERANCE / 4):
            break
        last = s
        duals.append(at_y / n - target)
    else:
        raise RuntimeError(f"the rates haven't settled within {STEPS} steps")
    return duals


def _posteriors(docs: DataFrame, posterior: Posterior, prefix: str = "") -> DataFrame:
    """docs with n_tokens and a posterior for each domain behind its columns, each under the prefix."""
    names = [f"{prefix}{n}" for n in ("n_tokens", *(f"p_{d}" for d in DOMAINS))]
    kinds = [T.LongType(), *[T.DoubleType()] * len(DOMAINS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                p, n = posterior(column(batch, "text"))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), *(pa.array(p[:, k]) for k in range(p.shape[1]))], names=[*batch.schema.names, *names])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema, *(T.StructField(n, k) for n, k in zip(names, kinds))]))


def rate_of(duals: list[np.ndarray], prefix: str = "") -> F.Column:
    """rates() as an expression over the posteriors, so that rows needn't pass through Python again."""
    if not duals:
        return F.lit(1.0)
    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y"), F.lit(0.0).alias("k"))

    def step(at: F.Column, g: F.Column) -> F.Column:
        dot = sum(F.col(f"{prefix}p_{d}") * g[i] for i, d in enumerate(DOMAINS))
        r = F.greatest(F.lit(0.0), at["y"] - (dot + RIDGE * (at["y"] - 1)) / (1 + RIDGE))
        return F.struct(r.alias("r"), (r + at["k"] / (at["k"] + 3) * (r - at["r"])).alias("y"), (at["k"] + 1).alias("k"))

    return F.aggregate(F.array(*(F.array(*map(F.lit, g.tolist())) for g in duals)), start, step, lambda at: at["r"])


def copies(rate: F.Column, *key: F.Column) -> F.Column:
    """rate, rounded up or down by a hash of the key so that it is right on average."""
    u = (F.xxhash64(*key, F.lit("copies")).bitwiseAND(F.lit((1 << 53) - 1))).cast("double") / F.lit(float(1 << 53))
    return F.floor(rate + u).cast("int")


def _target(target) -> np.ndarray:
    t = np.array(target, dtype=float)
    if len(t) != len(DOMAINS) or (t < 0).any():
        raise ValueError("a nonnegative target for each domain")
    return t


def mix(docs: DataFrame, labels: DataFrame, target=TARGET, bound: int = SAMPLE, seed: int = 17, grow: bool = True) -> DataFrame:
    """doc_id, n_tokens, a posterior for each domain, rate and copies of every row of docs.

    Shares beyond what the posteriors allow are met as nearly as the ridge lets them.
    With grow, where the first domain has more than its share already, the other
    targets rise in proportion instead of thinning it; without it the targets stay
    as given. Rates that don't settle raise RuntimeError.
    Texts that are null or without a token have no tokens and the prior as
    posterior; their rate follows from it and weighs nothing. Long texts are scored whole. Without labels of
    at least two domains every posterior is the prior. Repeated rows and equal or
    null doc_ids keep a row each, and rows of one doc_id and rate have as many copies; other columns are ignored; an empty table gives
    an empty one.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    posterior = X.trained(X.labelled_sample(base, labels, bound, seed), Posterior)
    slim = scratch.save(_posteriors(base, posterior).drop("text"))
    out = slim.withColumn("rate", rate_of(fit_rates(slim, _target(target), grow)))
    shown = [F.round(c, 6).alias(c) for c in [*(f"p_{d}" for d in DOMAINS), "rate"]]
    return out.select("doc_id", "n_tokens", *shown, copies(F.col("rate"), F.col("doc_id")).alias("copies"))


def apply(docs: DataFrame, labels: DataFrame, target=TARGET, bound: int = SAMPLE, seed: int = 17, grow: bool = True) -> DataFrame:
    """The rows of docs, each as many times as its rate says, with the columns of docs.

    Rates are rounded up or down by a hash of doc_id and text, so that repeated
    rows have the same fate. The rows are kept with their posteriors while the rates are fitted, so that
    those without or with equal doc_ids need no join. All else is as in mix().
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    posterior = X.trained(X.labelled_sample(base, labels, bound, seed), Posterior)
    scored = scratch.save(_posteriors(docs, posterior, "__mix_"))
    slim = scored.select(*(F.col(f"__mix_{n}").alias(n) for n in ("n_tokens", *(f"p_{d}" for d in DOMAINS))))
    rate = rate_of(fit_rates(slim, _target(target), grow), "__mix_")
    counted = scored.withColumn("__mix_copies", copies(rate, F.col("doc_id"), F.col("text"))).where("__mix_copies > 0")
    return counted.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select(*docs.columns)
