"""Top-k retrieval over the indices, fusion and reranking, for all queries at once."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import index
from lodestone.sources.shared import keep

K, ALPHA, RERANK, PICK = 6, 0.5, 20, 6
#: Query terms that every task can hold; beyond them the plain joins run.
TERMS = 1 << 20
#: Chunks, and chunks by queries, that a task scores at once.
TILE, CELLS = 1000, 1 << 22
KEY = index.KEY


def _top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def query_terms(queries: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """(query_id, term, times)"""
    terms = F.explode(X.ws_tokenize(X.preprocess_query(F.col("text"), stop_words)))
    return queries.select("query_id", terms.alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def _rounded(x: np.ndarray) -> np.ndarray:
    """To six decimals as F.round() does, halves of the shortest decimal form away from zero."""
    y = np.abs(x) * 1e6
    out = np.sign(x) * np.floor(y + 0.5) / 1e6 + 0.0
    for k in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-3):
        out[k] = float(Decimal(repr(float(x[k]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


def _scorer(weighted: list[Row], avgdl: float, k: int):
    """Over chunks: (query_id, doc_id, start, score) of all hits of the queries' terms, or of the first k of each query in each task."""
    found = sorted(weighted, key=lambda r: r["term"])
    names = sorted({r["term"] for r in found})
    place = {t: i for i, t in enumerate(names)}
    times = np.bincount([place[r["term"]] for r in found], minlength=len(names))
    starts = np.cumsum(times) - times
    ids = sorted({r["query_id"] for r in found})
    number = {q: i for i, q in enumerate(ids)}
    query = np.array([number[r["query_id"]] for r in found], dtype=np.int64)
    weight = np.array([r["times"] * r["idf"] for r in found], dtype=np.float64)
    vocabulary = pa.array(names)

    def scores(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        """(query, row, score)"""
        flat, chunk = index.split(batch)
        dl = np.bincount(chunk, minlength=batch.num_rows)
        at = pc.index_in(flat, vocabulary)
        asked = at.is_valid()
        both, tf = np.unique(chunk[asked.to_numpy(zero_copy_only=False)].astype(np.int64) * len(names) + at.filter(asked).to_numpy(), return_counts=True)
        row, term = both // len(names), both % len(names)
        part = tf * (index.K1 + 1) / (tf + index.K1 * (1 - index.B + index.B * dl[row] / avgdl))
        n = times[term]
        hit = np.repeat(np.arange(len(row)), n)
        to = np.repeat(starts[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
        cell = row[hit] * len(ids) + query[to]
        total = np.bincount(cell, weights=part[hit] * weight[to])
        some = np.flatnonzero(np.bincount(cell))
        yield some % len(ids), some // len(ids), _rounded(total[some])

    def rows(q: np.ndarray, doc: np.ndarray, start: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids).take(pa.array(q)), pa.array(doc), pa.array(start), pa.array(score)], names=["query_id", *KEY, "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not found:
            return
        best, least = None, np.full(len(ids), -np.inf)
        for whole in batches:
            for s in range(0, whole.num_rows, step := max(1, min(TILE, CELLS // len(ids)))):
                batch = whole.slice(s, step)
                doc, start = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for q, row, score in scores(batch):
                    if not k:
                        yield rows(q, doc[row], start[row], score)
                        continue
                    able = score >= least[q]
                    new = q[able], doc[row[able]], start[row[able]], score[able]
                    best = new if best is None else tuple(map(np.concatenate, zip(best, new)))
                    q = best[0]
                    order = np.lexsort((-best[2], -best[1], -best[3], q))
                    q = q[order]
                    first = np.arange(len(q)) - np.searchsorted(q, q)
                    best = tuple(c[order[first < k]] for c in best)
                    full = q[first == k - 1]
                    least[full] = best[3][np.searchsorted(best[0], full, side="right") - 1]
        if best is not None:
            yield rows(*best)

    return run


def _within(chunks: DataFrame, queries: DataFrame, stop_words: list[str] | None, k: int) -> DataFrame | None:
    """Scores worked out within each chunk, nothing but hits leaving a task; None where the terms are too many or keys are not unique integers."""
    kinds = dict(chunks.select(*KEY).dtypes)
    terms = query_terms(queries, stop_words)
    if not set(kinds.values()) <= {"int", "bigint"} or terms.count() > TERMS or not index.unique(chunks):
        return None
    counted = index.frequencies(chunks)
    weighted, avgdl = terms.join(index.idf(chunks, counted), "term").collect(), index.stats_of(counted).first()["avgdl"]
    # below 0 a chunk that doesn't match comes first, so that all that match have to be known
    k = k if all(r["idf"] >= 0 for r in weighted) else 0
    schema = f"query_id {dict(queries.dtypes)['query_id']}, doc_id {kinds['doc_id']}, start {kinds['start']}, score double"
    return chunks.where("text is not null").select(*KEY, "text").mapInArrow(_scorer(weighted, avgdl, k), schema)


def sparse_scores(chunks: DataFrame, queries: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """(query_id, doc_id, start, score) of every chunk that shares a term with the query.

    Each chunk is scored where it is read, by the weights of the query terms, which every task holds.
    Where these are too many, words of chunks are matched with the distinct query terms before they are
    counted, so that only what some query asks for is shuffled. chunks are read several times; keep() them if they cost much.
    """
    found = _within(chunks, queries, stop_words, 0)
    return _joined_scores(chunks, queries, stop_words) if found is None else found


def _joined_scores(chunks: DataFrame, queries: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    terms = query_terms(queries, stop_words)
    asked = terms.select("term").distinct()
    each = index.words(chunks).select(*KEY, F.size("words").alias("dl"), F.explode("words").alias("term"))
    tf = each.join(asked, "term", "left_semi").groupBy(*KEY, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    weighted = terms.join(index.idf(chunks), "term")
    avgdl = F.broadcast(index.stats(chunks).select("avgdl"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (index.K1 + 1) / (F.col("tf") + index.K1 * (1 - index.B + index.B * F.col("dl") / F.col("avgdl")))
    hits = tf.join(weighted, "term").crossJoin(avgdl).withColumn("part", part)
    return hits.groupBy("query_id", *KEY).agg(F.round(F.sum("part"), 6).alias("score"))


def sparse_topk(chunks: DataFrame, queries: DataFrame, k: int = K, stop_words: list[str] | None = None) -> DataFrame:
    """(query_id, doc_id, start, score, rank): ties go to the later chunk, and chunks without a match fill up.

    Only the last 2k chunks can fill up the lists, as fewer than k of them match a query that has room.
    """
    hits = _within(chunks, queries, stop_words, k)
    hits = _joined_scores(chunks, queries, stop_words) if hits is None else hits
    last = chunks.select(*KEY).orderBy(F.desc("doc_id"), F.desc("start")).limit(2 * k)
    none = queries.select("query_id").crossJoin(F.broadcast(last)).withColumn("score", F.lit(0.0))
    both = hits.unionByName(none).groupBy("query_id", *KEY).agg(F.max(F.struct(F.col("score") != 0, "score")).alias("s")).select("query_id", *KEY, "s.score")
    return _top(both, [F.desc("score"), F.desc("doc_id"), F.desc("start")], k)


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, doc_id, start, score, rank) by inner product; ties go to the earlier vector. queries have a `vector`."""
    pairs = vectors.crossJoin(queries.select("query_id", "vector"))
    scored = pairs.select("query_id", *KEY, F.round(index.dot(F.col("embedding"), F.col("vector")), 6).alias("score"))
    return _top(scored, [F.desc("score"), F.asc("doc_id"), F.asc("start")], k)


def minmax(hits: DataFrame) -> DataFrame:
    """hits with score scaled to the range of its query's list."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn("norm", (F.col("score") - low) / (high - low + 1e-6))


def fuse(dense: DataFrame, sparse: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(query_id, doc_id, start, score, rank): weighted sum of both scaled scores, a missing side counting 0.

    Ties keep the order of the dense list, then of the sparse one.
    """
    d = minmax(dense).select("query_id", *KEY, F.col("norm").alias("dn"), F.col("rank").alias("d_rank"))
    s = minmax(sparse).select("query_id", *KEY, F.col("norm").alias("sn"), F.col("rank").alias("s_rank"))
    both = d.join(s, ["query_id", *KEY], "full_outer")
    score = F.round(alpha * F.coalesce("dn", F.lit(0.0)) + (1 - alpha) * F.coalesce("sn", F.lit(0.0)), 6)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("d_rank"), F.asc("s_rank"))
    return both.withColumn("score", score).withColumn("rank", F.row_number().over(order)).select("query_id", *KEY, "score", "rank")


def overlap(question: Column, text: Column) -> Column:
    """A stand-in for a scoring model: the share of the question's distinct words that the text has."""
    q = F.array_distinct(X.tokenize(F.lower(question)))
    return F.size(F.array_intersect(q, X.tokenize(F.lower(text)))) / F.greatest(F.size(q), F.lit(1))


def rerank(ranked: DataFrame, queries: DataFrame, chunks: DataFrame, scorer=overlap, first: int = RERANK) -> DataFrame:
    """The first few of each list in the order of scorer(question, text), the others behind them as before."""
    ranked = keep(ranked, "ranked")
    head = ranked.where(F.col("rank") <= first)
    texts = chunks.select(*KEY, F.col("text").alias("chunk_text"))
    scored = head.join(texts, KEY).join(queries.select("query_id", F.col("text").alias("question")), "query_id")
    scored = scored.select("query_id", *KEY, F.round(scorer(F.col("question"), F.col("chunk_text")), 6).alias("score"), "rank", F.lit(0).alias("tail"))
    tail = ranked.where(F.col("rank") > first).select("query_id", *KEY, "score", "rank", F.lit(1).alias("tail"))
    both = scored.unionByName(tail)
    order = Window.partitionBy("query_id").orderBy("tail", F.when(F.col("tail") == 0, -F.col("score")), "rank")
    return both.withColumn("new", F.row_number().over(order)).select("query_id", *KEY, "score", F.col("new").alias("rank"))


def pick_contexts(ranked: DataFrame, chunks: DataFrame, k: int = PICK) -> DataFrame:
    """(query_id, contexts, sources) of the first k of each list, in its order."""
    own = chunks.select(*KEY, "text", "section", "chunk_size")
    rows = keep(ranked.where(F.col("rank") <= k), "picked").join(own, KEY)
    source = F.struct(F.col("doc_id").cast("string").alias("doc_id"), "section", "chunk_size")
    listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text", source.alias("source")))).alias("l"))
    return listed.select("query_id", F.transform("l", lambda x: x["text"]).alias("contexts"), F.transform("l", lambda x: x["source"]).alias("sources"))


def retrieve(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, k_dense: int | None = None, k_sparse: int | None = None, alpha: float | None = None, reranked: bool = True) -> DataFrame:
    """Dense and sparse lists, fused and reranked. A k of 0 or none means the default; alpha may be 0."""
    dense = dense_topk(vectors, queries, k_dense or K)
    sparse = sparse_topk(chunks, queries, k_sparse or K)
    ranked = fuse(dense, sparse, ALPHA if alpha is None else alpha)
    return rerank(ranked, queries, chunks) if reranked else ranked
