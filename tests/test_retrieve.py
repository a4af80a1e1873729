"""Sparse scores and indices, within chunks and by joins."""

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest

from lodestone.operators import index as I
from lodestone.operators import retrieve as T
from lodestone.sources import readers, writers

WORDS = "fund grant cash audit income total Income's debtors".split()


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def chunks(spark):
    texts = [" ".join(WORDS[(k * j + k) % 8] for j in range(k % 7 + 1)) for k in range(60)] + ["", " \t fund\n\n fund ", None]
    return spark.createDataFrame([(k // 2, 380 * (k % 2), "general", 400, x) for k, x in enumerate(texts)], "doc_id long, start int, section string, chunk_size int, text string").repartition(3).cache()


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "cash fund cash"), (2, "nothing known"), (3, "Income's total"), (4, "grant audit debtors total fund"), (5, "")], "query_id long, text string")


def test_scores_within_chunks_like_joins(chunks, queries, monkeypatch):
    here, best = T.sparse_scores(chunks, queries), T.sparse_topk(chunks, queries, 4)
    assert "Exchange" not in here._jdf.queryExecution().executedPlan().toString().replace("InMemory", "").split("MapInArrow")[0]
    found, top = rows(here), rows(best)
    assert len(found) > 60 and len(top) == 20
    monkeypatch.setattr(T, "TILE", 3)
    assert rows(T.sparse_topk(chunks, queries, 4)) == top
    monkeypatch.setattr(T, "TERMS", 0)
    assert rows(T.sparse_scores(chunks, queries)) == found and rows(T.sparse_topk(chunks, queries, 4)) == top


def test_scores_below_zero(spark, queries, monkeypatch):
    few = spark.createDataFrame([(k, 0, "fund cash") for k in range(9)], "doc_id long, start int, text string")
    top = rows(T.sparse_topk(few, queries, 3))
    assert min(r[3] for r in top) < 0
    monkeypatch.setattr(T, "TERMS", 0)
    assert rows(T.sparse_topk(few, queries, 3)) == top


def test_repeated_keys_count_together(spark, chunks, queries, tmp_path):
    twice = chunks.select("doc_id", "start", "text").where("text like '%fund%'")
    twice = twice.union(twice)
    assert not I.unique(twice) and T._within(twice, queries, None, 0) is None
    writers.write_index(twice, str(tmp_path / "i"))
    assert rows(spark.read.parquet(str(tmp_path / "i/postings"))) == rows(I.term_frequency(twice))


def test_index_within_chunks(spark, chunks, tmp_path):
    writers.write_index(chunks, str(tmp_path / "i"))
    got = readers.read_index(spark, str(tmp_path / "i"))
    assert rows(got["postings"]) == rows(I.term_frequency(chunks)) and rows(I.postings(chunks)) == rows(I.term_frequency(chunks))
    assert "Exchange" not in I.postings(chunks)._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    assert rows(got["stats"]) == rows(I.stats(chunks)) and rows(I.stats_of(I.frequencies(chunks.limit(0)))) == [(0, None)]
    assert I.idf(chunks.limit(0)).count() == 0


def test_rounds_like_spark():
    x = np.array([1.2345675, 0.0000005, 2.5e-7, -1.2345675, 123.4567894999, 0.0, 7.1, 0.1234565])
    want = [float(Decimal(repr(v)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for v in x.tolist()]
    assert T._rounded(x).tolist() == want
