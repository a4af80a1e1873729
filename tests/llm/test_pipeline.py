"""The pipeline against a version that does each stage by hand, and its queries."""

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from lodestone.llm import bpe, mixing, ngram_join, pii, toxicity
from lodestone.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) == ""


def test_by_hand(spark):
    """Each stage's decisions on whole tables in one process, with the models that the stages train."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = sorted((r.doc_id, r.token_ids) for r in corpus_pipeline.run(spark, SF).collect())

    chain = toxicity.model(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    p, _ = chain.predict(pa.array([t for _, t in rows], pa.string()))
    rows = [r for r, bad in zip(rows, p[:, 1] >= chain.threshold) if not bad]

    doc, gram = ngram_join.gram_sets(pa.array([t for _, t in rows], pa.string()), ngram_join.N)
    sets = [set() for _ in rows]
    for d, g in zip(doc.tolist(), gram.tolist()):
        sets[d].add(g)
    own = list(range(len(rows)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= ngram_join.THRESHOLD * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)), key=lambda i: rows[i][0])
                own[y] = x
    rows = [rows[i] for i in order if root(i) == i]

    kept = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.model(kept)
    rows = [(i, t) for (i, _), (t, _) in zip(rows, found.redact([t for _, t in rows]))]

    mixed = mixing.apply(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    b = bpe.load(bpe.tokenizer_path())
    want = sorted((r.doc_id, b.encode(r.text).tolist()) for r in mixed.collect())
    assert got == want
    share = np.mean([i in {d for d, _ in got} for i, _ in rows])
    assert share > 0.8


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("text", F.when(F.col("doc_id") % 50 == 7, None).otherwise(F.col("text"))).limit(60)
    before = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == before


def test_filtering_stages_on_an_empty_table(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0).withColumn("__mix_copies", F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES:
        if name in ("toxicity", "pii"):
            out = stage(spark, none, SF)
            assert out.columns == none.columns and out.count() == 0
