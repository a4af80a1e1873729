"""The operators against brute force, and on odd tables."""

from __future__ import annotations

import random
import time
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, fingerprints, hnsw, knn, mixing, ngram_join, pii, sharding, substrings, toxicity
from lodestone.llm import features as X
from lodestone.llm.common import Scratch, components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null in any column, empty, blank, repeated rows, equal ids with other texts, very long.
ODD = [
    (1, "One two three four. Five six seven eight nine ten. Eleven twelve thirteen.", "en", "a", 10),
    (1, "One two three four. Five six seven eight nine ten. Eleven twelve thirteen.", "en", "a", 10),
    (1, "Another text under the same number, which is quite different from the first.", "en", "a", 10),
    (2, None, "en", "a", None),
    (3, "", None, "b", 0),
    (4, " \n\t ", "en", None, 4),
    (None, "A text without a number. It has two sentences and mail me@example.com here.", "en", "b", 70),
    (None, None, None, None, None),
    (5, "x" * 100_000, "en", "a", 100_000),
    (6, "long words here and there. " * 4000, "en", "b", 108_000),
    (7, "\U0001f600 日本語 テキスト — «ünïcode» 4111111111111111", "ja", "b", 30),
]


@pytest.fixture(scope="module")
def odd(spark):
    extra = spark.createDataFrame(ODD, DOCS)
    for name in ("tokens", "id", "rank", "shard", "key", "size", "path", "a", "b", "rate", "copies", "is_toxic", "keep", "spans", "covered", "component", "fingerprint", "weight", "__bucket", "n"):
        extra = extra.withColumn(name, F.lit("clash"))
    return extra


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# --- 1


def test_bpe_tree_is_exact():
    b, r = bpe.load(bpe.tokenizer_path()), random.Random(1)
    for _ in range(400):
        letters = r.choice(["ab", "aeiou th", "abcdefghijklmnopqrstuvwxyz", "a \n", "é漢字 .x", "'ls1 .\n\t", "  \n"])
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 300)))
        assert b.encode_tree(text, r.choice([3, 5, 17, 40])) == b.encode(text).tolist()


def test_bpe_decodes_any_ids(spark):
    b = bpe.load(bpe.tokenizer_path())
    ids = b.encode("some words").tolist()
    rows = [(1, ids), (2, [None, *ids]), (3, [-1, *ids]), (4, [*ids, 2**30]), (5, []), (6, None), (None, ids), (1, ids)]
    got = bpe.decode(spark.createDataFrame(rows, "doc_id long, token_ids array<int>").withColumn("text", F.lit("clash"))).collect()
    want = {(1, "some words"), (2, "some words"), (3, "\ufffdsome words"), (4, "some words\ufffd"), (5, ""), (6, None), (None, "some words")}
    assert {(r.doc_id, r.text) for r in got} == want and len(got) == len(rows)


def test_bpe_round_trip(spark, odd, docs, none):
    b = bpe.load(bpe.tokenizer_path())
    for df in (odd, docs):
        rows = bpe.encode(df, leaf_chars=2000).collect()
        assert len(rows) == df.count()
        want = sorted((-1 if r.doc_id is None else r.doc_id, None if r.text is None else b.encode(r.text).tolist()) for r in df.collect() if r.text is not None)
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.token_ids) for r in rows if r.token_ids is not None) == want
        assert all(r.round_trip for r in rows if r.token_ids is not None)
        assert all(r.n_tokens is None and r.round_trip is None for r in rows if r.token_ids is None)
    back = {(r.doc_id, r.text) for r in bpe.decode(bpe.encode(odd)).collect()}
    assert back == {(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()}
    assert bpe.encode(none).count() == 0


# --- 2


def cut_by_hand(rows):
    """Every run of whole parts, as lists of words, compared with all before it."""
    seen, out = set(), {}
    for doc, text in sorted({(d, t) for d, t in rows if t}):
        parts = substrings.sentences(text)
        assert "".join(parts) == text
        words = [p.lower().split() for p in parts]
        for i in (k for k, w in enumerate(words) if w):
            run = []
            for j in range(i, len(parts)):
                run += [tuple(words[j])] if words[j] else []
                if len(run) >= substrings.MIN_SENTENCES and sum(map(len, run)) >= substrings.MIN_WORDS:
                    if tuple(run) in seen:
                        out.setdefault((doc, text), set()).update(range(i, j + 1))
                    seen.add(tuple(run))
                    break
    return {(d, t): t and "".join(s for i, s in enumerate(substrings.sentences(t)) if i not in out.get((d, t), ())) for d, t in rows}


def test_substrings_like_by_hand(docs):
    want = cut_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    got = substrings.dedupe(docs)
    assert {r.doc_id: r.text for r in got.collect()} == {d: t for (d, _), t in want.items()}


def test_substrings_passage_between_others(spark):
    passage = "The first part is said here in full. Then comes a second part, longer than the first one. A third ends it."
    rows = [(1, f"Own words open this. {passage} And own words close it."), (2, f"Other words come first\n{passage} Quite another end of it."), (3, "Nothing of it is here. Not at all, I say.")]
    got = {r.doc_id: r.text for r in substrings.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1]
    assert "second part" not in got[2] and got[2].startswith("Other words") and got[2].endswith("another end of it.")


def test_substrings_one_whole_sentence_of_a_passage(spark):
    word = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    passage = f"{word('a', 19)}. {word('b', 16)}. {word('c', 22)}"
    rows = [(1, f"One {passage} two. An end."), (2, f"Three {passage} four. Another end."), (3, f"Nothing else. {word('d', 22)}. Short end."), (4, f"Of it. {word('d', 22)}. Short end."), (5, f"Here. {word('e', 14)}. Short end."), (6, f"There. {word('e', 14)}. Short end.")]
    got = {r.doc_id: r.text for r in substrings.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1]
    assert "b0 " not in got[2] and got[2].endswith("Another end.")
    assert got[4] == "Of it. " and got[6] == rows[5][1]  # a sentence and a short one aren't long enough


def test_substrings_odd(odd, none):
    rows = substrings.dedupe(odd).collect()
    assert len(rows) == len(ODD)
    assert [r.text for r in rows if r.doc_id == 2] == [None] and [r.text for r in rows if r.doc_id == 3] == [""]
    assert {r.text for r in rows if r.doc_id == 1} == {x[1] for x in ODD[:3]}
    assert len([r for r in rows if r.doc_id == 6][0].text) < 400
    assert substrings.dedupe(none).count() == 0


# --- 3


def by_hand(ids, x, least):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    own = {i: i for i in ids}

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for a, b in zip(*np.nonzero(x @ x.T >= least)):
        p, q = sorted((root(ids[a]), root(ids[b])))
        own[q] = p
    return {i: root(i) for i in ids}


def test_hnsw_components(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((300, 16))
    x = np.concatenate([base, base[:100] + 0.02 * r.standard_normal((100, 16)), np.repeat(base[:1], 60, axis=0) + 0.01 * r.standard_normal((60, 16))]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.component for r in hnsw.near_duplicates(df).collect()}
    assert got == by_hand(list(range(len(x))), x, hnsw.THRESHOLD)


def test_hnsw_recall():
    x = np.random.default_rng(2).standard_normal((3000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b, _ = hnsw.Graph(x).near(x, 0.6, 64)
    i, j = np.nonzero(x @ x.T >= 0.6)
    want = set(zip(i.tolist(), j.tolist()))
    assert len(want & set(zip(a.tolist(), b.tolist()))) >= 0.9 * len(want)


def test_hnsw_many_near_identical():
    r = np.random.default_rng(3)
    x = np.concatenate([r.standard_normal(32) + 0.02 * r.standard_normal((6000, 32)), r.standard_normal((500, 32))]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    began, g = time.thread_time(), hnsw.Graph(x)
    g.group(0.95)
    i, label = g.near_groups(x, 0.95, hnsw.BEAM)
    assert len(set(g.labels[:6000])) == 1 and len(set(g.labels)) == 501 and len(i) >= 0.99 * len(x) and (label == g.labels[i]).all()
    assert time.thread_time() - began < 120


def test_hnsw_widens_until_the_audit_passes(spark, monkeypatch):
    r = np.random.default_rng(4)
    base = r.standard_normal((400, 8))
    x = np.concatenate([base, base[:150] + 0.05 * r.standard_normal((150, 8))]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    want = by_hand(list(range(len(x))), x, hnsw.THRESHOLD)
    monkeypatch.setattr(hnsw, "BEAM", 1)
    monkeypatch.setattr(hnsw, "WIDEST", 1)
    assert {q.vec_id: q.component for q in hnsw.near_duplicates(df, recall=1.0).collect()} == want


def test_hnsw_visits_few_cells(spark, monkeypatch):
    """Near duplicates are found over many cells, a cluster in parts of one, and without a visit to every cell."""
    r = np.random.default_rng(6)
    base = r.standard_normal((6000, 32))
    x = np.concatenate([base, base[:300] + 0.1 * r.standard_normal((300, 32)), base[:1] + 0.02 * r.standard_normal((700, 32))]).astype(np.float32)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    widths, visits = [], hnsw._visits
    monkeypatch.setattr(hnsw, "CELL", 100)
    monkeypatch.setattr(hnsw, "PART", 150)
    monkeypatch.setattr(hnsw, "_visits", lambda cells, parts, width: (widths.append((width, len(parts), sum(parts.values()))), visits(cells, parts, width))[1])
    got = {q.vec_id: q.component for q in hnsw.near_duplicates(df, recall=0.99).collect()}
    want = by_hand(list(range(len(x))), x, hnsw.THRESHOLD)
    linked = [k for k in want if want[k] != k]
    assert sum(got[k] == want[k] for k in linked) >= 0.95 * len(linked) and len(linked) > 900
    assert all(got[k] >= want[k] for k in want)
    (width, n, parts), = widths
    assert 3 <= width < n / 2 and n > 40 and parts > n


def test_hnsw_graph_of_pivots_finds_the_nearest(monkeypatch):
    x = np.random.default_rng(7).standard_normal((3000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    plain = hnsw.Cells(x[:600], 600).nearest(x, 8)
    monkeypatch.setattr(hnsw, "GRAPHED", 100)
    cells = hnsw.Cells(x[:600], 600)
    assert cells.graph is not None and (cells.nearest(x, 8)[:, 0] == plain[:, 0]).mean() > 0.95


def test_hnsw_lengths_do_not_matter(spark):
    tiny, huge = [1e-30, 2e-30], [1e25, 2e25]
    rows = [(1, tiny), (2, tiny), (3, huge), (4, huge), (5, [1.0, 2.0]), (6, [2.0, -1.0]), (7, [5e-324, 1e-323]), (8, [1e308, 2e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r.vec_id: r.component for r in hnsw.near_duplicates(df).collect()} == {k: 1 for k in (1, 2, 3, 4, 5, 7)} | {6: 6, 8: 8}


def test_hnsw_odd(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.001]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0, None]), (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("component", F.lit("clash")).withColumn("id", F.lit("clash"))
    assert {r.vec_id: r.component for r in hnsw.near_duplicates(df).collect()} == {1: 1, 2: 1} | {k: k for k in range(3, 10)}
    assert hnsw.near_duplicates(df.limit(0)).count() == 0


# --- 4


def test_sharding_proportions(spark, odd, none):
    rows = [(i, "hot" if i % 4 else "cold") for i in range(4000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, source string"), shards=7).collect()
    assert sorted(r.doc_id for r in got) == list(range(4000))
    for k in range(7):
        mine = sorted((r for r in got if r.shard == k), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(1, len(mine) + 1)) and len(mine) in (571, 572)
        assert abs(sum(r.source == "cold" for r in mine) - len(mine) / 4) <= 1.5
    out = sharding.shard(odd, shards=3).collect()
    assert len(out) == len(ODD) and sorted(r.shard for r in out).count(0) in (3, 4)
    assert sharding.shard(none).count() == 0


def test_sharding_buckets_dont_matter(spark, docs, monkeypatch):
    want = {(r.doc_id, r.shard, r.place) for r in sharding.shard(docs).collect()}
    monkeypatch.setattr(sharding, "BUCKET", 9)
    assert {(r.doc_id, r.shard, r.place) for r in sharding.shard(docs).collect()} == want


# --- 5, 8, 10


@pytest.fixture(scope="module")
def held(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    t = d.select("doc_id", "text", "quality", "toxic").toArrow().combine_chunks().sort_by("doc_id")
    even = np.arange(t.num_rows) % 2 == 0
    return t.filter(pa.array(even)), t.filter(pa.array(~even))


def test_toxicity_held_out(held):
    chain = toxicity.train(held[0])
    p, _ = chain.predict(held[1]["text"].combine_chunks())
    said, true = p[:, 1] >= chain.threshold, held[1]["toxic"].to_numpy() > 0
    assert (said & true).sum() >= 0.8 * true.sum() and (said & true).sum() >= 0.9 * said.sum()


def test_knn_held_out(held):
    found = knn.train(held[0])
    texts = held[1]["text"].combine_chunks()
    z = found.project(texts)
    score, _ = found.vote(z)
    s = z[:50] @ found.vectors.T
    for k in range(50):  # by brute force, one text at a time
        best = np.argsort(-s[k], kind="stable")[: knn.NEIGHBOURS]
        w = np.maximum(s[k][best], 1e-6)
        assert abs((w * found.labels[best]).sum() / w.sum() - score[k]) < 1e-3
    said, true = score <= found.threshold, held[1]["quality"].to_numpy() == 0
    assert (said & true).sum() >= 0.7 * true.sum() and (~said & ~true).sum() >= 0.97 * (~true).sum()


def test_classifiers_odd(spark, odd, labels, none):
    more = labels.unionByName(spark.createDataFrame([(None, 1, 1), (1, None, 0), (1, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")).withColumn("text", F.lit("clash"))
    for run, flag in ((toxicity.classify, "is_toxic"), (knn.classify, "keep")):
        rows = run(odd, more).collect()
        assert len(rows) == len(ODD)
        assert all(r[flag] is False for r in rows if r.doc_id in (2, 3))
        assert run(none, more).count() == 0 and run(odd, labels.limit(0)).count() == len(ODD)
    assert {r.p_toxic for r in toxicity.classify(odd, more).collect() if r.doc_id in (2,)} == {None}
    kept = toxicity.reject(odd, more)
    assert kept.columns == odd.columns and kept.where("doc_id in (2, 3)").count() == 2


def test_mixing_rates_like_brute_force(docs, labels):
    r = mixing.mix(docs, labels).toPandas()
    p = r[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
    w = r.n_tokens.to_numpy() / r.n_tokens.sum()
    assert (r.rate >= 0).all() and (np.abs(r.copies - r.rate) < 1).all()
    # brute force: plain projected gradient on all rates at once, for long
    target = np.array(mixing.TARGET)
    x = np.ones(len(p))
    for _ in range(6000):
        x = np.maximum(0, x - (p @ ((w * x) @ p - target) + mixing.RIDGE * (x - 1)) / (1 + mixing.RIDGE))
    goal = lambda z: 0.5 * (((w * z) @ p - target) ** 2).sum() + mixing.RIDGE / 2 * (w * (z - 1) ** 2).sum()
    assert goal(r.rate.to_numpy()) <= goal(x) + 1e-4 and goal(x) < goal(np.ones(len(p)))


def test_mixing_meets_targets_where_it_can(spark):
    r = np.random.default_rng(5)
    p = r.dirichlet([0.3, 0.2, 0.1], 3000)
    n = r.integers(1, 500, 3000)
    rows = [(int(k), *map(float, q)) for k, q in zip(n, p)]
    slim = spark.createDataFrame(rows, "n_tokens long, " + ", ".join(f"p_{d} double" for d in mixing.DOMAINS))
    target = np.array([0.5, 0.3, 0.2])
    rate, _ = mixing.rates(p, mixing.fit_rates(slim, target))
    got = (rate * n / n.sum()) @ p
    assert np.abs(got / got.sum() - target).max() < 1e-3 and (rate >= 0).all()
    few = np.array([0.2, 0.6, 0.2])
    rate, _ = mixing.rates(p, mixing.fit_rates(slim, few))
    got = (rate * n / n.sum()) @ p
    assert np.abs(got / got.sum() - few).max() < 2e-3 and got[0] >= ((n / n.sum()) @ p)[0] - 2e-3


def test_mixing_odd(odd, labels, none):
    out = mixing.mix(odd, labels).collect()
    assert len(out) == len(ODD) and all(r.rate is not None and r.copies >= 0 for r in out)
    assert mixing.mix(none, labels).count() == 0 and mixing.mix(odd, labels.limit(0)).count() == len(ODD)
    assert mixing.apply(odd, labels).columns == odd.columns
    with pytest.raises(ValueError):
        mixing.mix(odd, labels, target=(1.0,))


# --- 6


def trigrams(text):
    """The word trigrams of a text, written without the operator's helpers."""
    words = [w for w in (x.strip("".join(c for c in set(x) if not c.isalnum())) for x in (text or "").lower().split()) if w]
    return {tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))} if words else set()


def jaccards(rows, least):
    sets, out = [trigrams(t) for _, t in rows], {}
    for a in range(len(rows)):
        for b in range(len(rows)):
            if rows[a][0] < rows[b][0] and sets[a] and sets[b]:
                j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                if j >= least:
                    out[rows[a][0], rows[b][0]] = max(j, out.get((rows[a][0], rows[b][0]), 0))
    return out


def pairs_of(df, a, b, *values):
    """Every pair of doc_ids that the rows say, those of equal documents through the one that stands for them."""
    rows = df.collect()
    equal, tied = {}, set()
    for r in rows:
        if all(r[v] == 1 for v in values):
            x, y = sorted((r[a], r[b]))
            equal.setdefault(x, {x}).add(y)
            tied.add((x, y))
    out = {}
    for r in rows:
        for x in equal.get(r[a], {r[a]}):
            for y in equal.get(r[b], {r[b]}):
                if x != y:
                    out[x, y] = out[y, x] = tuple(r[v] for v in values)
    for group in equal.values():
        out |= {(x, y): (1.0,) * len(values) for x in group for y in group if x != y}
    return out


def test_join_like_brute_force(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(800)]
    rows = []
    for k in range(60):
        base = [r.choice(words) for _ in range(r.randint(5, 120))]
        for _ in range(r.choice([1, 1, 2, 5])):
            rows.append((len(rows), " ".join(w if r.random() > 0.03 else r.choice(words) for w in base)))
    rows += [(1000 + k, rows[0][1]) for k in range(5)]
    base = [r.choice(words) for _ in range(200)]
    rows += [(2000 + k, " ".join(w if r.random() > 0.02 else r.choice(words) for w in base)) for k in range(90)]
    want = jaccards(rows, ngram_join.THRESHOLD)
    df = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert df.where("doc_id_a >= doc_id_b").count() == 0
    got = {k: v for k, (v,) in pairs_of(df, "doc_id_a", "doc_id_b", "jaccard").items() if k[0] < k[1]}
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want)
    assert all(abs(got[k] - want[k]) < 1e-5 for k in got)


def test_join_splits_large_nodes(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHAIN", 20)
    rows = [(k, "a common opening of every text here " + " ".join(f"w{k // 2}x{i}" for i in range(40))) for k in range(80)]
    got = pairs_of(ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id_a", "doc_id_b", "jaccard")
    assert {k for k in got if k[0] < k[1]} == {(k, k + 1) for k in range(0, 80, 2)}


def test_join_compares_nodes_that_do_not_part(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHAIN", 10)
    monkeypatch.setattr(ngram_join, "BLOCK", 10)
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(k, f"{text} end{k}") for k in range(45)]
    got = pairs_of(ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id_a", "doc_id_b", "jaccard")
    assert {k for k in got if k[0] < k[1]} == {(a, b) for a in range(45) for b in range(a + 1, 45)}


def links_of(rows, pairs):
    """(class_id, links) of each doc_id by the pairs, written plainly."""
    own = {d: d for d, _ in rows}
    for _ in rows:
        for a, b in pairs:
            own[a] = own[b] = min(own[a], own[b])
    return {d: (own[d], sum(d in p for p in pairs)) for d in own}


@pytest.mark.parametrize("small", [False, True])
def test_join_leaves_nothing_out(spark, monkeypatch, small):
    if small:  # many buckets, chains, batches and blocks
        for name, value in (("POSTINGS", 5000), ("CHAIN", 4), ("MEET", 50), ("BLOCK", 7)):
            monkeypatch.setattr(ngram_join, name, value)
    r = random.Random(17)
    words = [f"v{k}" for k in range(4000)]
    rows = []
    for k in range(50):  # copies edited so much that many lie close to the threshold, either side of it
        base = [r.choice(words) for _ in range(r.choice([6, 20, 60, 150]))]
        for _ in range(6):
            edits = r.choice([0.01, 0.04, 0.07, 0.09])
            rows.append((7 * len(rows) - 900, " ".join(w if r.random() > edits else r.choice(words) for w in base)))
    rows += [(10**12 + k, rows[k][1]) for k in range(40)]
    want = set(jaccards(rows, ngram_join.THRESHOLD))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pairs_of(ngram_join.join(df), "doc_id_a", "doc_id_b", "jaccard")
    assert len(want) > 400 and {k for k in got if k[0] < k[1]} == want
    assert {x.doc_id: (x.class_id, x.links) for x in ngram_join.linked(df).collect()} == links_of(rows, want)


def test_join_odd_has_a_row_for_each_document(odd, none):
    rows = {r.doc_id: (r.class_id, r.links) for r in ngram_join.linked(odd).collect()}
    assert rows == {k: (k, 0) for k in range(1, 8)}
    assert ngram_join.linked(none).count() == 0


def test_join_of_many_near_copies_adds_a_row_each(spark):
    text = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join([*text[: k % 100], f"edit{k}", *text[k % 100 :]])) for k in range(3000)]
    got = ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 3000 and {(r.class_id, r.links) for r in got} == {(0, 2999)}


def test_join_holds_no_pairs_of_two_blocks():
    """The two blocks have a million similar pairs between them; a row for each set comes out."""
    grams = [[*range(30), 1000 + k] for k in range(2000)]
    kinds = {"cell": pa.int64(), "i": pa.int32(), "j": pa.int32(), "own": pa.int32(), "id": pa.int64(), "size": pa.int64(), "copies": pa.int64(), "grams": pa.list_(pa.int64())}
    table = [(5, 0, 1, k % 2, k, 31, 1 + k % 3, g) for k, g in enumerate(grams)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*table), kinds.values())], names=list(kinds))
    out = pa.Table.from_batches(list(ngram_join._compared(0.5, False)(iter([batch]))))
    assert out.num_rows == 2000 and set(out["a"].to_pylist()) == {0}
    copies = [sum(1 + k % 3 for k in range(side, 2000, 2)) for side in (1, 0)]
    assert all(n == copies[k % 2] for k, n in zip(out["b"].to_pylist(), out["value"].to_pylist()))


def test_join_compares_a_dense_cell_in_little_memory():
    """A cell of 2400 sets that are all similar; its pairs, all at once, take over 300 MB."""
    kinds = {"cell": pa.int64(), "i": pa.int32(), "j": pa.int32(), "own": pa.int32(), "id": pa.int64(), "size": pa.int64(), "copies": pa.int64(), "grams": pa.list_(pa.int64())}
    table = [(5, 0, 0, 0, k, 31, 1, [*range(30), 1000 + k]) for k in range(2400)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*table), kinds.values())], names=list(kinds))
    tracemalloc.start()
    try:
        out = pa.Table.from_batches(list(ngram_join._compared(0.5, False)(iter([batch]))))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert set(out["value"].to_pylist()) == {2399} and set(out["a"].to_pylist()) == {0} and out.num_rows == 2400
    assert most < 150e6


def test_join_cells_have_a_bound(spark):
    """Components of almost a block never meet three in a cell, whatever their hashes."""
    rows = [(k, 1100 - k % 7, 1000, 1) for k in range(300)] + [(1000, 5000, 1000, 5)]
    room = spark.createDataFrame(rows, "component long, m long, g long, blocks int")
    got = ngram_join.with_cells(room, 300).join(room.drop("blocks"), "component").collect()
    filled = {}
    for x in got:
        if x.blocks == 1:
            filled[x.cell] = filled.get(x.cell, 0) + x.m
    assert len(got) == 301 and max(filled.values()) < 2 * ngram_join.BLOCK and max(filled) < 0


def test_join_takes_many_buckets_in_few_tasks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "POSTINGS", 50)
    r = random.Random(8)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(30)) for _ in range(200)]
    docs = spark.createDataFrame([(i, texts[i // 2] + " end" * (i % 2)) for i in range(400)], "doc_id long, text string")
    scratch = Scratch(spark, "few-tasks")
    _, found = ngram_join.similar(docs, scratch, 3, 0.5, False)
    assert sorted((x.a, x.b, x.value) for x in found.collect()) == [(i - i % 2, i, 1.0) for i in range(400)]
    files = Counter(p.parent.name for p in Path(scratch.base.removeprefix("file:")).glob("*/part-*"))
    assert max(files.values()) <= 64


def test_join_meets_in_little_memory(monkeypatch):
    """Edges are joined to trees as they come, and still join the same documents."""
    monkeypatch.setattr(ngram_join, "EDGES", 50)
    names = ["gram", "size", "left", "id"]
    rows = [(g, 10, 10, 1000 * (g // 2) + k) for g in range(40) for k in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
    out = pa.Table.from_batches(list(ngram_join._meeting(0.5)(iter([batch]))))
    own = dict(zip(out["u"].to_pylist(), out["v"].to_pylist()))
    assert out.num_rows == 20 * 59 and all(v == u // 1000 * 1000 for u, v in own.items())


def test_join_odd(odd, none):
    out = ngram_join.join(odd).collect()
    assert all(r.doc_id_a is not None and r.doc_id_b is not None and 5 not in (r.doc_id_a, r.doc_id_b) for r in out)
    assert ngram_join.join(none).count() == 0
    kept = ngram_join.dedupe(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    assert ngram_join.dedupe(none).count() == 0


def test_dedupe_keeps_one_of_a_group(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(5, text), (3, text), (4, text + " more"), (9, "something else altogether here"), (None, text), (8, None)]
    kept = ngram_join.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept) == [-1, 3, 8, 9]


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (103, 101), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100, 103: 100}


# --- 7


def test_pii_on_new_candidates(held):
    found = pii.train(sorted(held[0]["text"].to_pylist()[:600]), each=200)
    x, y = pii.candidates(held[1]["text"].to_pylist()[:600], 80, 99)
    p = found.score(x)
    for k, kind in enumerate(pii.KINDS):
        mine = x[:, 0] == k
        said, true = p[mine] >= found.thresholds[k], y[mine] > 0
        assert (said & true).sum() >= 0.95 * true.sum() and (said & true).sum() >= 0.93 * said.sum(), kind


def test_pii_redacts(spark, odd, none):
    texts = ["Mail a.b@example.com or +1 (555) 123-4567, host 10.20.30.40.", "card 4111111111111111 4111111111111112 end", 'token = "0123456789abcdef0123456789abcdef01234567" x', "Under CC BY-NC 4.0. See version 1.2.3 of 2024-05-17.", "", None]
    got = {r.doc_id: r for r in pii.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0].text == "Mail <EMAIL> or <PHONE>, host <IP>."
    assert "4111111111111111" not in got[1].text and "4111111111111112" in got[1].text
    assert got[2].text == 'token = "<SECRET>" x' and got[3].text == texts[3] and got[3].spans == []
    assert got[4].text == "" and got[4].n_redacted == 0 and got[5].text is None and got[5].spans is None
    for i, r in got.items():
        assert all(texts[i][s.start : s.stop] not in r.text for s in r.spans or [])
    rows = pii.redact(odd).collect()
    assert len(rows) == len(ODD) and [r.text for r in rows if r.doc_id == 5] == ["x" * 100_000]
    assert all("me@example.com" not in (r.text or "") for r in rows)
    assert pii.apply(odd).columns == odd.columns and pii.redact(none).count() == 0


def test_pii_regions_change_nothing(held):
    for text in held[1]["text"].to_pylist()[:150]:
        whole = set()
        regions, pii.regions = pii.regions, lambda t: [(0, len(t))]
        try:
            whole = set(pii.propose(text))
        finally:
            pii.regions = regions
        assert set(pii.propose(text)) == whole


# --- 9


def test_chunks_follow_the_content():
    r = random.Random(4)
    text = "".join(r.choice("abcdefghij klmnop") for _ in range(60_000)).encode()
    n, whole = fingerprints.chunks([text, b"head of another kind " + text, b"", text[:50]])
    assert b"".join(whole[: n[0]]) == text and n[2] == 0 and n[3] == 1
    a, b = set(whole[: n[0]]), set(whole[n[0] : n[0] + n[1]])
    assert len(a & b) >= 0.95 * len(a)
    assert all(len(x) <= fingerprints.MOST for x in whole) and 300 < np.mean([len(x) for x in whole[: n[0]]]) < 800


def cut_plainly(text):
    """(digest, size, how often before) of the chunks of a text, cut byte by byte."""
    import xxhash

    data = " ".join(text.lower().split()).encode()
    least, usual, most, strict, loose, last = fingerprints.FINE
    out, start, h, seen = [], 0, 0, {}
    for i, _ in enumerate(data):
        h = sum(int(fingerprints.GEAR[data[i - d]]) << d for d in range(last) if i >= d) % (1 << 32)
        n = i + 1 - start
        if n == most or n > least and h < 1 << (32 - (strict if n <= usual else loose)):
            out.append(data[start : i + 1])
            start = i + 1
    out += [data[start:]] if start < len(data) else []
    rows = []
    for c in out:
        seen[c] = seen.get(c, -1) + 1
        rows.append((xxhash.xxh3_64_intdigest(c) >> 7, len(c), seen[c]))
    return rows


def test_containment_like_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.text and len(r.text) < 6000]
    got = pairs_of(fingerprints.containment(docs.where("length(text) < 6000")), "contained_id", "container_id", "containment", "coverage")
    sets = {d: set(cut_plainly(t)) for d, t in rows}
    weigh = {d: sum(c[1] for c in s) for d, s in sets.items()}
    want = {}
    for a in sets:
        for b in sets:
            if a != b and weigh[a] and weigh[a] <= weigh[b]:
                shared = sum(c[1] for c in sets[a] & sets[b])
                if shared >= fingerprints.CONTAINED * weigh[a] or shared >= fingerprints.NEAR * weigh[a] and shared >= fingerprints.COVERED * weigh[b]:
                    want[a, b] = (shared / weigh[a], shared / weigh[b])
    assert len(want) > 20 and {tuple(sorted(k)) for k in got} == {tuple(sorted(k)) for k in want}
    assert all(max(abs(x - y) for x, y in zip(got[k], want[k])) < 1e-5 for k in want)


def test_containment_finds_near_copies_by_words(spark, docs):
    r = random.Random(9)
    texts = [x.text for x in docs.where("text is not null").orderBy("doc_id").limit(120).collect()]
    texts = [x for x in texts if 30 <= len(x.split()) <= 2000]
    edited = [" ".join(w if r.random() > 0.06 else "other" + str(r.randrange(10**6)) for w in x.split()) for x in texts]
    rows = list(enumerate([*texts, *edited]))
    words = [x.lower().split() for _, x in rows]
    grams = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in words]
    want = {(a, b) for a in range(len(rows)) for b in range(a) if len(grams[a] & grams[b]) >= 0.5 * len(grams[a] | grams[b])}
    got = {(max(k), min(k)) for k in pairs_of(fingerprints.containment(spark.createDataFrame(rows, "doc_id long, text string")), "contained_id", "container_id", "containment", "coverage")}
    assert len(want) >= 60 and len(want & got) >= 0.85 * len(want), (len(want), len(want & got))
    assert sum(10 * len(grams[a] & grams[b]) < min(len(grams[a]), len(grams[b])) for a, b in got) <= 0.02 * len(got)


def test_matches_add_a_row_for_each_document(docs, odd, none):
    some = docs.where("length(text) < 6000")
    rows = [(r.doc_id, r.text) for r in some.collect()]
    pairs = {tuple(sorted(k)) for k in pairs_of(fingerprints.containment(some), "contained_id", "container_id", "containment", "coverage")}
    assert len(pairs) > 20
    assert {x.doc_id: (x.class_id, x.links) for x in fingerprints.linked(some).collect()} == links_of(rows, pairs)
    assert {r.doc_id: (r.class_id, r.links) for r in fingerprints.linked(odd).collect()} == {k: (k, 0) for k in range(1, 8)}
    assert fingerprints.linked(none).count() == 0


def test_matches_count_digests_a_share_at_a_time(docs, monkeypatch):
    saved, save = [], Scratch.save

    def spy(self, df):
        out = save(self, df)
        if out.columns == ["digest", "fingerprint", "df"]:
            saved.append({x.digest for x in out.select("digest").distinct().collect()})
        return out

    monkeypatch.setattr(Scratch, "save", spy)
    found = sorted(map(tuple, fingerprints.containment(docs).collect()))
    both = saved.copy()
    assert max(map(len, both)) < 0.6 * sum(map(len, both)) and not set.intersection(*both)
    monkeypatch.setattr(fingerprints, "PASSES", 1)
    assert found == sorted(map(tuple, fingerprints.containment(docs).collect()))
    assert saved[-1] == set.union(*both)


def test_matches_list_no_pairs_of_near_copies(spark, monkeypatch):
    r = random.Random(3)
    words = ["word" + str(r.randrange(10**6)) for _ in range(150)]
    rows = [(k, " ".join(w if r.random() > 0.06 else "other" + str(r.randrange(10**6)) for w in words)) for k in range(60)]
    rows += [(100 + k, " ".join(words[k * 10 : k * 10 + 40])) for k in range(8)]
    docs, saved, save = spark.createDataFrame(rows, "doc_id long, text string"), [], Scratch.save

    def spy(self, df):
        out = save(self, df)
        saved.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(Scratch, "save", spy)
    found = {x.doc_id: (x.class_id, x.links) for x in fingerprints.linked(docs).collect()}
    assert sum(n for _, n in found.values()) > 3000
    assert not any(columns == ["a", "b"] for columns, _ in saved) and max(n for columns, n in saved if columns == ["guest", "cell"]) < 200
    # small blocks, few guests and sets at a time
    for name, value in (("BLOCK", 9), ("LOAD", 4000), ("SPREAD", 1), ("MEETINGS", 50)):
        monkeypatch.setattr(fingerprints, name, value)
    assert found == {x.doc_id: (x.class_id, x.links) for x in fingerprints.linked(docs).collect()}


def test_containment_odd(odd, none):
    out = fingerprints.containment(odd).collect()
    assert all(r.contained_id is not None and r.container_id is not None for r in out)
    assert fingerprints.containment(none).count() == 0


def test_bag_of_words():
    t = X.tokens(pa.array(["The CAT, the cat!", None, "", "1 x"]))
    assert t.counts.tolist() == [4, 0, 0, 2]
    doc, feature, times = X.bag(t, pa.array(["cat", "the", "\x00A,"]))
    assert list(zip(doc.tolist(), feature.tolist(), times.tolist())) == [(0, 0, 2), (0, 1, 2), (0, 2, 1)]


def test_near_copies_group_and_others_do_not():
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = [r.sample(vocabulary, 150) for _ in range(200)]
    copies = [[*x[:70], "edited", *x[71:]] for x in texts]
    group = X.minhash_groups(X.tokens(pa.array([" ".join(x) for x in [*texts, *copies]] + ["", None])))
    assert len(set(group[:200].tolist())) == 200
    assert group[:200].tolist() == group[200:400].tolist() and group[400] == group[401]
