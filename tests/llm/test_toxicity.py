"""op13 (toxicity): cosines against brute force, counts over all documents, held-out accuracy, awkward rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.llm import toxicity as tx
from foldwise.llm.queries import QUERIES
from foldwise.llm.terms import words

DATA = "/root/testdata"


def random_index(rng, n=700, terms=60, block=16):
    vectors = []
    for _ in range(n):
        t = np.flatnonzero(rng.random(terms) < rng.choice([0.02, 0.1, 0.3]))
        vectors.append((t, rng.integers(1, 9, len(t))))
    idf = 1 + rng.random(terms) * 6
    return tx.Index(np.arange(n) // 2, rng.integers(0, 2, n), vectors, idf, block), vectors, idf


@pytest.mark.parametrize("seed", range(4))
def test_nearest_is_exact_and_prunes(seed):
    rng = np.random.default_rng(seed)
    index, vectors, idf = random_index(rng)
    dense = np.zeros((len(index.ids), len(idf)))
    dense[index.row, index.term] = index.weight
    assert np.allclose((dense ** 2).sum(axis=1), 1)
    assert len(index.ids) + len(index.empty) == len(vectors)
    scored = 0
    for t, c in vectors[:60]:
        q = np.zeros(len(idf))
        q[t] = (1 + np.log(c)) * idf[t]
        cos = dense @ q / max(1e-300, math.sqrt(q @ q))
        want = [i for i in np.lexsort((np.arange(len(cos)), -np.round(cos, 12))) if cos[i] > 0][:9]
        best, got, blocks = index.nearest(t, c, 9)
        assert np.allclose(got, cos[want]) and len(best) == len(want)
        assert set(best[got > got[-1:].min(initial=0) + 1e-9]) <= set(want)
        scored += blocks
        left, _, _ = index.nearest(t, c, 9, skip=(5, 1))
        assert not [i for i in left if index.ids[i] == 5 and index.toxic[i] == 1]
    assert scored < 60 * index.blocks  # blocks were left out


def test_counts_and_evidence_on_whole_tables(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model, found = tx.learn(docs, labels, F.lit(True))
    texts = {r["doc_id"]: words((r["text"] or "").encode()) for r in docs.collect()}
    toxic = {(r["doc_id"], r["toxic"]) for r in labels.collect() if r["doc_id"] in texts}
    held = {i: {t for w in ws for t in tx.candidates(w)} for i, ws in texts.items()}
    # the terms: log-likelihood ratio by hand
    n = Counter(y for _, y in toxic)
    by = {y: Counter(t for i, z in toxic if z == y for t in held[i]) for y in (0, 1)}

    def ratio(t):
        a, b = by[1][t], by[0][t]
        x = lambda v: v * math.log(v) if v else 0.0
        whole = n[1] + n[0]
        return 2 * (x(a) + x(b) + x(n[1] - a) + x(n[0] - b) + x(whole) - x(a + b) - x(whole - a - b) - x(n[1]) - x(n[0]))

    def lifted(t):
        a, b = by[1][t], by[0][t]
        return abs(math.log((a + .5) * (n[0] - b + .5) / ((b + .5) * (n[1] - a + .5)))) >= math.log(tx.LIFT)
    every = by[0].keys() | by[1].keys()
    chosen = sorted(t for t in every if round(ratio(t), 6) >= 2 * math.log(len(every)) and lifted(t))
    assert 0 < len(chosen) <= tx.MAX_TERMS and len(chosen) == len(model.index.idf)
    df = np.array([sum(t in h for h in held.values()) for t in chosen])
    assert np.allclose(model.index.idf, np.log((1 + len(texts)) / (1 + df)) + 1)
    code = {t: i for i, t in enumerate(chosen)}
    for r in found.collect():
        want = Counter(code[t] for w in texts[r["doc_id"]] for t in tx.candidates(w) if t in code)
        assert r["n"] == len(texts[r["doc_id"]]) and dict(zip(r["terms"], r["tfs"])) == want
    for r in tx.score_documents(docs, labels).collect():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        for e in r["evidence"]:  # examples are labelled rows that may be learned from
            assert (e["doc_id"], e["toxic"]) in toxic and zlib.crc32(str(e["doc_id"]).encode()) % 4 != 2 and 0 < e["cosine"] <= 1 + 1e-9


def test_held_out_accuracy(spark):
    got = QUERIES["op13_toxicity"](spark, f"{DATA}/sf0.1").where("held_out").join(spark.read.parquet(f"{DATA}/sf0.1/labels.parquet"), "doc_id").toPandas()
    assert got[got.toxic == 1].predicted.mean() > 0.8 and got[got.toxic == 0].predicted.mean() < 0.03
    # calibrated: mean score and share of toxic rows agree
    assert abs(got.score.mean() - got.toxic.mean()) < 0.03


def test_awkward_rows(spark, awkward, empty):
    toxic = [(100 + i, f"you idiot number {i} of the idiots") for i in range(30)]
    clean = [(200 + i, f"a calm text number {i} of the series") for i in range(60)]
    rows = spark.createDataFrame(toxic + clean + toxic[:5], "doc_id long, text string")
    docs = awkward.unionByName(rows, allowMissingColumns=True)
    labels = spark.createDataFrame([(i, 1, "clash") for i, _ in toxic] + [(i, 0, "clash") for i, _ in clean]
                                   + [(None, 1, ""), (1, None, ""), (2, 7, ""), (6, 0, ""), (6, 0, ""), (999, 1, "")], "doc_id long, toxic int, text string")
    got = tx.score_documents(docs, labels)
    assert [c for c, _ in got.dtypes[:4]] == ["doc_id", "held_out", "score", "predicted"]
    out = got.collect()
    assert len(out) == docs.count()
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["predicted"] for i, _ in toxic) and not any(by[i]["predicted"] for i, _ in clean)
    assert not any(by[i]["predicted"] for i in (2, 3, 4, 5, 6, -8, None))
    assert tx.score_documents(empty, labels).collect() == []
    assert {r["score"] for r in tx.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    one = {r["score"] for r in tx.score_documents(docs, labels.where("toxic = 0")).collect()}
    assert len(one) == 1 and one.pop() < 0.3


def test_example_bound(spark):
    docs = spark.createDataFrame([(i, "idiot" if i % 3 else f"calm text {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, toxic int")
    model, _ = tx.learn(docs, labels, F.lit(True), max_examples=100)
    assert len(model.index.ids) + len(model.index.empty) == 100
