"""op11 (lexical search): brute force, the SQL, awkward rows, rounds of items, pruning."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from foldwise.llm import lexical
from foldwise.llm.oracle import oracle_sql
from foldwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return Counter(TERM.findall((text or "").translate(LOWER)))


def brute_force(docs, items, k=20):
    """{(item_id, rank, doc_id, score)} of lists of (id, text)."""
    docs = [(i, terms(t)) for i, t in docs]
    n, total = sum(1 for _, c in docs if c), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c in docs:
            m = 100 - 25 + (25 * sum(c.values()) * n) // max(total, 1)
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m))
                    for t, q in terms(text).items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=repr)


def test_sql_and_brute_force(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = found(QUERIES["op11_lexical_search"](spark, SF))
    want = con.execute(f"SELECT item_id, rank, doc_id, score FROM ({oracle_sql()['op11_lexical_search']})").fetchall()
    assert got == sorted(want, key=repr)
    docs = con.execute("SELECT doc_id, text FROM documents").fetchall()
    assert got == brute_force(docs, con.execute("SELECT item_id, text FROM benchmark").fetchall())


def test_awkward_rows(spark, awkward, plain, empty):
    items = [(1, "Same WORDS, same numbers 12"), (2, None), (3, ""), (3, "other ÜNïcode text"), (None, "same"), (None, "same"),
             (4, "lorem " * 3000 + "dolor"), (5, "nowhere-to-be-found"), (6, "\U0001f600 endoftext")]
    asked = spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, score string")
    got = lexical.search(awkward, asked)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    want = brute_force(plain, [r for r in items if r[1] is not None])
    assert found(got) == want
    assert found(lexical.search(awkward, asked, round_bytes=200)) == want  # several rounds of items
    assert found(lexical.search(empty, asked)) == [] == found(lexical.search(awkward, asked.limit(0)))


def test_many_copies_tie_by_id(spark):
    docs = [(i, "red fish" if i % 3 else "red red fish blue") for i in range(3000, 0, -1)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    items = [(1, "red"), (2, "fish blue"), (3, "fish fish red")]
    got = found(lexical.search(df, spark.createDataFrame(items, "item_id long, text string"), k=5))
    assert got == brute_force(docs, items, 5)


@pytest.mark.parametrize("seed", range(5))
def test_masks_are_pruned_and_exact(seed):
    rng = np.random.default_rng(seed)
    n_docs, n_terms = 600, 14
    holds = rng.random((n_docs, n_terms)) < rng.random(n_terms) * 0.6
    doc, term = np.nonzero(holds)
    tf = rng.integers(1, 6, len(doc))
    n = rng.integers(1, 400, n_docs)
    n = np.maximum(n, np.bincount(doc, tf, n_docs).astype(int))
    total = int(n.sum())
    block = lexical.Block(np.arange(n_docs), np.zeros(n_docs, bool), n, doc, term, tf, n_docs, total)
    w = lexical.weights(holds.sum(axis=0), n_docs)
    query = [(t, int(w[t]) * int(rng.integers(1, 3))) for t in range(n_terms)]
    best = lexical.Best(20)
    formed = lexical.search_block(block, query, best)
    m = 75 + (25 * n * n_docs) // total
    score = np.zeros(n_docs, np.int64)
    np.add.at(score, doc, np.array([q for _, q in query])[term] * ((10 ** 9 * tf) // (1000 * tf + 12 * m[doc])))
    top = np.lexsort((np.arange(n_docs), -score))[:20]
    top = top[score[top] > 0]
    assert best.id.tolist() == top.tolist() and best.score.tolist() == score[top].tolist()
    assert formed < len(np.unique(holds, axis=0))  # not every mask was formed
