"""Exact, suffix-sorted and SimHash deduplication against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.llm import exact_dedup, simhash, suffix_dedup
from tests.conftest import SF


# -- exact ----------------------------------------------------------------------------------

def _groups(rows, keep):
    by = defaultdict(list)
    for d, t in rows:
        by[t].append(d)
    pick = (lambda ids: max((d for d in ids if d is not None), default=None)) if keep == "largest" else (
        lambda ids: min((d for d in ids if d is not None), default=None))
    return {t: (pick(ids), len(ids)) for t, ids in by.items()}


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_groups(awkward, empty, plain, keep):
    want = _groups(plain, keep)
    got = exact_dedup.group_copies(awkward, keep=keep).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == Counter(
        (d, *want[t], hashlib.sha256(t.encode()).hexdigest()) for d, t in plain)
    assert sum(r["kept"] for r in got) == len(want)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup.group_copies(empty, keep=keep).count() == 0


def test_exact_keeps_whole_rows(awkward, empty, plain):
    out = exact_dedup.deduplicate(awkward)
    assert out.dtypes == awkward.dtypes
    rows = out.collect()
    assert len(rows) == len({t for _, t in plain})
    source = Counter(map(tuple, awkward.collect()))
    assert all(source[tuple(r)] for r in rows)
    assert exact_dedup.deduplicate(empty).count() == 0


def test_exact_hot_text_is_dealt_out(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        F.concat(F.lit("t"), (F.col("id") % 700).cast("string"))).alias("text"))
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = _groups(rows, "largest")
    hot = exact_dedup._hot_texts(df.select(F.col("text").alias("__text")), 4).collect()
    assert len(hot) == 1 and hot[0]["__salts"] > 1
    got = exact_dedup.group_copies(df).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got} == {d: want[t] for d, t in rows}
    assert sorted(r["doc_id"] for r in got if r["kept"]) == sorted(k for k, _ in want.values())


def test_exact_normalised(spark):
    df = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "c")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.group_copies(df, normalise=F.lower, keep="smallest").collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (3, True)}
    assert {r["text"] for r in exact_dedup.deduplicate(df, normalise=F.lower).collect()} == {"a B", "c"}


def test_exact_needs_no_python(spark):
    plan = exact_dedup.group_copies(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- suffixes -------------------------------------------------------------------------------

def _brute_repeats(texts, n=200):
    seen = Counter(t[i:i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        spans = suffix_dedup.merge_spans([(i, i + n) for i in range(len(t) - n + 1) if seen[t[i:i + n]] > 1])
        edges = [0, *[x for s in spans for x in s], len(t)]
        out.append((len(t), sum(b - a for a, b in spans), len(spans),
                    hashlib.sha256(b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2]))).hexdigest()))
    return out


def test_collection_order_is_suffix_order():
    rng = random.Random(5)
    strings = [[rng.randint(1, 3) for _ in range(rng.randint(1, 12))] for _ in range(40)]
    flat = np.array([x for s in strings for x in s])
    sizes = np.array([len(s) for s in strings])
    row, size, common = suffix_dedup.sort_collection(flat, np.cumsum(sizes) - 1, sizes, 1)
    suffixes = [strings[r][len(strings[r]) - n:] for r, n in zip(row.tolist(), size.tolist())]
    assert suffixes == sorted(suffixes)
    assert Counter(zip(row.tolist(), size.tolist())) == Counter((i, n) for i, s in enumerate(strings) for n in range(len(s) + 1))
    for a, b, n in zip(suffixes, suffixes[1:], common[1:].tolist()):
        assert n == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_repeated_windows_of_a_collection():
    rng = random.Random(3)
    base = bytes(rng.choice(b"abcd") for _ in range(2500))
    for _ in range(20):
        strings = []
        for _ in range(rng.randint(1, 20)):
            a = rng.randint(0, 2100)
            s = bytearray(base[a:a + rng.randint(200, 380)])
            if rng.random() < 0.4:
                s[rng.randrange(len(s))] = 120
            strings.append(bytes(s) if rng.random() < 0.9 else b"a" * len(s))
        weights = np.array([rng.choice([1, 1, 2]) for _ in strings], float)
        seen = Counter()
        for s, w in zip(strings, weights):
            for i in range(len(s) - 199):
                seen[s[i:i + 200]] += w
        want = [(k, i) for k, s in enumerate(strings) for i in range(len(s) - 199) if seen[s[i:i + 200]] >= 2]
        assert list(zip(*(x.tolist() for x in suffix_dedup.repeated_windows(strings, weights)))) == want


def test_anchors_own_every_window_once():
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"ab cde") for _ in range(rng.choice([0, 10, 199, 200, 201, 400, 1500]))) for _ in range(20)]
    n, _, pos, first, last = suffix_dedup.anchors_of_texts(texts)
    owned = sorted((i, p) for i, a, b in zip(n.tolist(), first.tolist(), last.tolist()) for p in range(a, b + 1))
    assert owned == [(i, p) for i, t in enumerate(texts) for p in range(len(t) - 199)]
    assert ((last <= pos) & (pos + suffix_dedup.GRAM <= first + suffix_dedup.LENGTH)).all()


def _suffix_texts():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefg é") for _ in range(7))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(rng.randint(5, 80))) for _ in range(40)]
    for k in range(0, 40, 3):
        texts[k] = texts[k][:30] + passage[rng.randint(0, 40):] + texts[k][30:]
    return [*texts, texts[0], texts[0], "z" * 900, None, "", "long " * 30_000]


@pytest.mark.parametrize("group", [2000, 3])
def test_suffix_dedup(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP_STRINGS", group)  # 3: every larger group is cut as a hot one
    texts = _suffix_texts()
    rows = [(None if i == 1 else i, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = Counter(map(tuple, suffix_dedup.digest_repeats(df).collect()))
    want = _brute_repeats([(t or "").encode() for _, t, _ in rows])
    assert got == Counter((d, *w) for (d, _, _), w in zip(rows, want))


def test_suffix_dedup_empty_and_awkward(awkward, empty, plain):
    assert suffix_dedup.digest_repeats(empty).count() == 0
    want = _brute_repeats([t.encode() for _, t in plain])
    got = Counter(map(tuple, suffix_dedup.digest_repeats(awkward).collect()))
    assert got == Counter((d, *w) for (d, _), w in zip(plain, want))


# -- SimHash --------------------------------------------------------------------------------

def _fingerprint(text, k=3):
    from xxhash import xxh64_intdigest
    w = text.encode().lower().split()
    k = min(k, len(w))
    h = [xxh64_intdigest(b" ".join(w[i:i + k]), 42) for i in range(len(w) - k + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(fps, ids, radius=2):
    u = sorted(set(fps))
    parent = {x: x for x in u}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(u):
        for b in u[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for f, d in zip(fps, ids):
        if d is not None:
            least[root(f)] = min(least.get(root(f), d), d)
    return [least.get(root(f)) for f in fps]


def test_bk_tree_finds_all_within_radius():
    rng = random.Random(1)
    centre = [rng.getrandbits(64) for _ in range(5)]
    fps = list({c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in centre for _ in range(60)})
    tree = simhash.BKTree(fps)
    for x in fps[:80]:
        assert sorted(tree.within(x, 2)) == [i for i, f in enumerate(fps) if (f ^ x).bit_count() <= 2]


@pytest.mark.parametrize("rows", [20_000, 4])
def test_links_and_components(spark, monkeypatch, rows):
    monkeypatch.setattr(simhash, "SHARD_ROWS", rows)  # 4: shards are dealt out as several trees
    rng = random.Random(2)
    centre = [rng.getrandbits(64) for _ in range(6)]
    fps = [c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for c in centre for _ in range(40)] + [0, 0, 3]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame(list(zip(signed, range(len(fps)))), "fp long, least long").groupBy("fp").agg(F.min("least").alias("least"))
    got = {r["fp"]: r["component"] for r in simhash.spread_minimum(nodes, simhash.links(nodes.select("fp"))).collect()}
    want = _components(fps, list(range(len(fps))))
    assert [got[s] for s in signed] == want


def test_simhash_awkward(awkward, empty, plain):
    fps = [_fingerprint(t) for _, t in plain]
    want = _components(fps, [d for d, _ in plain])
    got = simhash.near_duplicates(awkward).collect()
    assert Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got) == Counter(
        (d, f, c) for (d, _), f, c in zip(plain, fps, want))
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_first(awkward)
    assert kept.columns == awkward.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(d for (d, _), c in zip(plain, want) if d == c)
    assert simhash.keep_first(empty).count() == 0


def test_queries_on_tables(spark):
    from foldwise.llm.queries import QUERIES
    docs = [(r[0], r[1] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    fps = [_fingerprint(t) for _, t in docs]
    want = _components(fps, [d for d, _ in docs])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op10_simhash"](spark, SF).collect()}
    assert got == {d: (f"{f:016x}", c) for (d, _), f, c in zip(docs, fps, want)}
    want = _brute_repeats([t.encode() for _, t in docs])
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op3_suffix_dedup"](spark, SF).collect()}
    assert got == {d: w for (d, _), w in zip(docs, want)}
