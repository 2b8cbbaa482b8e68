"""Token files, token counts, BPE: against the libraries, and round trips."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from foldwise.llm import bpe, pretok, simple8b, token_counts
from tests.conftest import SF

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
WHITE = P.PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
PIECES = ["a", "b", " ", "Z", "\n", "\r\n", "'", "'s", "'re", "'ll", "1", "²", "é", "日", " ", " ", "!!", "the",
          " ing", "<|endoftext|>", "x" * 70, "\U0001f600", "\x1c", "\x00"]
texts_st = st.lists(st.lists(st.sampled_from(PIECES), max_size=40).map("".join), max_size=6)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def tik():
    import tiktoken
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@given(texts_st)
@settings(max_examples=150, deadline=None)
def test_scan_cuts_like_the_pattern(texts):
    slices, first = pretok.split(texts)
    got = [slices[a:b] for a, b in zip(first[:-1], first[1:])]
    assert got == [regex.findall(WHITE, t) for t in texts]


def test_scan_is_associative():
    rng = np.random.default_rng(0)
    a, b, c = rng.integers(0, len(pretok.MAPS), (3, 500))
    assert (pretok.THEN[pretok.THEN[a, b], c] == pretok.THEN[a, pretok.THEN[b, c]]).all()


@given(texts_st)
@settings(max_examples=60, deadline=None)
def test_bpe_equals_tiktoken_and_decodes(tik, texts):
    c = bpe.coder(RANKS)
    ids, offs = c.encode(texts)
    for t, a, b in zip(texts, offs[:-1], offs[1:]):
        assert ids[a:b].tolist() == tik.encode_ordinary(t)
        data, at = c.decode(ids[a:b])
        assert data.tobytes() == t.encode() and at[-1] == len(t.encode())


def test_long_slices_merge_alike(tik):
    for s in ("x" * 3000, "ab" * 2000, " " * 999 + "a", "日本" * 500):
        ids, _ = bpe.coder(RANKS).encode([s])
        assert ids.tolist() == tik.encode_ordinary(s)


@given(texts_st)
@settings(max_examples=60, deadline=None)
def test_prefix_counts_equal_library(library, texts):
    got = token_counts.counter(JSON).totals(texts)
    assert got.tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_every_prefix_and_truncation(library):
    rng = random.Random(1)
    c = token_counts.counter(JSON)
    for _ in range(40):
        t = "".join(rng.choice([p for p in PIECES if "<|" not in p]) for _ in range(25))
        ends, counts = c.prefix_counts(t)
        want = [len(library.encode(t[:n], add_special_tokens=False).ids) for n in range(1, len(t) + 1)]
        assert counts.tolist() == want
        assert ends.tolist() == [len(t[:n].encode()) for n in range(1, len(t) + 1)]
        cut = c.truncate(t, 5)
        assert len(library.encode(cut, add_special_tokens=False).ids) <= 5
        assert cut == t or all(n > 5 for n in want[len(cut):len(cut) + 1])


@given(st.lists(st.integers(0, 60).flatmap(lambda b: st.integers(0, 2**b - 1)), max_size=400))
@settings(max_examples=100, deadline=None)
def test_simple8b_round_trip(ids):
    x = np.array(ids, np.uint64)
    words = simple8b.pack(x)
    assert simple8b.unpack(words, len(x)).tolist() == ids


def test_simple8b_words_marks_and_limits():
    x = np.arange(50_000, dtype=np.uint64)
    data = simple8b.block(np.array([1, 2]), x, np.array([0, 10, 50_000]))
    marks = simple8b.HEAD.unpack_from(data)[5]
    got = [simple8b.unpack_from_mark(data, 0, m) for m in range(marks)]
    assert np.concatenate([g for _, g in got]).tolist() == x.tolist()
    assert [f for f, _ in got] == np.cumsum([0, *[len(g) for _, g in got]])[:-1].tolist()
    assert len(simple8b.pack(np.zeros(60, np.uint64))) == 1
    with pytest.raises(ValueError):
        simple8b.pack(np.array([1 << 60], np.uint64))


def _want_index(library, rows):
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, library, awkward, empty, plain, tmp_path):
    out = str(tmp_path / "ids")
    simple8b.write_ids(awkward, JSON, out)
    got = [tuple(r) for r in simple8b.document_index(spark, out).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert Counter(got) == Counter(_want_index(library, plain))
    whole = simple8b.read_ids(spark, out).where("doc_id = 7").first()["ids"]
    assert whole == library.encode(dict(plain)[7], add_special_tokens=False).ids + [2]
    simple8b.write_ids(empty, JSON, out + "-none")
    assert simple8b.document_index(spark, out + "-none").count() == 0


def test_count_and_bpe_awkward(spark, library, tik, awkward, empty, plain):
    got = token_counts.count_documents(awkward, JSON).collect()
    want = [(d, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for d, t in plain]
    assert Counter((r[0], r[1], r[2]) for r in got) == Counter(want)
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    got = bpe.round_trip(awkward, RANKS).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(d, len(i), sha(",".join(map(str, i)).encode()), sha(t.encode())) for d, t in plain for i in [tik.encode_ordinary(t)]]
    assert Counter(map(tuple, got)) == Counter(want)
    back = bpe.decode_documents(bpe.encode_documents(awkward, RANKS), RANKS).collect()
    assert Counter((r["doc_id"], bytes(r["data"])) for r in back) == Counter((d, t.encode()) for d, t in plain)
    for df in (token_counts.count_documents(empty, JSON), bpe.round_trip(empty, RANKS), bpe.encode_documents(empty, RANKS)):
        assert df.count() == 0


@pytest.mark.parametrize("name", ["op1_token_files", "op4_token_counts", "op5_byte_bpe"])
def test_queries_on_tables(spark, library, tik, name):
    from foldwise.llm.queries import QUERIES
    docs = [(r[0], r[1] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES[name](spark, SF).collect()
    if name == "op1_token_files":
        assert Counter(map(tuple, got)) == Counter(_want_index(library, docs))
    elif name == "op4_token_counts":
        assert {r["doc_id"]: r["n_tokens"] for r in got} == {
            d: len(library.encode(t, add_special_tokens=False).ids) for d, t in docs}
    else:
        assert {r["doc_id"]: r["n_tokens"] for r in got} == {d: len(tik.encode_ordinary(t)) for d, t in docs}
        assert {r["doc_id"]: r["decoded_sha256"] for r in got} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in docs}
