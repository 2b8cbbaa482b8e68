"""Removal of repeated byte strings by suffix sorting (operator 3).

Every byte covered by a string of LENGTH bytes that also starts anywhere else is removed.
The suffixes are sorted column by column: a collection of strings takes one symbol per string
each round, from the right; every round the new suffixes are merged into the collection's
Burrows-Wheeler transform and array of common prefixes, each read and rewritten front to back
(Bauer, Cox and Rosone 2013; Cox et al. 2016). Neighbours in the final order whose common
prefix has LENGTH bytes are repeats. Symbols are words of WORD bytes; a string enters once for
each of its WORD alignments, so a window is LENGTH / WORD symbols at any start.

One collection for a whole corpus would take as many rounds as the longest text has symbols
and rewrite everything in each. Instead, strings that can share a window meet in small
collections: of the GRAM-byte hashes inside a window the smallest (the last of equals) is its
anchor, a choice that depends on the window's bytes alone. Each anchor owns a run of
windows; their bytes are the string that is sorted, with all strings of the same anchor hash.
Equal windows have equal anchors, so no repeat is missed, and every reported one has been
sorted next to its equal. Only anchors whose hash occurs twice go on. Equal strings of an
anchor enter once, with their number. A hash with more than GROUP_STRINGS different strings
is hot: its strings are cut into runs of 24 windows (then single ones) by their distance from
the anchor, and dealt out by the bytes that the windows of a run have in common.

Tables between the steps lie in the shared folder or in shuffles; a collection (at most
about BATCH_BYTES and one group) is the only thing that a task holds.

Defined results: a null text is an empty one; texts under LENGTH bytes lose nothing; rows
that agree in doc_id and text repeat each other; a null doc_id is an id like others; other
columns are not read; an empty table gives an empty result; texts of any length count whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, texts_of, written

LENGTH, GRAM, WORD = 200, 40, 20
GROUP_STRINGS, BATCH_BYTES = 2000, 1 << 19
#: Bytes of cut runs, and of texts at the end, that a task holds at once.
CUT_BYTES, TEXT_BYTES = 1 << 20, 1 << 21
#: Windows of a run when a hot group is cut, level by level.
CUTS = (24, 1)
_PIECE = 1 << 15  # window starts hashed at once: arrays stay in the cache; below 2 ** 20, see anchors()
_MUL, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""
    n = _PIECE + 4 * LENGTH
    out = []
    for base in (_MUL, pow(_MUL, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """Hash of every GRAM-byte string, from differences of one running sum."""
    up, down = _powers()
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[:len(x)])])
    h = (total[GRAM:] - total[:-GRAM]) * down[:len(x) - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(_MIX)
    h ^= h >> np.uint64(29)
    return h


def sliding_minimum(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    n = len(v) - width + 1
    blocks = -(-len(v) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(v)] = v
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first and last owned window) of the anchors of a byte string, which must
    have LENGTH bytes. Long strings are done in pieces; an anchor at a cut is listed twice."""
    out = []
    for at in range(0, len(data) - LENGTH + 1, _PIECE):
        x = np.frombuffer(data, np.uint8, min(len(data) - at, _PIECE + LENGTH - 1), at)
        h = gram_hashes(x)
        low = np.uint64((1 << 20) - 1)
        # the last of equal hashes is the smallest: low bits count down
        v = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
        where = (low - (sliding_minimum(v, LENGTH - GRAM + 1) & low)).astype(np.int64)
        first = np.flatnonzero(np.diff(where, prepend=-1))
        last = np.append(first[1:], len(where)) - 1
        out.append((h[where[first]].view(np.int64), where[first] + at, first + at, last + at))
    return tuple(np.concatenate(c) for c in zip(*out))


def anchors_of_texts(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, hash, position, first, last) of the anchors of many texts, hashed in a row."""
    out, group, size = [], [], 0

    def flush():
        joined = b"".join(t for _, t in group)
        ends = np.cumsum([len(t) for _, t in group])
        begins = ends - [len(t) for _, t in group]
        h, pos, first, last = anchors(joined)
        # windows over a border of texts fall away; an anchor's run may lose its ends or be cut
        runs = []
        for k in range(2):  # a run of windows is shorter than a text, so it touches two texts at most
            t = np.searchsorted(ends, first if k == 0 else last, side="right")
            t = np.minimum(t, len(group) - 1)
            a, b = np.maximum(first, begins[t]), np.minimum(last, ends[t] - LENGTH)
            ok = a <= b
            if k:
                ok &= t != np.minimum(np.searchsorted(ends, first, side="right"), len(group) - 1)
            runs.append((t[ok], h[ok], pos[ok] - begins[t[ok]], a[ok] - begins[t[ok]], b[ok] - begins[t[ok]]))
        number = np.array([i for i, _ in group])
        t, *rest = (np.concatenate(c) for c in zip(*runs))
        out.append((number[t], *rest))
        group.clear()
    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        if size + len(t) > _PIECE and group:
            flush()
            size = 0
        group.append((i, t))
        size += len(t)
    if group:
        flush()
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(c) for c in zip(*out))


# -- the sorted collection ------------------------------------------------------------------


def _range_minimum(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(v[lo:hi + 1]) by doubling."""
    k = np.frexp(hi - lo + 1)[1] - 1
    out, level = np.zeros(len(lo), v.dtype), v
    for j in range(int(k.max()) + 1 if len(k) else 0):
        here = np.flatnonzero(k == j)
        out[here] = np.minimum(level[lo[here]], level[hi[here] - (1 << j) + 1])
        level = np.minimum(level[:-(1 << j)], level[1 << j:])
    return out


def _merge(old: np.ndarray, new: np.ndarray, at: np.ndarray, kept: np.ndarray) -> np.ndarray:
    out = np.empty(len(old) + len(new), old.dtype)
    out[kept] = old
    out[at] = new
    return out


def sort_collection(symbols: np.ndarray, last: np.ndarray, sizes: np.ndarray, step: int) -> tuple[np.ndarray, ...]:
    """Suffix order of a collection: (string, suffix length, common prefix with the one before).

    String s has sizes[s] symbols, the last at symbols[last[s]], the one before `step` lower.
    Symbols are at least 1 and strings have under 64 of them. Round j puts the j-th last symbol of all strings in front of their
    suffixes. A suffix is kept as its first symbol and the place of the rest, so the order of
    new suffixes follows from the transform without comparing strings.
    """
    m = len(sizes)
    low = (1 << 32) - 1
    order = np.arange(m)  # first symbol << 32 | place of the rest; empty suffixes come first
    # the transform's symbol << 32 | string << 6 | suffix length
    bwt = symbols[last].astype(np.int64) << 32 | np.arange(m) << 6
    common = np.zeros(m, np.uint8)
    place = np.arange(m)
    for j in range(int(sizes.max()) if m else 0):
        act = np.flatnonzero(sizes > j)
        key = (bwt[place[act]] & ~low) | place[act]
        by = np.argsort(key)
        key, act = key[by], act[by]
        before = np.searchsorted(order, key)
        at = before + np.arange(len(key))
        kept = np.ones(len(order) + len(key), bool)
        kept[at] = False
        previous = np.where(sizes[act] > j + 1, symbols[np.maximum(last[act] - step * (j + 1), 0)], 0).astype(np.int64)
        prefixes = common
        moved = np.cumsum(np.bincount(before, minlength=len(order) + 1))  # by how much each place moves up
        order = _merge(order, key, at, kept)
        bwt = _merge(bwt, previous << 32 | act << 6 | j + 1, at, kept)
        common = _merge(common, np.zeros(len(at), np.uint8), at, kept)
        border = np.concatenate([at, at + 1])
        border = border[(border > 0) & (border < len(order))]
        a, b = order[border - 1], order[border]
        same = (a >> 32 == b >> 32) & (a >> 32 > 0)
        common[border] = 0
        deep = _range_minimum(prefixes, (a[same] & low) + 1, b[same] & low)
        common[border[same]] = np.minimum(deep, 250) + 1
        order += moved[order & low]
        place[act] = at
    return (bwt & low) >> 6, bwt & 63, common


def word_ranks(x: np.ndarray) -> np.ndarray:
    """A number for the WORD bytes from each position on, by the rank of a 64-bit hash of them.

    Words in different order than their bytes sort the collection in another, equally good
    order. (A wrong repeat would need two windows that differ in colliding words only.)"""
    n = len(x) - WORD
    wide = np.zeros(len(x) - 7, np.uint64)
    for i in range(8):
        wide = wide << np.uint64(8) | x[i:len(x) - 7 + i]
    h = np.zeros(n, np.uint64)
    for at in (*range(0, WORD - 7, 8), WORD - 8):  # eight bytes at a time; the last ones may overlap
        h = (h ^ wide[at:at + n]) * np.uint64(_MUL)
        h ^= h >> np.uint64(29)
        h *= np.uint64(_MIX | 1)
        h ^= h >> np.uint64(32)
    return (np.unique(h, return_inverse=True)[1] + 1).astype(np.int32)


def repeated_windows(strings: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string, start) of every window of LENGTH bytes that has an equal in the collection;
    a string of weight 2 or more is its own equal. Sorted."""
    need = LENGTH // WORD
    lens = np.fromiter(map(len, strings), np.int64, len(strings))
    begins = np.cumsum(lens) - lens
    x = np.frombuffer(b"".join(strings) + bytes(WORD), np.uint8)
    symbols = word_ranks(x)
    phases = np.minimum(WORD, lens - LENGTH + 1)
    of = np.repeat(np.arange(len(strings)), phases)
    phase = np.arange(len(of)) - np.repeat(np.cumsum(phases) - phases, phases)
    sizes = (lens[of] - phase) // WORD
    last = begins[of] + phase + WORD * (sizes - 1)
    row, size, common = sort_collection(symbols, last, sizes, WORD)
    group = np.cumsum(common < need)
    whole = size >= need
    weight = np.bincount(group[whole], weights=weights[of[row[whole]]], minlength=int(group[-1]) + 1 if len(group) else 0)
    row, size = row[whole & (weight[group] >= 2)], size[whole & (weight[group] >= 2)]
    string, start = of[row], phase[row] + WORD * (sizes[row] - size)
    both = np.sort(string << 32 | start)
    return both >> 32, both & 0xFFFFFFFF


# -- Spark ----------------------------------------------------------------------------------

_OCC = "h long, d long, doc_id long, tag long, first long, windows int, back int"
_CTX = "h long, d long, n long, back int, data binary"


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_64_intdigest, xxh64_intdigest
    for keys, texts in chunks(batches, 1 << 21):
        data = [t.encode() for t in texts]
        t, h, pos, first, last = anchors_of_texts(data)
        back = pos - first
        digest = np.array([xxh3_64_intdigest(data[i][a:b + LENGTH], seed=k) for i, a, b, k in
                           zip(t.tolist(), first.tolist(), last.tolist(), back.tolist())], np.uint64).view(np.int64)
        tags = np.array([xxh64_intdigest(x, 42) for x in data], np.uint64).view(np.int64)  # as F.xxhash64
        yield pa.RecordBatch.from_arrays(
            [pa.array(h), pa.array(digest), keys.take(pa.array(t)), pa.array(tags[t]), pa.array(first),
             pa.array((last - first + 1).astype(np.int32)), pa.array(back.astype(np.int32))],
            names=["h", "d", "doc_id", "tag", "first", "windows", "back"])


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in chunks(batches, 1 << 23):
        h, n = np.unique(anchors_of_texts([t.encode() for t in texts])[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(n, pa.int64())], names=["h", "n"])


def _string_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, its representatives) -> their bytes."""
    for batch in batches:
        for text, reps in zip(batch.column(0), batch.column(1)):
            data, reps = text.as_py().encode(), reps.as_py()
            cols = [[r[c] for r in reps] for c in ("h", "d", "n", "back")]
            strings = [data[r["first"]:r["first"] + r["windows"] + LENGTH - 1] for r in reps]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32()))),
                 pa.array(strings, pa.binary())], names=["h", "d", "n", "back", "data"])


def _sorted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings sorted by group -> ranges of repeated windows; whole groups are sorted together."""
    keys: list[tuple[int, int]] = []
    strings: list[bytes] = []
    weights: list[int] = []
    size = 0

    def solve():
        s, start = repeated_windows(strings, np.array(weights, float))
        new = np.flatnonzero((np.diff(s, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1))
        end = np.append(new[1:], len(s)) - 1
        out = [keys[i] for i in s[new].tolist()] if len(s) else []
        keys.clear(), strings.clear(), weights.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in out], pa.int64()), pa.array([k[1] for k in out], pa.int64()),
             pa.array(start[new] if len(s) else [], pa.int64()), pa.array(start[end] if len(s) else [], pa.int64())],
            names=["h", "d", "a", "b"])
    for batch in batches:
        for h, d, n, data in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
            if size >= BATCH_BYTES and keys[-1][0] != h:
                yield solve()
                size = 0
            keys.append((h, d)), strings.append(data), weights.append(n)
            size += len(data)
    if keys:
        yield solve()


def _cut_rows(step: int):
    """Strings of hot groups -> runs of at most `step` windows, keyed by what these have in common."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        def signed(v):
            return v - (1 << 64) if v >> 63 else v
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        rows, size = [], 0

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                               names=["h", "d", "n", "back", "data", "of_h", "of_d", "skip"])
            rows.clear()
            return batch
        for batch in batches:
            for h, d, n, back, data in zip(*(batch.column(i) for i in range(5))):
                h, d, n, back, data = h.as_py(), d.as_py(), n.as_py(), back.as_py(), data.as_py()
                far, near = back, back - (len(data) - LENGTH)  # distances from window starts to the anchor
                for seg in range(near // step, far // step + 1):
                    q1, q0 = min(far, seg * step + step - 1), max(near, seg * step)
                    part = data[far - q1:far - q0 + LENGTH]
                    lo = far - seg * step  # where the last window of a full run starts; its first one ends below
                    core = data[lo:lo - step + 1 + LENGTH]
                    key = signed(xxh3_64_intdigest(core, seed=(h ^ seg * _MUL) & (1 << 64) - 1))
                    rows.append((key, signed(xxh3_64_intdigest(part, seed=q1)), n, q1, part, h, d, far - q1))
                    size += len(part)
                if size >= CUT_BYTES:  # the runs of a string hold many times its bytes
                    yield flush()
                    size = 0
        if rows:
            yield flush()
    return run


def _solve(strings: DataFrame, level: int = 0) -> DataFrame:
    """(h, d, a, b): ranges of repeated windows in distinct strings (a written table)."""
    big = None
    if level < len(CUTS):
        big = written(strings.groupBy("h").agg(F.count("*").alias("__n")).where(F.col("__n") > GROUP_STRINGS).select("h"), "hot")
        if big.isEmpty():
            big = None
    usual = strings if big is None else strings.join(big, "h", "left_anti")
    usual = usual.select("h", "d", "n", "back", "data")
    found = usual.repartition("h").sortWithinPartitions("h", "d").mapInArrow(_sorted_rows, "h long, d long, a long, b long")
    if big is None:
        return found
    cut = strings.join(big, "h").select("h", "d", "n", "back", "data")
    cut = written(cut.mapInArrow(_cut_rows(CUTS[level]), _CTX + ", of_h long, of_d long, skip long"), "cut-strings")
    distinct = written(cut.groupBy("h", "d").agg(F.sum("n").alias("n"), F.first("back").alias("back"), F.first("data").alias("data")),
                       "cut-distinct")
    inner = _solve(distinct, level + 1).join(cut.select("h", "d", "of_h", "of_d", "skip"), ["h", "d"])
    return found.unionByName(inner.select(F.col("of_h").alias("h"), F.col("of_d").alias("d"), (F.col("a") + F.col("skip")).alias("a"),
                                          (F.col("b") + F.col("skip")).alias("b")))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, spans): byte ranges [a, b) that are covered by repeated strings, overlaps not
    yet merged, over (doc_id, text); tag is the 64-bit hash of a text and tells rows of one doc_id apart."""
    # written, so that the join below has two plain shuffles, of which a hot hash can be split
    twice = docs.mapInArrow(_hash_rows, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    twice = written(twice, "repeated-hashes")
    occ = written(docs.mapInArrow(_anchor_rows, _OCC).join(twice, "h", "left_semi"), "anchors")
    rep = F.min(F.struct("doc_id", "tag", "first", "windows", "back"))
    reps = occ.groupBy("h", "d").agg(F.count("*").alias("n"), rep.alias("r")).select("h", "d", "n", "r.*")
    reps = reps.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("h", "d", "n", "back", "first", "windows")).alias("reps"))
    one = docs.groupBy("doc_id", F.xxhash64("text").alias("tag")).agg(F.first("text").alias("text"))
    texts = one.join(reps.withColumnRenamed("doc_id", "__id").withColumnRenamed("tag", "__tag"),
                     F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("tag") == F.col("__tag")))
    strings = written(texts.select("text", "reps").mapInArrow(_string_rows, _CTX), "strings")
    found = _solve(strings)
    spans = occ.join(found, ["h", "d"]).select(
        "doc_id", "tag", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b") + LENGTH).alias("b")).distinct()
    return spans.groupBy("doc_id", "tag").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, removed array<struct<a, b>>, kept binary) of every row."""
    docs = texts_of(df, id_col, text_col)
    spans = repeated_spans(docs).select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"), "spans")
    rows = docs.withColumn("tag", F.xxhash64("text")).join(
        spans, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("tag") == F.col("__tag")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for batch in batches:
            start = 0
            for keys, texts in chunks([batch], TEXT_BYTES):
                sizes, removed, kept = [], [], []
                for text, spans in zip(texts, batch.column(2).slice(start, len(texts)).to_pylist()):
                    data, merged = text.encode(), merge_spans([(s["a"], s["b"]) for s in spans or []])
                    edges = [0, *[x for s in merged for x in s], len(data)]
                    sizes.append(len(data))
                    removed.append([{"a": a, "b": b} for a, b in merged])
                    kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                start += len(texts)
                yield pa.RecordBatch.from_arrays([keys, pa.array(sizes, pa.int64()), pa.array(removed, kind),
                                                  pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])
    return rows.select("doc_id", "text", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, removed array<struct<a: long, b: long>>, kept binary")


def digest_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    out = without_repeats(df, id_col, text_col)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))
