"""Token counts by prefix dynamic programming (operator 4).

For a byte-level BPE vocabulary the last token of every prefix of a slice is unique: it is the
one suffix token that the last token of the shorter prefix may precede. One table per distinct
slice therefore holds the exact token count of each of its prefixes, and a running sum over
slices the count of each prefix of a text. Truncation and budget questions read these tables.

Defined results: a null or empty text has 0 bytes and 0 tokens; other columns are not read;
a null doc_id stays null; repeated rows and rows that share a doc_id give a result each; an empty table an
empty result; texts count whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import chunks, texts_of
from .pretok import SliceTable, byte_of_char, one_by_one, split, with_special

_LAST = 1 << 60


class PrefixCounter:
    """Counts of tokens at every prefix, for a byte-level BPE tokenizer file (.json)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") or spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["model"]["type"] != "BPE":
            raise ValueError("prefix counts need a byte-level BPE tokenizer without a normalizer")
        byte = byte_of_char()

        def raw(s: str) -> bytes:
            return bytes(byte[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.longest = max(map(len, self.ids))
        self.pair_rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b = raw(a), raw(b)
            pair, whole = (self.ids[a], self.ids[b]), self.ids[a + b]
            self.pair_rank[pair] = r
            parts.setdefault(whole, (*pair, r))
        self.right = {i: self._spine(i, parts, 1) for i in self.ids.values()}
        self.left = {i: self._spine(i, parts, 0) for i in self.ids.values()}
        self._ok: dict[int, bool] = {}
        self.table = SliceTable(one_by_one(lambda s: self.counts_of(s.encode())))

    @staticmethod
    def _spine(i: int, parts, side: int) -> list[tuple[int, int]]:
        """Tokens at one edge of a token, smallest first, each with the rank of the merge that ends it."""
        out, until = [], _LAST
        while True:
            out.append((i, until))
            if i not in parts:
                return out[::-1]
            until = parts[i][2]
            i = parts[i][side]

    def may_follow(self, a: int, b: int) -> bool:
        """Does BPE leave tokens a, b apart: no merge across their border comes before both are whole."""
        key = a << 32 | b
        known = self._ok.get(key)
        if known is None:
            ra, lb, i, j, known = self.right[a], self.left[b], 0, 0, True
            rank = self.pair_rank
            while True:
                (x, x_end), (y, y_end) = ra[i], lb[j]
                r = rank.get((x, y))
                if r is not None and r < x_end and r <= y_end:
                    known = False
                    break
                if x_end == _LAST and y_end == _LAST:
                    break
                if x_end <= y_end:
                    i += 1
                else:
                    j += 1
            if len(self._ok) > 1_000_000:
                self._ok.clear()
            self._ok[key] = known
        return known

    def counts_of(self, data: bytes) -> list[int]:
        """Token count of data[:1], data[:2], ... as one slice each."""
        get, ok, longest, known = self.ids.get, self.may_follow, self.longest, self._ok
        last, counts = [-1], [0]
        for i in range(1, len(data) + 1):
            for j in range(max(0, i - longest), i):
                t = get(data[j:i])
                if t is not None and (j == 0 or (known.get(last[j] << 32 | t) or ok(last[j], t))):
                    last.append(t)
                    counts.append(counts[j] + 1)
                    break
            else:
                raise ValueError("a byte is missing from the vocabulary")
        return counts[1:]

    def totals(self, texts: list[str]) -> np.ndarray:
        """Token count of every text; special strings count one each."""
        def lengths(plain):
            slices, first = split(plain)
            rows = self.table.row_numbers(slices)
            t = self.table
            n = t.flat[t.starts[rows] + t.counts[rows] - 1] if len(rows) else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
            return ends[first]
        if self.special and any(s in t for t in texts for s in self.special):
            def as_ids(plain):  # one zero per token, so that parts concatenate
                offs = lengths(plain)
                return np.zeros(int(offs[-1]), np.uint32), offs
            return np.diff(with_special(texts, self.special, as_ids)[1])
        return np.diff(lengths(texts))

    def prefix_counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ends, counts): the byte offset after every whole character, and the token count of
        the text cut there, with each slice's own prefix table on top of the slices before it.

        A cut inside a run of white space or a contraction changes how the cut text is sliced;
        those few characters are sliced again, from the last border that the cut leaves alone.
        """
        if any(s in text for s in self.special):
            raise ValueError("cut the text at its special strings first")
        slices, _ = split([text])
        ends, counts, before, at = [], [], [0], 0  # before[k]: tokens before slice k
        for k, s in enumerate(slices):
            table = self.counts_of(s.encode())
            resliced = s.isspace() or s[0] == "'"
            pos = 0
            for n, ch in enumerate(s, 1):
                pos += len(ch.encode())
                ends.append(at + pos)
                if resliced:
                    back = max(0, k - 1)
                    cut = "".join(slices[back:k]) + s[:n]
                    counts.append(before[back] + int(self.totals([cut])[0]))
                else:
                    counts.append(before[k] + table[pos - 1])
            before.append(before[k] + table[-1])
            at += pos
        return np.array(ends, np.int64), np.array(counts, np.int64)

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix of whole characters with at most `budget` tokens."""
        ends, counts = self.prefix_counts(text)
        fits = np.flatnonzero(counts <= budget)
        return text.encode()[:ends[fits[-1]]].decode() if len(fits) else ""


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_documents(df: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every text, in one pass without a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for keys, texts in chunks(batches):
            n = c.totals(texts)
            size = pc.cast(pc.binary_length(pa.array(texts, pa.string())), pa.int64())
            yield pa.RecordBatch.from_arrays([keys, size, pa.array(n, pa.int64()), pa.array(n > limit)],
                                             names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
    return texts_of(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
