"""Byte-level BPE encoding and decoding (operator 5).

Text is cut by :mod:`pretok` (class arrays and a scan of transition functions, no regex); each
distinct slice is merged once per worker and looked up afterwards. The byte offset of every
id is kept, so any id range maps back to its bytes.

Defined results: a null or empty text has no ids and decodes to no bytes; other columns of
the input are not read; a null doc_id stays null; repeated rows and rows that share a doc_id give a
result each; an empty table an empty result.
Texts of any length are encoded whole (a slice of n bytes costs n log n).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, texts_of
from .pretok import SliceTable, one_by_one


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_slice(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the lowest-ranked neighbouring pair is merged until none is left."""
    whole = ranks.get(data)
    if whole is not None:
        return [whole]
    if len(data) > 48:
        return _merge_long(data, ranks)
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(data)
    end = list(range(1, n + 1))  # end[i]: end of the part that begins at i; 0: merged away
    prev = list(range(-1, n - 1))
    heap = []

    def offer(i):
        j = end[i]
        if j < n:
            r = ranks.get(data[i:end[j]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue  # one of the two parts has changed since
        end[i], end[j] = stop, 0
        if stop < n:
            prev[stop] = i
        offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[data[i:end[i]]])
        i = end[i]
    return out


class BytePairCoder:
    """Encode texts to ids with byte offsets, and ids back to bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.table = SliceTable(one_by_one(lambda s: merge_slice(s.encode(), ranks)))
        size = max(ranks.values()) + 1
        pieces = [b""] * size
        for piece, i in ranks.items():
            pieces[i] = piece
        self.piece_len = np.fromiter(map(len, pieces), np.int64, size)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.table.encode(texts)

    def byte_offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each id begins in the decoded bytes (and, last, their number)."""
        return np.concatenate([[0], np.cumsum(self.piece_len[ids])])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decoded bytes and the byte offset of every id."""
        offs = self.byte_offsets(ids)
        at = np.repeat(self.piece_at[ids] - offs[:-1], self.piece_len[ids]) + np.arange(offs[-1])
        return self.piece_bytes[at], offs


@lru_cache(maxsize=2)
def coder(path: str) -> BytePairCoder:
    return BytePairCoder(load_ranks(path))


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, offsets array<int>): ids of every text and the byte offset of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for keys, texts in chunks(batches, 1 << 20):
            ids, offs = c.encode(texts)
            at = [c.byte_offsets(ids[a:b])[:-1] for a, b in zip(offs[:-1], offs[1:])]
            rows = pa.array(offs, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [keys, pa.ListArray.from_arrays(rows, pa.array(ids.astype(np.int32))),
                 pa.ListArray.from_arrays(rows, pa.array(np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int32)))],
                names=["doc_id", "ids", "offsets"])
    return texts_of(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, offsets array<int>")


def decode_documents(df: DataFrame, path: str) -> DataFrame:
    """(doc_id, data binary) of a table with doc_id and ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            data = [c.decode(np.asarray(x or [], np.int64))[0].tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])
    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
               with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked, ids array<int>): encode,
    decode the ids, digest both, in one pass over the texts."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        decimal = [b"%d" % i for i in range(len(c.piece_len))]
        for keys, texts in chunks(batches):
            ids, offs = c.encode(texts)
            data, at = c.decode(ids)
            spelled = [decimal[i] for i in ids.tolist()]
            rows = [(hashlib.sha256(b",".join(spelled[a:b])).hexdigest(), hashlib.sha256(data[at[a]:at[b]]).hexdigest())
                    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            cols = [keys, pa.array(np.diff(offs)), pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.string())]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return texts_of(df, id_col, text_col).mapInArrow(run, schema)
