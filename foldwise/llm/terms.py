"""Words of texts as byte strings, and their occurrences among a given vocabulary."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts_of

#: What separates words: all of ASCII but digits and letters. A-Z become a-z; bytes of other characters stay.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """The maximal runs of ASCII digits, letters (lower-cased) and other characters of a UTF-8 text."""
    return text.translate(_TABLE).split()


def list_array(lists: list, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    flat = np.concatenate(lists) if lists else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def matched(df: DataFrame, count: Callable[[list[bytes]], Counter], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs) of every row: its number of words, and the term ids that `count`
    gives for its words (the key None is left out) with their occurrences, by ascending id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, terms, tfs = [], [], []
            for text in batch.column(1):
                ws = words(text.as_py())
                c = count(ws)
                c.pop(None, None)
                ids = sorted(c)
                n.append(len(ws))
                terms.append(ids)
                tfs.append([c[i] for i in ids])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), list_array(terms, pa.int32()), list_array(tfs, pa.int64())],
                                             names=["doc_id", "n", "terms", "tfs"])
    texts = texts_of(df, id_col, text_col)
    return texts.select("doc_id", texts["text"].cast("binary")).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def document_frequencies(found: DataFrame, size: int) -> np.ndarray:
    """How many rows of :func:`matched` hold each of `size` terms: a task sends its sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at])], names=["t", "n"])
    out = np.zeros(size, np.int64)
    for r in found.select("terms").mapInArrow(run, "t int, n long").groupBy("t").sum("n").collect():
        out[r["t"]] = r["sum(n)"]
    return out
