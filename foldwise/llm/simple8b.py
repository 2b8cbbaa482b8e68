"""Token ids in a word-aligned binary format (operator 1): Simple-8b.

A 64-bit word holds a 4-bit selector and, by selector, a varying number of ids of one width.
A word with the escape selector holds one id of up to 60 bits. Each writer task makes one run
of files; a file is a sequence of block records, each followed by one line feed (the separator
of Spark's text writer, which commits whole files atomically on any Hadoop store). Integers
are little-endian:

    magic "S8B1" | record bytes u32 | n_docs u32 | n_ids u32 | n_words u32 | n_marks u32
    doc ids i64[n_docs] | first id of each document u32[n_docs + 1]
    marks u32[n_marks]: index of the first id in words 0, 128, 256, ...
    words u64[n_words]

The marks let a reader start inside a block and decode 128 words at a time; all words of one
selector are unpacked in one array operation.

Files are in ascending order of document (range partitioning, so part numbers follow doc_id).
Defined results: a null or empty text has only the end id; a null doc_id sorts first and is
written as the smallest long; repeated rows are all written, in order of text; other columns
are not read; an empty table writes no block and reads back as no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, texts_of, written
from .pretok import SliceTable, byte_of_char, with_special

MAGIC = b"S8B1"
HEAD = struct.Struct("<4s5I")
MARK_EVERY = 128
#: Ids of a block before it is closed, and blocks of a file.
BLOCK_IDS, FILE_BLOCKS = 1 << 17, 256
# Fixed values: (ids per word, bits per id) of selectors 0..13; 15 escapes one wide id.
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20),
             (2, 30), (1, 60)]
ESCAPE = 15
BIT_LENGTH = np.frexp(np.arange(1 << 16))[1].astype(np.uint8)
NO_ID = -(1 << 63)


def _widest(most: np.ndarray, shift: int, n: int) -> np.ndarray:
    """The larger of each entry and the one `shift` further on."""
    out = most.copy()
    if shift < n:
        np.maximum(most[:-shift], most[shift:], out=out[:-shift])
    return out


def pack(ids: np.ndarray) -> np.ndarray:
    """Words of an id sequence: from each position the selector that takes most ids."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.uint64)
    if int(ids.max()) >> 60:
        raise ValueError("an id has more than 60 bits")
    bits = BIT_LENGTH[ids & np.uint64(0xFFFF)]
    for shift in (16, 32, 48):
        high = ids >> np.uint64(shift)
        if not high.any():
            break
        bits = np.where(high > 0, shift + BIT_LENGTH[high & np.uint64(0xFFFF)], bits).astype(np.uint8)
    most, span = bits, 1  # most[i]: widest of ids i .. i + span - 1; past the end lie zeros
    fitting = np.zeros(n, np.uint8)  # selectors that hold the ids from i on: if one does, all before it do
    for count, width in SELECTORS[-2::-1]:
        while 2 * span <= count:
            most, span = _widest(most, span, n), 2 * span
        ok = (_widest(most, count - span, n) if count > span else most) <= width
        if not ok.any():
            break
        fitting += ok
    choice = np.where(fitting > 0, len(SELECTORS) - 1 - fitting, ESCAPE).astype(np.uint8)
    jump, begins, i = np.array([c for c, _ in SELECTORS] + [1, 1], np.uint8)[choice].tobytes(), bytearray(n), 0
    while i < n:
        begins[i] = 1
        i += jump[i]
    at = np.flatnonzero(np.frombuffer(begins, np.uint8))
    chosen = choice[at]
    words = np.zeros(len(at), np.uint64)
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    for k in np.unique(chosen).tolist():
        here = np.flatnonzero(chosen == k)
        count, width = SELECTORS[k] if k != ESCAPE else (1, 60)
        first, held = at[here], np.full(len(here), k << 60, np.uint64)
        for j in range(count):
            held |= padded[first + j] << np.uint64(j * width)
        words[here] = held
    return words


def counts_of(words: np.ndarray) -> np.ndarray:
    """Ids in each word (the last word of a block may hold fewer)."""
    return np.array([c for c, _ in SELECTORS] + [1, 1])[(words >> np.uint64(60)).astype(np.int64)]


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = counts_of(words)
    at = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for k in np.unique(sel).tolist():
        here = np.flatnonzero(sel == k)
        count, width = SELECTORS[k] if k != ESCAPE else (1, 60)
        first, held = at[here], words[here]
        for j in range(count):
            out[first + j] = held >> np.uint64(j * width) & np.uint64((1 << width) - 1)
    return out[:n]


def block(doc_ids: np.ndarray, ids: np.ndarray, firsts: np.ndarray) -> bytes:
    words = pack(ids)
    marks = (np.cumsum(counts_of(words)) - counts_of(words))[::MARK_EVERY]
    parts = [np.asarray(doc_ids, "<i8").tobytes(), np.asarray(firsts, "<u4").tobytes(),
             np.asarray(marks, "<u4").tobytes(), words.astype("<u8").tobytes()]
    size = HEAD.size + sum(map(len, parts))
    return HEAD.pack(MAGIC, size, len(doc_ids), len(ids), len(words), len(marks)) + b"".join(parts)


def read_blocks(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, ids, first id of each document) of every block of a file."""
    pos = 0
    while pos < len(data):
        magic, size, docs, n, words, marks = HEAD.unpack_from(data, pos)
        if magic != MAGIC:
            raise ValueError("not a block of this format")
        at = pos + HEAD.size
        doc_ids = np.frombuffer(data, "<i8", docs, at)
        firsts = np.frombuffer(data, "<u4", docs + 1, at + 8 * docs)
        packed = np.frombuffer(data, "<u8", words, at + 8 * docs + 4 * (docs + 1) + 4 * marks)
        yield doc_ids, unpack(packed, n), firsts
        pos += size + 1


def unpack_from_mark(data: bytes, pos: int, mark: int) -> tuple[int, np.ndarray]:
    """(index of the first id, ids) of the run of words after one mark of the block at `pos`."""
    _, _, docs, n, words, marks = HEAD.unpack_from(data, pos)
    at = pos + HEAD.size + 8 * docs + 4 * (docs + 1)
    first = int(np.frombuffer(data, "<u4", marks, at)[mark])
    lo, hi = mark * MARK_EVERY, min(words, (mark + 1) * MARK_EVERY)
    packed = np.frombuffer(data, "<u8", hi - lo, at + 4 * marks + 8 * lo)
    return first, unpack(packed, n - first)


class LibraryEncoder:
    """Texts to ids with the tokenizers library; each distinct slice goes through it once."""

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        if self.tok.normalizer is not None or type(self.tok.pre_tokenizer).__name__ != "ByteLevel":
            raise ValueError("slices need a byte-level tokenizer without a normalizer")
        self.model, self.spelling = self.tok.model, {b: c for c, b in byte_of_char().items()}
        self.space = self.spelling[0x20]  # of printable ASCII, only the space is spelled otherwise
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.table = SliceTable(self._encode)

    def _encode(self, slices: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's model on each slice, spelled in its byte-level alphabet."""
        spelled = [s.replace(" ", self.space) if s.isascii() and s.isprintable()
                   else s.encode().decode("latin-1").translate(self.spelling) for s in slices]
        found = [[t.id for t in self.model.tokenize(s)] for s in spelled]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return with_special(texts, self.special, self.table.encode)


@lru_cache(maxsize=2)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write_ids(df: DataFrame, path: str, out: str, end_id: int | None = 2, id_col: str = "doc_id",
              text_col: str = "text") -> None:
    """Encode every text and write its ids (and `end_id`) under `out`, ascending by document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush():
            sizes = np.concatenate([h[2] for h in held])
            data = block(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]),
                         np.concatenate([[0], np.cumsum(sizes)]))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["block"])
        for keys, texts in chunks(batches, 1 << 20):
            ids, offs = enc(texts)
            sizes = np.diff(offs)
            if end_id is not None:
                ids = np.insert(ids, offs[1:], end_id)
                sizes = sizes + 1
            held.append((keys.fill_null(NO_ID).to_numpy(zero_copy_only=False), ids, sizes))
            if sum(len(h[1]) for h in held) >= BLOCK_IDS:
                yield flush()
        if held:
            yield flush()
    docs = texts_of(df, id_col, text_col)
    docs = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    blocks = docs.mapInArrow(run, "block binary").select(F.col("block").cast("string"))
    blocks.write.option("maxRecordsPerFile", FILE_BLOCKS).text(out)


def read_ids(spark: SparkSession, out: str, with_ids: bool = True) -> DataFrame:
    """(file, pos, doc_id, file_start, n_tokens, ids_crc32, ids): the documents of the files under `out`.

    `file_start` counts the ids before the document in its file, `pos` the documents.
    """
    schema = "file string, pos long, doc_id long, file_start long, n_tokens long, ids_crc32 long"
    schema += ", ids array<long>" if with_ids else ""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                pos, start = 0, 0
                for doc_ids, ids, firsts in read_blocks(data.as_py()):
                    firsts = firsts.astype(np.int64)
                    ids = ids.astype("<u4")
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist())]
                    keys = pa.array(doc_ids, mask=doc_ids == NO_ID)
                    cols = [pa.array([name] * len(doc_ids)), pa.array(np.arange(pos, pos + len(doc_ids))), keys,
                            pa.array(start + firsts[:-1]), pa.array(np.diff(firsts)), pa.array(crc, pa.int64())]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), pa.array(ids.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(cols, names=names)
                    pos, start = pos + len(doc_ids), start + len(ids)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content").mapInArrow(run, schema)


def document_index(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read back from the files: where each document lies
    in the whole sequence of ids. Part numbers rise with doc_id, so file names give the order;
    only one total per file (about 70 MB of ids) meets in one place."""
    docs = written(read_ids(spark, out, with_ids=False), "id-index")
    files = docs.groupBy("file").agg(F.sum("n_tokens").alias("file_ids"))
    part, piece = (F.regexp_extract("file", p, 1).cast("long") for p in (r"^part-(\d+)", r"-c(\d+)\."))
    before = Window.orderBy(part, piece).rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("file_first", F.coalesce(F.sum("file_ids").over(before), F.lit(0)))
    return docs.join(files, "file").select("doc_id", (F.col("file_first") + F.col("file_start")).alias("start"),
                                           "n_tokens", "ids_crc32")
