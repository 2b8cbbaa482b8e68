"""Ranked lexical search by presence-mask grouping (operator 11).

For every item the documents are grouped by mask: which of the item's terms they hold. All
documents of a mask have the same highest possible score, so masks are taken by descending
highest score, and a search ends when no mask left can reach the results it already has.

One pass over the texts gives each document its number of words and its occurrences of the
items' terms (a written table). A task then takes its documents in blocks: a bitmap per term, and
for each item a best-first search that splits sets of documents by one term's bitmap at a time,
so masks appear in descending order of their highest score and most are never formed. The documents
of a mask that may matter are scored exactly in 64-bit integers. The best of the earlier blocks
serve as threshold in the next; a task gives its `k` best per item, and a ranking per item, of k
rows from each task, finishes.

The items are the stated query set: they are taken in rounds of at most ROUND_BYTES of text, so
neither the driver nor a broadcast holds more of them, whatever their number.

Defined results: a null or empty text has no terms (as item: no rows); repeated documents are
ranked each; equal scores go by ascending doc_id, a null doc_id last; items that share an
item_id are ranked separately, equal (item_id, text) rows once; an empty table on either side gives
no rows; other columns are not read; texts count whole.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .terms import matched, words

#: Bytes of item text of a round.
ROUND_BYTES = 8 << 20
#: What a score is made of: occurrences are scaled, and long documents damped.
SCALE, TF, DAMP, SHARE = 1_000_000_000, 1000, 12, 25


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class Block:
    """Documents of a task: who holds a term (a bitmap and postings), and what it adds to a score
    before its weight."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray,
                 n_docs: int, total: int):
        self.ids, self.null, self.size = ids, null, len(ids)
        m = 100 - SHARE + (SHARE * n * n_docs) // max(total, 1)
        part = (SCALE * tf) // (TF * tf + DAMP * m[doc])
        order = np.argsort(term, kind="stable")
        self.doc, self.part = doc[order], part[order]
        self.terms, start = np.unique(term[order], return_index=True)
        self.span = dict(zip(self.terms.tolist(), zip(start.tolist(), [*start[1:].tolist(), len(order)])))
        self.most = dict(zip(self.terms.tolist(), np.maximum.reduceat(self.part, start).tolist() if len(start) else []))
        self._bits: dict[int, int] = {}

    def bits(self, t: int) -> int:
        if t not in self._bits:
            has = np.zeros(self.size, bool)
            a, b = self.span[t]
            has[self.doc[a:b]] = True
            self._bits[t] = int.from_bytes(np.packbits(has, bitorder="little").tobytes(), "little")
        return self._bits[t]

    def members(self, bits: int) -> np.ndarray:
        raw = np.frombuffer(bits.to_bytes((self.size + 7) // 8, "little"), np.uint8)
        return np.flatnonzero(np.unpackbits(raw, bitorder="little"))

    def score(self, at: np.ndarray, query: list[tuple[int, int]]) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for t, w in query:
            a, b = self.span[t]
            docs = self.doc[a:b]
            i = np.minimum(np.searchsorted(docs, at), len(docs) - 1)
            out += np.where(docs[i] == at, w * self.part[a:b][i], 0)
        return out


class Best:
    """The k best (score, id) of an item so far."""

    def __init__(self, k: int):
        self.k, self.score = k, np.empty(0, np.int64)
        self.id, self.null = np.empty(0, np.int64), np.empty(0, bool)

    def least(self) -> int:
        """A document must reach this score to matter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        keep = score >= self.least()
        if keep.any():
            s, i, n = (np.concatenate([a, b[keep]]) for a, b in ((self.score, score), (self.id, ids), (self.null, null)))
            top = np.lexsort((i, n, -s))[:self.k]
            self.score, self.id, self.null = s[top], i[top], n[top]


def search_block(block: Block, query: list[tuple[int, int]], best: Best) -> int:
    """Add what a block has for an item (term, weight times its repeats); returns how many masks were formed."""
    query = sorted(((t, w) for t, w in query if t in block.span and w > 0), key=lambda x: -x[1] * block.most[x[0]])
    if not query:
        return 0
    top = [w * block.most[t] for t, w in query]
    held = [block.bits(t) for t, _ in query]
    # (minus the highest score of the set, order of entry, terms decided so far, documents)
    sets = [(-sum(top), 0, 0, reduce(int.__or__, held))]
    formed, entered, ready, waiting, room = 0, 0, 0, 0, 1
    while sets:
        most, _, depth, docs = heapq.heappop(sets)
        if -most < best.least():
            break
        if depth < len(query):
            yes = docs & held[depth]
            for part, bound in ((yes, most), (docs ^ yes, most + top[depth])):
                if part and -bound >= best.least():
                    entered += 1
                    heapq.heappush(sets, (bound, entered, depth + 1, part))
            continue
        formed += 1  # a whole mask: no other document of any mask left can score more than -most
        ready, waiting = ready | docs, waiting + 1
        if waiting == room:
            at = block.members(ready)
            best.add(block.score(at, query), block.ids[at], block.null[at])
            ready, waiting, room = 0, 0, min(2 * room, 64)
    if ready:
        at = block.members(ready)
        best.add(block.score(at, query), block.ids[at], block.null[at])
    return formed


def _rank(found: DataFrame, queries: list[list[tuple[int, int]]], n_docs: int, total: int, k: int) -> DataFrame:
    """(nth, doc_id, score): the k best of each task for each item, by its place in `queries`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries]
        for batch in batches:
            ids, terms = batch.column(0), batch.column(2)
            null = np.asarray(ids.is_null())
            sizes = np.diff(terms.offsets.to_numpy())
            block = Block(ids.fill_null(0).to_numpy(), null, batch.column(1).to_numpy(), np.repeat(np.arange(len(ids)), sizes),
                          terms.flatten().to_numpy(), batch.column(3).flatten().to_numpy(), n_docs, total)
            for query, b in zip(queries, best):
                search_block(block, query, b)
        nth = np.repeat(np.arange(len(best)), [len(b.id) for b in best])
        if len(nth):
            ids = pa.array(np.concatenate([b.id for b in best]), mask=np.concatenate([b.null for b in best]))
            yield pa.RecordBatch.from_arrays([pa.array(nth, pa.int32()), ids, pa.array(np.concatenate([b.score for b in best]))],
                                             names=["nth", "doc_id", "score"])
    return found.mapInArrow(run, "nth int, doc_id long, score long")


def _round(docs: DataFrame, items: list, k: int) -> DataFrame | None:
    """(item_id, rank, doc_id, score) of some items: collected rows (item_id, text)."""
    wanted = [Counter(words(r["text"].encode())) for r in items]
    code = {w: i for i, w in enumerate(sorted(set().union(*wanted)))}
    if not code:
        return None
    get = code.get
    found = written(matched(docs, lambda ws: Counter(map(get, ws))), "lexical-terms")
    size = found.agg(F.count_if(F.col("n") > 0).alias("n"), F.sum("n").alias("total")).first()
    df = np.zeros(len(code), np.int64)
    for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the round
        df[r["t"]] = r["count"]
    w = weights(df, size["n"])
    queries = [[(code[t], q * int(w[code[t]])) for t, q in sorted(c.items())] for c in wanted]
    each = _rank(found.where(F.size("terms") > 0), queries, size["n"], size["total"] or 0, k)
    order = Window.partitionBy("nth").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    top = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = docs.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(items)], "nth int, item_id long")
    return top.join(F.broadcast(names), "nth").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest scores above 0 for every item."""
    asked = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].cast("string").alias("text")).where("text is not null").distinct()
    size = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    rounds = max(1, math.ceil(size / round_bytes))
    if rounds > 1:
        asked = written(asked, "lexical-items")
    parts = []
    for i in range(rounds):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == i).collect()  # about round_bytes
        part = _round(docs, sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"])), k) if rows else None
        parts += [part] if part is not None else []
    none = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, parts) if parts else none
