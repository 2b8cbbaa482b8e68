"""Toxicity by the nearest labelled examples (operator 13).

Texts are TF-IDF vectors, and a text's nearest labelled examples by exact cosine vote, each weighted by its
distance. Votes are calibrated on the examples themselves, each judged by the others, and the nearest examples come
along as evidence.

The vector space: words and prefixes of words (PREFIXES bytes) whose log-likelihood ratio with the label is
higher than chance would give any of the candidates, and whose odds differ LIFT-fold, the MAX_TERMS highest; a text without any of them has no
neighbours and takes the share of toxic examples among those without any. Weights are (1 + ln tf) * idf with document
frequencies counted over all documents.

The index is inverted and cut into blocks of BLOCK examples: for every term the highest weight in each
block where it occurs. A search adds up these maxima for the terms of a text, takes the blocks by
descending sum, scores their examples exactly, and ends when no sum left reaches the k-th cosine.

At most `max_examples` labels (smallest hash of doc_id, the same at any size), and as many distinct rows (doc_id, text,
label), are examples; so index and evidence are bounded. All documents are counted and scored: one pass over the
texts writes the few terms of each, and scoring reads these.

Defined results: a null or empty text has no terms; a null doc_id is scored and never learned from; labels other than 0
and 1 are ignored; repeated rows give repeated results and are one example; without examples every score is 0.5, and with
examples of one kind the same for all; other columns are not read; an empty table gives an empty result; texts count whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, texts_of, written
from .terms import document_frequencies, matched, words

#: Labelled rows that serve as examples, terms of the space, bytes of prefixes, examples of a block, neighbours that vote.
MAX_EXAMPLES, MAX_TERMS, PREFIXES, BLOCK, NEIGHBOURS = 20_000, 1_024, (4, 5, 6), 64, 15
#: A term's odds of the label must differ by this factor between the examples with and without it.
LIFT = 4.0
#: Added to a distance, and the weight of the prior among the votes.
NEAR, PRIOR = 0.1, 0.5
#: Distinct words that a task remembers the terms of.
MEMO = 400_000


def candidates(word: bytes) -> list[bytes]:
    """The terms that a word counts for: itself and its longer prefixes, marked."""
    return [word, *(word[:k] + b"*" for k in PREFIXES if len(word) > k)]


def counter(vocabulary: dict[bytes, int]) -> Callable[[list[bytes]], Counter]:
    memo: dict[bytes, list[int]] = {}

    def count(ws: list[bytes]) -> Counter:
        out: Counter = Counter()
        for w, n in Counter(ws).items():
            ids = memo.get(w)
            if ids is None:
                if len(memo) >= MEMO:
                    memo.clear()
                ids = memo[w] = [vocabulary[t] for t in candidates(w) if t in vocabulary]
            for i in ids:
                out[i] += n
        return out
    return count


# -- examples and terms -----------------------------------------------------------------------
def examples(docs: DataFrame, labels: DataFrame, usable: Column, max_examples: int) -> DataFrame:
    """(doc_id, text, toxic) of the labelled documents that may be learned from, each distinct row once. `usable`: a
    condition on doc_id."""
    picked = (labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
              .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).where(usable).distinct()
              .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_examples))
    rows = texts_of(docs).join(F.broadcast(picked), "doc_id").withColumn("tag", F.xxhash64("text"))
    return written(rows.dropDuplicates(["doc_id", "toxic", "tag"]), "toxic-examples")


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(0.0)


def choose_terms(found: DataFrame, max_terms: int = MAX_TERMS) -> list[bytes]:
    """The terms most tied to the label, by log-likelihood ratio over the examples that hold them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: tuple[Counter, Counter] = Counter(), Counter()
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                held[y].update({t for w in set(words(text.as_py())) for t in candidates(w)})
            terms = list(held[0].keys() | held[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), *(pa.array([held[y][t] for t in terms], pa.int64()) for y in (1, 0))],
                                             names=["term", "a", "b"])
    n = {r["toxic"]: r["count"] for r in found.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return []
    each = found.select(F.col("text").cast("binary").alias("text"), "toxic").mapInArrow(run, "term binary, a long, b long")
    counts = written(each.groupBy("term").agg(F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b")), "toxic-terms")
    n1, n0 = F.lit(float(n[1])), F.lit(float(n[0]))
    a, b, both, whole = F.col("a"), F.col("b"), F.col("a") + F.col("b"), F.lit(float(n[1] + n[0]))
    ratio = 2 * (_xlogx(a) + _xlogx(b) + _xlogx(n1 - a) + _xlogx(n0 - b) + _xlogx(whole)
                 - _xlogx(both) - _xlogx(whole - both) - _xlogx(n1) - _xlogx(n0))
    chance = 2 * math.log(max(2, counts.count()))  # less than one of the candidates is expected beyond it
    half = F.lit(0.5)
    odds = F.abs(F.log((a + half) * (n0 - b + half) / ((b + half) * (n1 - a + half))))
    best = counts.where(odds >= math.log(LIFT)).select("term", F.round(ratio, 6).alias("ratio")).where(F.col("ratio") >= chance).orderBy(F.desc("ratio"), "term").limit(max_terms)
    return [bytes(r["term"]) for r in best.collect()]


# -- the index --------------------------------------------------------------------------------
class Index:
    """Unit TF-IDF vectors of the examples, block by block, with the block maxima of every term."""

    def __init__(self, ids: np.ndarray, toxic: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, block: int = BLOCK):
        self.idf, self.block = idf, block
        unit = [self.unit(t, c) for t, c in vectors]
        # examples with one heaviest term lie together, so that maxima tell blocks apart
        heavy = np.array([t[np.argmax(w)] if len(t) else -1 for t, w in unit], np.int64)
        order = np.lexsort((ids, toxic, heavy)) if len(ids) else np.empty(0, np.int64)
        self.empty = toxic[heavy < 0]
        order = order[heavy[order] >= 0]
        self.ids, self.toxic = ids[order], toxic[order]
        unit = [unit[i] for i in order]
        sizes = [len(t) for t, _ in unit]
        self.row = np.repeat(np.arange(len(unit)), sizes)
        self.term = np.concatenate([t for t, _ in unit]) if unit else np.empty(0, np.int64)
        self.weight = np.concatenate([w for _, w in unit]) if unit else np.empty(0)
        self.blocks = -(-len(unit) // block)
        self.start = np.searchsorted(self.row, np.arange(self.blocks + 1) * block)
        key = self.term * max(1, self.blocks) + self.row // block
        by = np.argsort(key, kind="stable")
        cells, first = np.unique(key[by], return_index=True)
        most = np.maximum.reduceat(self.weight[by], first) if len(cells) else np.empty(0)
        term, at = cells // max(1, self.blocks), cells % max(1, self.blocks)
        ends = np.searchsorted(term, np.arange(len(idf) + 1))
        self.postings = [(at[a:b], most[a:b]) for a, b in zip(ends, ends[1:])]

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.idf[terms]
        return terms, w / np.sqrt(w @ w) if len(w) else w

    def nearest(self, terms: np.ndarray, counts: np.ndarray, k: int, skip: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(examples, cosines, blocks scored) of the k examples with the highest cosine above 0, by descending cosine, then by place.
        `skip`: (doc_id, label) of examples that are left out."""
        best, cos, scored = np.empty(0, np.int64), np.empty(0), 0
        if not len(terms) or not self.blocks:
            return best, cos, scored
        terms, q = self.unit(terms, counts)
        held = [self.postings[t] for t in terms]
        bound = np.bincount(np.concatenate([b for b, _ in held]), np.concatenate([m * x for (_, m), x in zip(held, q)]), self.blocks)
        dense = np.zeros(len(self.idf))
        dense[terms] = q
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(cos) == k and bound[b] < cos[-1] - 1e-9:  # sums differ in their last bits
                break
            scored += 1
            at = slice(self.start[b], self.start[b + 1])
            first = b * self.block
            s = np.bincount(self.row[at] - first, self.weight[at] * dense[self.term[at]], min(self.block, len(self.ids) - first))
            ok = s > 0
            if skip is not None:
                here = slice(first, first + len(s))
                ok &= (self.ids[here] != skip[0]) | (self.toxic[here] != skip[1])
            if len(cos) == k:
                ok &= s >= cos[-1]
            new = np.flatnonzero(ok)
            best, cos = np.concatenate([best, first + new]), np.concatenate([cos, s[new]])
            top = np.lexsort((best, -np.round(cos, 12)))[:k]
            best, cos = best[top], cos[top]
        return best, cos, scored

    def prior(self) -> float:
        """The smoothed share of toxic examples among those without a term (or among all, if all have one)."""
        y = self.empty if len(self.empty) else self.toxic
        return (y.sum() + 0.5) / (len(y) + 1)

    def vote(self, best: np.ndarray, cos: np.ndarray) -> float:
        w = 1 / (NEAR + np.maximum(0, 1 - cos))
        return float((w @ self.toxic[best] + PRIOR * self.prior()) / (w.sum() + PRIOR))


def calibrate(votes: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the logistic of a vote's logit, by Newton steps on smoothed labels (Platt); a slope below 0 becomes none."""
    if len(toxic) == 0 or toxic.min() == toxic.max():
        return 1.0, 0.0
    z = logit(votes)
    n1 = toxic.sum()
    n0 = len(toxic) - n1
    y = np.where(toxic == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([z, np.ones(len(z))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (y - p) - 1e-3 * (w - [1.0, 0.0]))
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def logit(p):
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def _vectors(batch: pa.RecordBatch, terms: int, counts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ends = batch.column(terms).offsets.to_numpy()
    t, c = (batch.column(i).flatten().to_numpy() for i in (terms, counts))
    ends = ends - ends[0]
    for a, b in zip(ends, ends[1:]):
        yield t[a:b], c[a:b]


class Model:
    """An index with its calibration; `score` gives (score, nearest examples, their cosines)."""

    def __init__(self, index: Index, slope: float = 1.0, offset: float = 0.0, k: int = NEIGHBOURS):
        self.index, self.slope, self.offset, self.k = index, slope, offset, k

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        best, cos, _ = self.index.nearest(terms, counts, self.k)
        z = self.slope * logit(self.index.vote(best, cos)) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35)))), best, cos


def learn(docs: DataFrame, labels: DataFrame, usable: Column, max_examples: int = MAX_EXAMPLES, max_terms: int = MAX_TERMS,
          k: int = NEIGHBOURS) -> tuple[Model, DataFrame]:
    """(model, the terms of every document)."""
    some = examples(docs, labels, usable, max_examples)
    vocabulary = {t: i for i, t in enumerate(sorted(choose_terms(some, max_terms)))}
    found = written(matched(docs, counter(vocabulary)), "toxic-documents")
    idf = np.log((1 + found.count()) / (1 + document_frequencies(found, len(vocabulary)))) + 1
    keyed = some.select(F.col("doc_id"), "toxic", "tag", "text")
    count = counter(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [sorted(count(words(t.as_py())).items()) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([[i for i, _ in h] for h in held], pa.list_(pa.int64())),
                                              pa.array([[n for _, n in h] for h in held], pa.list_(pa.int64()))],
                                             names=["doc_id", "toxic", "tag", "terms", "counts"])
    vectors = written(keyed.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, "doc_id long, toxic int, tag long, terms array<long>, counts array<long>")
                      .orderBy(F.xxhash64("doc_id", "tag"), "doc_id", "tag", "toxic").limit(max_examples), "toxic-vectors")
    held = vectors.orderBy("doc_id", "tag", "toxic").toArrow().combine_chunks()  # at most max_examples short vectors
    batch = held.to_batches()[0] if len(held) else None
    index = Index(held["doc_id"].to_numpy(), held["toxic"].to_numpy().astype(np.int64), list(_vectors(batch, 3, 4)) if batch else [], idf)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, toxic = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            votes = [index.vote(*index.nearest(t, c, k, (i, y))[:2]) for (t, c), i, y in zip(_vectors(batch, 3, 4), ids, toxic)]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), batch.column(1)], names=["vote", "toxic"])
    spread = docs.sparkSession.sparkContext.defaultParallelism
    judged = vectors.repartition(spread, F.xxhash64("doc_id", "tag")).mapInArrow(judge, "vote double, toxic int").toArrow()
    order = np.lexsort((judged["toxic"].to_numpy(), judged["vote"].to_numpy()))
    return Model(index, *calibrate(judged["vote"].to_numpy()[order], judged["toxic"].to_numpy()[order]), k), found


def score_documents(docs: DataFrame, labels: DataFrame, fold: int = 4, held_out: int = 2, accept: float = 0.3, evidence: int = 3,
                    max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every row; evidence: the nearest examples with their labels and cosines."""
    model, found = learn(docs, labels, ~is_held_out(F.col("doc_id"), fold, held_out), max_examples)
    shape = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, shown = [], []
            for terms, counts in _vectors(batch, 2, 3):
                s, best, cos = model.score(terms, counts)
                scores.append(s)
                shown.append([{"doc_id": int(model.index.ids[i]), "toxic": int(model.index.toxic[i]), "cosine": float(c)}
                              for i, c in zip(best[:evidence], cos[:evidence])])
            s = np.array(scores)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= accept).astype(np.int32)), pa.array(shown, shape)],
                                             names=["doc_id", "score", "predicted", "evidence"])
    scored = found.mapInArrow(run, "doc_id long, score double, predicted int, evidence array<struct<doc_id: long, toxic: int, cosine: double>>")
    return scored.select("doc_id", is_held_out(F.col("doc_id"), fold, held_out).alias("held_out"), "score", "predicted", "evidence")
