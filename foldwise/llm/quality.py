"""Quality scores by Bradley-Terry pairwise ranking (operator 6).

Every document has a vector of whole-text measures. Labelled documents give preference pairs
(a label-1 document beats a label-0 one); the weights maximise the likelihood of the
preferences, the logistic of the difference of two scores, so the loss sees only feature
differences. A quantile of the training scores then becomes the acceptance threshold, and
scores are moved so that it lies at `accept`.

The fit uses every labelled row outside the held-out fold, each distinct one (doc_id, text, label) weighted by the number
of its copies: up to MAX_LABELS on the driver, more in buckets of rows by Spark aggregates. Scoring covers every row.

Defined results: a null or empty text has zeros as measures and a score like any other; a
null doc_id is scored and never learned from; labels other than 0 and 1 are ignored; repeated
rows give repeated results; without labels of both kinds every score is 0.5; other columns
of the input are not read; an empty table gives an empty result; texts count whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, is_held_out, texts_of, written

#: Distinct labelled rows that are fitted on the driver (more are fitted by Spark), and opponents of each.
MAX_LABELS, OPPONENTS = 20_000, 8
#: Rows of a bucket of a large fit, pairs of them that a task differences at once, and bins of its strengths.
BUCKET_ROWS, PAIRS, BINS = 8_192, 16_384, 65_536
_UPPER = bytes(range(0x41, 0x5B))
_LETTERS = _UPPER + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_DIGITS = bytes(range(0x30, 0x3A))
_SENTENCE = b".,;:'\"()-"
_LOUD = b"!?"
_SPACE = b" \t\n\r\x0b\x0c"
_MARKS = bytes(b for b in range(0x21, 0x7F) if b not in _LETTERS + _DIGITS + _SENTENCE + _LOUD)
FEATURES = ["upper", "digits", "marks", "loud", "sentence", "space", "line_upper", "line_marks", "line_loud", "line_repeat",
            "repeat", "distinct", "word_length", "long_words", "length", "line_length", "same_lines", "run"]


def _line(b: bytes) -> tuple[float, float, float, float]:
    n = max(1, len(b))
    words = b.split()
    repeat = sum(map(eq, words, words[1:])) / max(1, len(words) - 1)
    return ((n - len(b.translate(None, _UPPER))) / n, (n - len(b.translate(None, _MARKS))) / n,
            (n - len(b.translate(None, _LOUD))) / n, repeat)


def measures(text: str) -> list[float]:
    """The feature vector of a text, in the order of FEATURES."""
    b = text.encode()
    if not b.strip():
        return [0.0] * len(FEATURES)
    n = len(b)

    def share(chars):
        return (n - len(b.translate(None, chars))) / n
    words = b.split()
    m = len(words)
    same = [i for i, x in enumerate(map(eq, words, words[1:])) if x]
    run = longest = 0
    last = -2
    for i in same:
        run = run + 1 if i == last + 1 else 1
        longest, last = max(longest, run), i
    lines = [x for x in b.split(b"\n") if x.strip()]
    worst = np.max([_line(x) for x in lines if len(x) > 20] or [_line(b)], axis=0)
    sizes = np.fromiter(map(len, words), np.int64, m)
    return [share(_UPPER), share(_DIGITS), share(_MARKS), share(_LOUD), share(_SENTENCE), share(_SPACE),
            *worst.tolist(), len(same) / max(1, m - 1), np.log1p(len(set(words))) / np.log1p(m), float(sizes.mean()),
            float((sizes > 20).mean()), float(np.log1p(n)), float(np.log1p(n / len(lines))),
            1 - len(set(lines)) / len(lines), float(np.log1p(longest))]


def measures_of(texts: pa.Array) -> np.ndarray:
    """Feature vectors of many texts, of which one at a time is held besides the array."""
    x = np.empty((len(texts), len(FEATURES)))
    for i, t in enumerate(texts):
        x[i] = measures(t.as_py() or "")
    return x


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x array<double>) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([keys, pa.array([measures(t) for t in texts], pa.list_(pa.float64()))],
                                             names=["doc_id", "x"])
    return texts_of(df, id_col, text_col).mapInArrow(run, "doc_id long, x array<double>")


class BradleyTerry:
    """Linear strengths w.z(x) of standardised features, an acceptance threshold and a unit."""

    def __init__(self, mean, scale, w, threshold: float, unit: float, accept: float):
        self.mean, self.scale, self.w = mean, scale, w
        self.threshold, self.unit, self.accept = threshold, unit, accept

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.w

    def score(self, x: np.ndarray) -> np.ndarray:
        if not np.any(self.w):
            return np.full(len(x), 0.5)
        t = (self.strength(x) - self.threshold) / self.unit + np.log(self.accept / (1 - self.accept))
        return 1 / (1 + np.exp(-np.clip(t, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None, accept: float = 0.3, ridge: float = 1e-2, seed: int = 7) -> BradleyTerry:
    """Newton steps on the logistic loss of feature differences; then the threshold quantile. A row
    counts `n` times (once)."""
    d = x.shape[1] if x.ndim == 2 else len(FEATURES)
    flat = BradleyTerry(np.zeros(d), np.ones(d), np.zeros(d), 0.0, 1.0, accept)
    if len(y) == 0 or y.min() == y.max():
        return flat
    n = np.ones(len(y)) if n is None else n.astype(float)
    mean = np.average(x, axis=0, weights=n)
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=n))
    scale = np.where(scale > 1e-12, scale, 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    # every labelled row meets some opponents, so pairs grow with rows, not with their square
    def drawn(rows, size):  # in proportion to their copies
        return rng.choice(rows, size, p=None if (n == 1).all() else n[rows] / n[rows].sum())
    opponents = drawn(good, OPPONENTS * len(bad)), drawn(bad, OPPONENTS * len(good))
    a = np.concatenate([np.repeat(good, OPPONENTS), opponents[0]])
    b = np.concatenate([opponents[1], np.repeat(bad, OPPONENTS)])
    weight = np.concatenate([np.repeat(n[good], OPPONENTS), np.repeat(n[bad], OPPONENTS)])
    weight /= weight.sum()
    diff = z[a] - z[b]
    w = np.zeros(d)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))  # probability of the preference
        grad = diff.T @ ((1 - p) * weight) - ridge * w
        hess = (diff * (p * (1 - p) * weight)[:, None]).T @ diff + ridge * np.eye(d)
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    s = z @ w
    order = np.argsort(s, kind="stable")
    s, up, down = s[order], (n * (y == 1))[order], (n * (y == 0))[order]
    # cutting at quantile i / n rejects the i lowest: its balanced error on the training rows
    error = (np.concatenate([[0], np.cumsum(up)]) / up.sum()
             + (down.sum() - np.concatenate([[0], np.cumsum(down)])) / down.sum())
    at = int(np.argmin(error[1:-1])) + 1 if len(s) > 1 else 0
    threshold = (s[at - 1] + s[at]) / 2 if at else s[0]
    low, high = (np.quantile(s, q, weights=n[order], method="inverted_cdf") if (n != 1).any() else np.quantile(s, q) for q in (0.25, 0.75))
    unit = max(float(high - low), 1e-6)
    return BradleyTerry(mean, scale, w, float(threshold), unit, accept)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, x) of every row, measured once and written; `tag` tells texts apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array(list(measures_of(batch.column(1))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), x], names=["doc_id", "tag", "x"])
    rows = texts_of(docs).select("doc_id", "text", F.xxhash64("text").alias("tag"))
    return written(rows.mapInArrow(run, "doc_id long, tag long, x array<double>"), "op6_measures")


def learn(docs: DataFrame, labels: DataFrame, fold: int = 5, held_out: int = 0, accept: float = 0.3,
          max_labels: int | None = None, rows: DataFrame | None = None) -> BradleyTerry:
    """Fit on all labelled rows outside the held-out fold: up to MAX_LABELS distinct ones on the driver, more of them by
    :func:`fit_many`. `max_labels`: a caller's own limit, by the hash of doc_id. `rows`: :func:`measured`, if it is there."""
    picked = (labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality"))
              .where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
              .where(~is_held_out(F.col("doc_id"), fold, held_out)))
    if max_labels is not None:
        picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labels)
    found = ((measured(docs) if rows is None else rows).join(picked, "doc_id").groupBy("doc_id", "quality", "tag")
             .agg(F.count("*").alias("n"), F.min("x").alias("x")))
    found = written(found, "op6_labelled")
    limit = MAX_LABELS if max_labels is None else max_labels
    size = found.count()
    if max_labels is None and size > limit:
        return fit_many(found, size, accept)
    found = found.orderBy(F.xxhash64("doc_id", "tag"), "doc_id", "tag", "quality").limit(limit).select("doc_id", "quality", "tag", "n", "x").toArrow()
    x = np.array(found["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    y, n = found["quality"].to_numpy(), found["n"].to_numpy()
    order = np.lexsort((found["tag"].to_numpy(), y, found["doc_id"].to_numpy()))
    return fit(x[order], y[order], n[order], accept)


def _added(rows: DataFrame, sums) -> np.ndarray:
    """Sum over the groups (column `bucket`) of the vector that `sums` makes of each."""
    def run(key, table):
        x = np.array(table["x"].to_pylist(), float)
        v = sums(int(key[0].as_py()), x, table["quality"].to_numpy(), table["n"].to_numpy().astype(float))
        return pa.table({"v": pa.array([v.tobytes()], pa.binary())})

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # one vector a task reaches the driver
        held = None
        for batch in batches:
            for b in batch.column(0).to_pylist():
                held = np.frombuffer(b) if held is None else held + np.frombuffer(b)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], names=["v"])
    parts = rows.groupBy("bucket").applyInArrow(run, "v binary").mapInArrow(total, "v binary").toArrow()["v"].to_pylist()
    return np.sum([np.frombuffer(b) for b in sorted(parts)], axis=0)


def fit_many(found: DataFrame, size: int, accept: float = 0.3, ridge: float = 1e-2, seed: int = 7, per_bucket: int = BUCKET_ROWS) -> BradleyTerry:
    """:func:`fit` over (doc_id, quality, tag, n, x) of any number: rows are dealt at random into buckets, in which every row
    meets opponents of the other label, and a Newton step is one aggregate over the buckets. The cut is taken from
    counts of all rows in BINS bins of the strengths. The driver holds sums, a vector a task, and the bins."""
    d = len(FEATURES)
    buckets = max(1, -(-size // per_bucket))
    rows = found.select("quality", "n", "x", F.pmod(F.xxhash64("doc_id", "tag", F.lit(seed)), F.lit(buckets)).cast("int").alias("bucket"),
                        F.xxhash64("doc_id", "tag", "quality").alias("h"))
    rows = written(rows.repartition("bucket").sortWithinPartitions("bucket", "h"), "op6_buckets")
    s = _added(rows, lambda _, x, y, n: np.concatenate([n @ x, [n.sum(), n @ (y == 1)]]))
    if s[-1] == 0 or s[-1] == s[-2]:
        return BradleyTerry(np.zeros(d), np.ones(d), np.zeros(d), 0.0, 1.0, accept)
    mean = s[:d] / s[d]
    scale = np.sqrt(_added(rows, lambda _, x, y, n: n @ (x - mean) ** 2) / s[d])
    scale = np.where(scale > 1e-12, scale, 1.0)

    def step(w):
        def sums(bucket, x, y, n):
            order = np.lexsort((*x.T, n, y))  # the same opponents whatever the order of rows
            z, y, n = np.clip((x[order] - mean) / scale, -8, 8), y[order], n[order]
            rng = np.random.default_rng([seed, bucket])
            good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
            if not len(good) or not len(bad):
                return np.zeros(d + d * d + 1)
            a = np.concatenate([np.repeat(good, OPPONENTS), rng.choice(good, OPPONENTS * len(bad), p=n[good] / n[good].sum())])
            b = np.concatenate([rng.choice(bad, OPPONENTS * len(good), p=n[bad] / n[bad].sum()), np.repeat(bad, OPPONENTS)])
            weight = np.concatenate([np.repeat(n[good], OPPONENTS), np.repeat(n[bad], OPPONENTS)])
            grad, hess = np.zeros(d), np.zeros((d, d))
            for i in range(0, len(a), PAIRS):
                diff, share = z[a[i:i + PAIRS]] - z[b[i:i + PAIRS]], weight[i:i + PAIRS]
                p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
                grad += diff.T @ ((1 - p) * share)
                hess += (diff * (p * (1 - p) * share)[:, None]).T @ diff
            return np.concatenate([grad, hess.reshape(-1), [weight.sum()]])
        v = _added(rows, sums)
        return v[:d] / v[-1] - ridge * w, v[d:-1].reshape(d, d) / v[-1] + ridge * np.eye(d)
    w = np.zeros(d)
    for _ in range(30):
        grad, hess = step(w)
        move = np.linalg.solve(hess, grad)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    model = BradleyTerry(mean, scale, w, 0.0, 1.0, accept)
    reach = 8 * np.abs(w).sum() + 1e-12  # no strength is beyond it

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = model.strength(np.array(batch.column(0).to_pylist(), float).reshape(-1, d))
            at = np.clip((t / reach + 1) / 2 * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(t), batch.column(1), batch.column(2)], names=["at", "t", "quality", "n"])
    bins = (rows.select("x", "quality", "n").mapInArrow(binned, "at int, t double, quality int, n long").groupBy("at")
            .agg(F.min("t").alias("low"), F.max("t").alias("high"), F.sum(F.col("n") * F.col("quality")).alias("up"), F.sum("n").alias("n"))
            .orderBy("at").toArrow())  # at most BINS rows
    low, high, up, n = (bins[c].to_numpy().astype(float) for c in ("low", "high", "up", "n"))
    error = np.cumsum(up) / up.sum() + 1 - np.cumsum(n - up) / (n - up).sum()  # of a cut above each bin
    at = int(np.argmin(error[:-1])) if len(n) > 1 else 0
    model.threshold = float((high[at] + low[at + 1]) / 2 if len(n) > 1 else low[0])
    share = np.cumsum(n) / n.sum()
    model.unit = max(float(high[np.searchsorted(share, 0.75)] - high[np.searchsorted(share, 0.25)]), 1e-6)
    return model


def score_documents(docs: DataFrame, labels: DataFrame, fold: int = 5, held_out: int = 0, accept: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; each text is measured once, for the fit and the score."""
    rows = measured(docs)
    model = learn(docs, labels, fold, held_out, accept, rows=rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(np.array(batch.column(1).to_pylist(), float).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= accept).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])
    scored = rows.select("doc_id", "x").mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", is_held_out(F.col("doc_id"), fold, held_out).alias("held_out"), "score", "predicted")


def keep_accepted(docs: DataFrame, labels: DataFrame, accept: float = 0.3) -> DataFrame:
    """The rows of `docs` that the classifier accepts, with their own columns, without a shuffle."""
    model = learn(docs, labels, accept=accept)

    @F.arrow_udf("boolean")
    def accepted(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(measures_of(texts)) >= accept)
    return docs.where(accepted(docs["text"].cast("string")))
