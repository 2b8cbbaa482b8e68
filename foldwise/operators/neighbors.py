"""Exact k-nearest-neighbour join that leaves out what cannot be a neighbour.

Rows fall into the leaves of a k-d tree whose cuts come from a sample of the right rows. The boxes of the leaves, and how
many right rows each has, bound the k-th neighbour distance of every row of a left leaf; a right leaf is sent only to the
blocks of left leaves whose bound it can meet, once to each, and a task looks again, leaf by leaf, with the distances it
has found. The result is exact whatever the cuts; they decide only how much is left out. Where the boxes leave out less
than half of the pairs (many features), and where the pairs fit one round of tasks, the join is not cut. With ``by`` keys
(class, fold), each of their values has bounds of its own. Of right rows that are equal in all features only those with
the smallest keys can be among the k, so where many are equal the others are not compared.

A cell's rows are dealt into blocks, and every left block meets every right block once in a
``cogroup`` task, where numpy keeps each left row's best k. Only k rows per (left row, right
block) leave a task, and a ranking per left row keeps the best. The number of blocks follows
both the rows and the session's parallelism, so neither a small table nor a large cell is one
task, and a row is sent at most once a block, so what tasks hold and what is shuffled do not depend on how well the tree cuts.
Distances: 'euclidean' or 'manhattan'; ties go to the smaller right key.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.operators.nulls import complete_features
from foldwise.sources.sink import write_and_read

OUT_SCHEMA = "left_id long, right_id long, dist double, grp string"
METRICS = ("euclidean", "manhattan")
#: Leaves of a tree, pairs of leaves over all groups, sample rows a leaf.
MAX_LEAVES, MAX_BOUNDS, LEAF_SAMPLE = 4_096, 20_000_000, 32
#: Row pairs that one task compares in about a second.
TASK_PAIRS = 5_000_000
#: Row pairs below which a block is not made smaller for the sake of more tasks.
SHORT_PAIRS = 1_000_000
#: Bounds are widened by this share, so that rounding never leaves out a neighbour.
SLACK = 1e-9


#: Numbers of a working array (32 MB), and of one that stays in a core's cache.
CELLS, CACHED = 4_000_000, 65_536
#: Right rows that are looked at together when the k-th distance is bounded.
STRIPES = 32
#: Left rows that look for their neighbours together; right rows of their first look.
NEAR_ROWS, FIRST_ROWS = 32, 512
#: With more features, a tree that leaves out less than half of the pairs is not used.
FEW_FEATURES = 16
#: Tasks for each core; a block with leaves has so many times as many right rows.
WAVES, WIDE_BLOCK = 4, 8


def _paired(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances along the last axis. 'mixed:i,j': Manhattan, with 0 or 1 (equal or not) for the features at i, j."""
    diff = a - b
    if metric == "euclidean":
        return np.sqrt(np.sum(diff * diff, axis=-1))
    diff = np.abs(diff)
    if metric.startswith("mixed:"):
        at = [int(i) for i in metric[6:].split(",") if i]
        diff[..., at] = diff[..., at] > 0
    return np.sum(diff, axis=-1)


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances, from working arrays of at most about CELLS numbers."""
    step = max(1, CELLS // max(1, b.size))
    return np.concatenate([_paired(a[s:s + step, None, :], b[None, :, :], metric) for s in range(0, max(1, len(a)), step)])


def _summed(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Manhattan (or mixed) distances, added up feature by feature in arrays that stay in the cache."""
    at = {int(i) for i in metric[6:].split(",") if i} if metric.startswith("mixed:") else set()
    columns, out = np.ascontiguousarray(b.T), np.zeros((len(a), len(b)))
    step = max(1, CACHED // max(1, len(b)))
    for s in range(0, len(a), step):
        total, rows = out[s:s + step], a[s:s + step]
        part = np.empty_like(total)
        for f in range(a.shape[1]):
            np.subtract(rows[:, f, None], columns[f][None, :], out=part)
            np.abs(part, out=part)
            total += (part > 0) if f in at else part
    return out


def _single(a: np.ndarray, b: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray] | None:
    """:func:`_summed` in single precision, with the largest error of each row; None where numbers are too large for that."""
    at = {int(i) for i in metric[6:].split(",") if i} if metric.startswith("mixed:") else set()
    rest = [f for f in range(a.shape[1]) if f not in at]
    middle = (b[:, rest].min(axis=0) + b[:, rest].max(axis=0)) / 2  # numbers near zero lose less
    x, y = a[:, rest] - middle, b[:, rest] - middle
    largest = np.abs(x).sum(axis=1) + np.abs(y).sum(axis=1).max()
    if not (largest < 1e30).all():
        return None
    # the rounding of the numbers, and that of each difference and sum: none is above ``largest``, and there are F of either
    error = (a.shape[1] + 4) * float(np.finfo(np.float32).eps) * (largest + len(at))
    x, columns, out = x.astype(np.float32), np.ascontiguousarray(y.T.astype(np.float32)), np.zeros((len(a), len(b)), np.float32)
    discrete = [(f, np.ascontiguousarray(b[:, f])) for f in at]
    step = max(1, CACHED // max(1, len(b)))
    work = np.empty((min(step, len(a)), len(b)), np.float32)
    for s in range(0, len(a), step):
        total = out[s:s + step]
        part = work[:len(total)]
        for f in range(len(rest)):
            np.subtract(x[s:s + step, f, None], columns[f][None, :], out=part)
            np.abs(part, out=part)
            total += part
        for f, column in discrete:  # 0 or 1, from the numbers themselves
            total += np.abs(a[s:s + step, f, None] - column[None, :]) > 0
    return out, error


def _positions(mask: np.ndarray) -> np.ndarray:
    """Where few entries of a mask are set, counted row by row; eight are looked at as one."""
    flat = mask.reshape(-1)
    whole = len(flat) // 8 * 8
    some = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).reshape(-1)
    return np.concatenate([some[flat[some]], whole + np.flatnonzero(flat[whole:])])


def _near_pairs(a: np.ndarray, b: np.ndarray, k: int, metric: str, same) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of few pairs that hold the k nearest rows of ``b`` for each of ``a``, and all that tie with the
    k-th. Distances are first taken from one matrix product, or added up by feature in single precision, with a bounded error; the pairs within
    that error of the k-th are computed in full. ``same``: pairs that do not count (a mask, or their positions)."""
    slack = None
    if metric == "euclidean":
        aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
        d = a @ b.T
        d *= -2
        d += aa[:, None]
        d += bb[None, :]
        slack = 8 * (a.shape[1] + 4) * np.finfo(float).eps * (aa[:, None] + bb.max())
    elif (single := _single(a, b, metric)) is not None:
        d, slack = single[0], 2 * single[1][:, None].astype(np.float32)  # of the pair and of the k-th
    else:
        d = _summed(a, b, metric)
    if same is not None:
        d[same] = np.inf
    kk, wide = min(k, d.shape[1]), d.shape[1] // STRIPES
    if wide >= 4 * kk:  # the k-th least of the stripes' minima is not below the k-th least of all
        kth = np.partition(np.fmin.reduce(d[:, :wide * STRIPES].reshape(len(d), STRIPES, wide), axis=1), kk - 1, axis=1)[:, kk - 1:kk]
        kth = np.where(np.isnan(kth), np.float32(np.inf), kth)
    else:
        kth = np.partition(d, kk - 1, axis=1)[:, kk - 1:kk]
    if slack is None:
        slack = 4 * (a.shape[1] + 1) * np.finfo(float).eps * kth
    i, j = np.divmod(_positions(d <= kth + slack), d.shape[1])
    some = np.isfinite(d[i, j])
    i, j = i[some], j[some]
    step = max(1, CELLS // max(1, a.shape[1]))
    return i, j, np.concatenate([_paired(a[i[s:s + step]], b[j[s:s + step]], metric) for s in range(0, max(1, len(i)), step)])


def _gaps(lo: np.ndarray, hi: np.ndarray, los: np.ndarray, his: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(least, largest) distances between each of the first boxes and each of the second."""
    at = {int(i) for i in metric[6:].split(",") if i} if metric.startswith("mixed:") else set()
    near, far = np.zeros((len(lo), len(los))), np.zeros((len(lo), len(los)))
    for f in range(lo.shape[1]):
        a, b, c, d = lo[:, f, None], hi[:, f, None], los[None, :, f], his[None, :, f]
        if f in at:
            near += (c > b) | (a > d)
            far += ~((a == b) & (c == d) & (a == c))
        elif metric == "euclidean":
            near += np.maximum(np.maximum(c - b, a - d), 0) ** 2
            far += np.maximum(d - a, b - c) ** 2
        else:
            near += np.maximum(np.maximum(c - b, a - d), 0)
            far += np.maximum(d - a, b - c)
    return (np.sqrt(near), np.sqrt(far)) if metric == "euclidean" else (near, far)


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.array(pdf["x"].tolist(), dtype=np.float64)


def _best(lid: np.ndarray, L: np.ndarray, rid: np.ndarray, R: np.ndarray, k: int, exclude_self: bool, metric: str) -> list[tuple]:
    """[(i, j, distance)]: the k nearest, ties at the k-th distance settled by key."""
    step = max(1, CELLS // 4 // max(1, len(rid)))
    outs = []
    for s in range(0, len(lid), step):
        same = None
        if exclude_self:  # the left rows' keys are few: the right ones are looked up among them
            by_id = np.argsort(lid[s:s + step], kind="stable")
            mine = lid[s:s + step][by_id]
            lo, hi = np.searchsorted(mine, rid), 0
            column = np.flatnonzero(mine[np.minimum(lo, len(mine) - 1)] == rid)
            lo, hi = lo[column], np.searchsorted(mine, rid[column], side="right")
            column = np.repeat(column, hi - lo)
            same = by_id[np.arange(len(column)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)], column
        i, j, d = _near_pairs(L[s:s + step], R, k, metric, same)
        order = np.lexsort((rid[j], d, i))
        i, j, d = i[order], j[order], d[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        outs.append((s + i[first], j[first], d[first]))
    return outs


def _block_topk(k: int, exclude_self: bool, metric: str, per: bool = False):
    def fn(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if per and not left.empty and not right.empty:  # the k nearest of each kind of right rows
            return pd.concat([block(left, rows).assign(grp=kind) for kind, rows in right.groupby("__per")], ignore_index=True)
        return block(left, right)

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"left_id": pd.Series([], dtype="int64"),
                                 "right_id": pd.Series([], dtype="int64"),
                                 "dist": pd.Series([], dtype="float64"),
                                 "grp": pd.Series([], dtype="object")})
        L, R = _matrix(left), _matrix(right)
        lid = left["__id"].to_numpy(dtype=np.int64)
        rid = right["__id"].to_numpy(dtype=np.int64)
        outs = []
        if "leaf" in left.columns:
            parts = by_leaf(L, R, lid, rid, right["leaf"].to_numpy())
        else:
            parts = _best(lid, L, rid, R, k, exclude_self, metric)
        for i, j, d in parts:
            outs.append((lid[i], rid[j], d))
        out = pd.DataFrame({c: np.concatenate(v) for c, v in zip(("left_id", "right_id", "dist"), zip(*outs))})
        out["grp"] = str(left["__grp"].iloc[0])
        return out

    def by_leaf(L, R, lid, rid, rleaf):
        """For a few left rows that lie together: the nearest right leaves first, then all that a row's k-th distance found so far can reach."""
        rorder = np.argsort(rleaf, kind="stable")
        rcut = np.append(np.unique(rleaf[rorder], return_index=True)[1], len(rleaf))
        size = np.diff(rcut)
        rlo, rhi = _boxes(R[rorder], rcut[:-1], metric)
        for mine in _together(L, np.arange(len(L))):
            x = L[mine]
            near = _gaps(*_boxes(x, np.array([0]), metric), rlo, rhi, metric)[0][0] * (1 - SLACK)
            nearest = np.argsort(near, kind="stable")
            asked = np.sort(nearest[:int(np.searchsorted(np.cumsum(size[nearest]), max(2 * k, FIRST_ROWS))) + 1])
            while True:
                rows = rorder[np.concatenate([np.arange(rcut[c], rcut[c + 1]) for c in asked])]
                found = _best(lid[mine], x, rid[rows], R[rows], k, exclude_self, metric)
                if len(asked) == len(size):
                    break
                kth = np.full(len(mine), np.inf)
                i, d = np.concatenate([i for i, _, _ in found]), np.concatenate([d for _, _, d in found])
                full = np.bincount(i, minlength=len(mine)) >= k
                most = np.zeros(len(mine))
                np.maximum.at(most, i, d)
                kth[full] = most[full]
                reach = near <= kth.max()
                reach[asked] = False
                more = np.flatnonzero(reach)
                if len(more):
                    more = more[(_gaps(x, x, rlo[more], rhi[more], metric)[0] * (1 - SLACK) <= kth[:, None]).any(axis=0)]
                if not len(more):
                    break
                asked = np.sort(np.concatenate([asked, more]))
            yield from ((mine[i], rows[j], d) for i, j, d in found)
    return fn


def _together(x: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """The rows in groups of at most NEAR_ROWS that lie together: halved across the widest feature."""
    if len(rows) <= NEAR_ROWS:
        return [rows]
    with np.errstate(invalid="ignore"):
        f = int(np.nan_to_num(np.ptp(x[rows], axis=0)).argmax())
    order = rows[np.argsort(x[rows, f], kind="stable")]
    return [*_together(x, order[:len(order) // 2]), *_together(x, order[len(order) // 2:])]


def _boxes(x: np.ndarray, starts: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(lo, hi) of each run of rows; NaN, which equals anything as a discrete feature, has no bounds."""
    return (np.minimum.reduceat(np.where(np.isnan(x), -np.inf, x), starts), np.maximum.reduceat(np.where(np.isnan(x), np.inf, x), starts))


def _vectors(df: DataFrame, key: str, features: list[str] | str, *extra) -> DataFrame:
    x = F.col(features) if isinstance(features, str) else F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    return df.select(F.col(key).cast("long").alias("__id"), *extra, x.alias("x"))


def _parallelism(df: DataFrame) -> int:
    return max(1, df.sparkSession.sparkContext.defaultParallelism)


class Tree:
    """k-d tree: nodes with a feature (-1: a leaf, numbered from left to right), a cut and two children."""

    def __init__(self, sample: np.ndarray, leaves: int, discrete: set[int]):
        self.at, self.cut, self.child, self.number = [], [], [], []
        self._grow(sample, leaves, discrete)
        self.at, self.cut, self.child, self.number = map(np.array, (self.at, self.cut, self.child, self.number))
        self.size = int(self.number.max()) + 1

    def _grow(self, x: np.ndarray, leaves: int, discrete: set[int]) -> int:
        node = len(self.at)
        for v, new in ((self.at, -1), (self.cut, 0.0), (self.child, (0, 0)), (self.number, -1)):
            v.append(new)
        spread = np.ptp(x, axis=0) if len(x) else np.zeros(1)
        spread = np.array([float(s > 0) if f in discrete else s for f, s in enumerate(spread)])
        if leaves < 2 or not spread.max() > 0:
            self.number[node] = max(self.number) + 1
            return node
        f = int(spread.argmax())
        v = np.sort(x[:, f])
        gaps = np.diff(v)
        middle = gaps[len(v) // 4:-(len(v) // 4) or None]  # the widest gap of the middle half, if there is one
        i = len(v) // 4 + int(middle.argmax()) if len(middle) and middle.max() > 0 else int(gaps.argmax())
        low = x[:, f] <= v[i]
        self.at[node], self.cut[node] = f, v[i]
        share = min(leaves - 1, max(1, round(leaves * (i + 1) / len(v))))
        self.child[node] = self._grow(x[low], share, discrete), self._grow(x[~low], leaves - share, discrete)
        return node

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), int)
        while True:
            f = self.at[node]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return self.number[node].astype(np.int32)
            node[inner] = self.child[node[inner], (x[inner, f[inner]] > self.cut[node[inner]]).astype(int)]


def _hashed_first(df: DataFrame, most: int, n: int) -> DataFrame:
    """The ``most`` rows of ``n`` with the least hashes of their keys. Every task would send the driver as many of its own rows: so
    only those go into the order whose hash is below about twice the share that is wanted."""
    h = F.xxhash64("__id")
    if 2 * most < n:
        df = df.where(h < F.lit(int(2.0 * most / n * 2 ** 64) - 2 ** 63))
    return df.orderBy(h, "__id").limit(most)


def _cells(left: DataFrame, right: DataFrame, k: int, metric: str, n_right: int, groups: int = 1, block_rows: int = 20000) -> tuple[DataFrame, DataFrame]:
    """(left with its cell, right with a row for every cell that it can matter to); with leaves where they leave out
    half of the pairs, else all in one cell. Both sides have __id, __grp and x; bounds hold within a group.

    A cell is a run of left leaves of one group. The driver holds a sample of LEAF_SAMPLE rows a leaf, the boxes of the
    leaves and, for every group, the cells that a leaf is sent to: with many groups there are fewer leaves, so that
    this stays under MAX_BOUNDS pairs of leaves."""
    spark = left.sparkSession
    discrete = {int(i) for i in metric[6:].split(",") if i} if metric.startswith("mixed:") else set()
    leaves = max(1, min(MAX_LEAVES, math.isqrt(n_right), math.isqrt(MAX_BOUNDS // groups)))
    usable = F.forall("x", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))) if not discrete else F.lit(True)
    rows = _hashed_first(right.where(usable), LEAF_SAMPLE * leaves, n_right).select("x").collect()
    sample = np.array([r["x"] for r in rows], dtype=np.float64)
    sample = sample[np.isfinite(sample).all(axis=1)] if len(sample) else np.zeros((0, 1))
    tree = Tree(sample, leaves, discrete)
    kinds = ["__grp", "__per"] if "__per" in right.columns else ["__grp"]
    whole = lambda x: np.isfinite(x[:, [f for f in range(x.shape[1]) if f not in discrete]]).all(axis=1)

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf)
                ok = whole(x)  # others have no distance to any row
                yield pdf.assign(leaf=tree.leaf(x))[ok]

    def boxes(table: DataFrame, by: list[str]) -> DataFrame:
        """(leaf, by, n, lo, hi), by a task, then by a leaf."""
        schema = "leaf int, " + ", ".join(f"{c} string" for c in by) + ", n long, lo array<double>, hi array<double>"

        def folded(of, n, lo, hi):
            """One row for each leaf and kind."""
            code = of.groupby(["leaf", *by], sort=False).ngroup().to_numpy()
            order = np.argsort(code, kind="stable")
            starts = np.unique(code[order], return_index=True)[1]
            return of.iloc[order[starts]], np.add.reduceat(n[order], starts), np.minimum.reduceat(lo[order], starts), np.maximum.reduceat(hi[order], starts)

        def rows_of(of, n, lo, hi):
            return of.assign(n=n, lo=list(lo), hi=list(hi))

        def joined(pdf):
            lo, hi = (np.array(pdf[c].tolist(), np.float64) for c in ("lo", "hi"))
            return rows_of(*folded(pdf[["leaf", *by]], pdf["n"].to_numpy(), lo, hi))

        def sums(batches):
            held = None
            for pdf in batches:
                x = _matrix(pdf)
                if len(x):
                    part = folded(pdf[["leaf", *by]], np.ones(len(x), np.int64), *_boxes(x, np.arange(len(x)), metric))
                    if held is not None:
                        part = folded(pd.concat([held[0], part[0]], ignore_index=True), *[np.concatenate(v) for v in zip(held[1:], part[1:])])
                    held = part
            if held is not None:
                yield rows_of(*held)
        return table.select("leaf", *by, "x").mapInPandas(sums, schema).groupBy("leaf").applyInPandas(joined, schema)
    lcols, rcols = (", ".join(f"{c} {t}" for c, t in df.dtypes) for df in (left, right))
    left = write_and_read(left.mapInPandas(assign, f"{lcols}, leaf int"), "knn_left")
    right = write_and_read(right.mapInPandas(assign, f"{rcols}, leaf int"), "knn_right")
    mine = boxes(left, ["__grp"]).collect()  # leaves x groups
    other = boxes(right, kinds).collect()  # leaves x groups x kinds
    n, d = tree.size, len(mine[0]["lo"]) if mine else 1
    box = np.full((2, n, d), np.inf), np.full((2, n, d), -np.inf)  # (lo, hi) of both sides; no rows: nothing is near
    for side, found in enumerate((mine, other)):
        for r in found:
            box[0][side, r["leaf"]] = np.minimum(box[0][side, r["leaf"]], r["lo"])
            box[1][side, r["leaf"]] = np.maximum(box[1][side, r["leaf"]], r["hi"])
    lefts: dict = {}
    rights: dict = {}
    for r in mine:
        lefts.setdefault(r["__grp"], np.zeros(n, np.int64))[r["leaf"]] = r["n"]
    for r in other:
        rights.setdefault(r["__grp"], {}).setdefault(r[kinds[-1]], np.zeros(n, np.int64))[r["leaf"]] = r["n"]
    size = max(1, min(block_rows, sum(v.sum() for v in lefts.values()) // (WAVES * _parallelism(left))))
    cell = {g: np.cumsum(v) // size for g, v in lefts.items()}  # of every leaf
    sent = {g: np.zeros((n, int(cell[g][-1]) + 1), bool) for g in lefts if g in rights}  # right leaf, cell
    pairs, every = 0, sum(int(lefts[g].sum()) * int(sum(rights[g].values()).sum()) for g in sent)
    used = np.flatnonzero(sum(sum(by.values()) for by in rights.values())) if rights else np.zeros(0, int)  # right leaves with rows
    for s in range(0, n, 64):
        rows = slice(s, s + 64)
        with np.errstate(invalid="ignore"):
            near, far = _gaps(box[0][0, rows], box[1][0, rows], box[0][1, used], box[1][1, used], metric)
        order = np.argsort(far, axis=1)
        far = np.take_along_axis(far, order, axis=1)
        for g, to in sent.items():
            bound = np.zeros(len(near))
            for by in rights[g].values():
                enough = np.cumsum(by[used][order], axis=1) >= k
                bound = np.maximum(bound, np.where(enough.any(axis=1), far[np.arange(len(far)), enough.argmax(axis=1)], np.inf))
            need = ~(near > bound[:, None] * (1 + SLACK)) & (lefts[g][rows] > 0)[:, None]
            pairs += int(lefts[g][rows] @ (need @ sum(rights[g].values())[used]))
            for i in np.flatnonzero(lefts[g][rows]):
                to[used[need[i]], cell[g][s + i]] = True
    if pairs > every / 2 and d > FEW_FEATURES:
        return left.drop("leaf").withColumn("cell", F.lit(0)), right.drop("leaf", "__grp").withColumn("cell", F.lit(0))
    homes = [(g, int(i), int(cell[g][i])) for g in lefts for i in np.flatnonzero(lefts[g])]
    goals = [(g, int(i), np.flatnonzero(to[i]).tolist()) for g, to in sent.items() for i in np.flatnonzero(to.any(axis=1))]
    left = left.join(F.broadcast(spark.createDataFrame(homes, "__grp string, leaf int, cell int")), ["__grp", "leaf"])
    right = right.join(F.broadcast(spark.createDataFrame(goals, "__grp string, leaf int, cells array<int>")), ["__grp", "leaf"])
    return left, right.withColumn("cell", F.explode("cells")).drop("cells", "__grp")


def _in_blocks(left: DataFrame, right: DataFrame, keys: list[str], block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with block numbers: a left row once per right block of its keys, and the
    other way round. One row of counts per key value; hot keys get more blocks."""
    parallel = _parallelism(left)
    sizes = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__nl")).join(
        right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__nr")), keys)
    every = Window.partitionBy()  # over one row per key value
    if "leaf" in left.columns:  # leaves are left out within a block: few left rows, and as many right rows as a task may hold
        lside = F.least(F.lit(float(block_rows)), F.greatest(F.sum("__nl").over(every) / (WAVES * parallel), F.lit(1.0)))
        rside = F.lit(float(WIDE_BLOCK * block_rows))
    else:  # the pairs of a block: at most block_rows squared, and few enough for all tasks to have work
        pairs = F.col("__nl") * F.col("__nr")
        whole = F.sum(pairs).over(every)  # so many that tasks end at about the same time, unless they are short
        share = F.greatest(whole / (WAVES * parallel), F.least(whole / parallel, F.lit(float(SHORT_PAIRS))), F.lit(1e4))
        lside = rside = F.sqrt(F.least(F.lit(float(block_rows) ** 2), share))
    sizes = sizes.select(*keys, F.ceil(F.col("__nl") / lside).cast("int").alias("__nlb"), F.ceil(F.col("__nr") / rside).cast("int").alias("__nrb"))
    sizes = write_and_read(sizes, "knn_blocks")
    hashed = F.xxhash64("__id", F.lit(1))
    left = (left.join(sizes, keys).withColumn("__lb", F.pmod(hashed, F.col("__nlb")).cast("int"))
            .withColumn("__rb", F.explode(F.sequence(F.lit(0), F.col("__nrb") - 1))).drop("__nlb", "__nrb"))
    right = (right.join(sizes, keys).withColumn("__rb", F.pmod(hashed, F.col("__nrb")).cast("int"))
             .withColumn("__lb", F.explode(F.sequence(F.lit(0), F.col("__nlb") - 1))).drop("__nlb", "__nrb"))
    return left, right


def knn_join(left: DataFrame, right: DataFrame, features: list[str] | str, k: int, key: str = "row_id",
             by: list[str] | None = None, exclude_self: bool = False, metric: str = "euclidean",
             block_rows: int = 20000, right_features: list[str] | None = None,
             left_by: list[str] | None = None, left_rows: int | None = None, nulls: str = "error", per: str | None = None,
             discrete: list[int] = ()) -> DataFrame:
    """(left_id, rank, right_id, dist): the k nearest right rows of every left row.

    ``by``: right columns whose values must equal the left's ``left_by`` columns (default the
    same names) — e.g. the class for same-class neighbours; NULL equals nothing. ``nulls``:
    policy for rows with a NULL feature on either side. ``left_rows``: the number of left
    rows, if known. Features may also be the name of one column of complete vectors.
    ``per``: a right column, of whose every value the k nearest rows are wanted, from one search; the value comes as text
    in ``grp`` (NULL values are left out). ``discrete``: positions of features that differ by 0 or 1.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, got {metric!r}")
    if discrete:
        if metric != "manhattan":
            raise ValueError("discrete features need the Manhattan metric")
        metric = "mixed:" + ",".join(map(str, discrete))
    if per and by:
        raise ValueError("'per' and 'by' exclude each other")
    by = list(by or [])
    left_by = list(left_by or by)
    rf = right_features or features
    def group(cols):
        return (F.concat_ws("|", *[F.col(c).cast("string") for c in cols]) if cols else F.lit("")).alias("__grp")
    keys = [f"__by{i}" for i in range(len(by))]
    if not isinstance(features, str):
        left, right = complete_features(left, features, "k-NN join, left side", nulls), complete_features(right, rf, "k-NN join, right side", nulls)
    L = _vectors(left, key, features, group(left_by),
                 *[F.col(c).alias(f"__by{i}") for i, c in enumerate(left_by)])
    R = _vectors(right.where(F.col(per).isNotNull()) if per else right, key, rf, group(by),
                 *[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], *([F.col(per).cast("string").alias("__per")] if per else []))
    kind = ["__grp", "__per"] if per else ["__grp"]
    sizes = R.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("__grp").alias("g"),
                  F.approx_count_distinct(F.xxhash64(*kind, "x")).alias("v")).first()
    n_right, groups = sizes["n"], max(1, sizes["g"])
    n_left = left_rows if left_rows is not None else L.count()
    many = n_left * n_right / groups > TASK_PAIRS * _parallelism(left)
    # looking for what to leave out takes passes of its own; it pays beyond one round of tasks
    if many:
        # a left row's own key does not count: so many more right rows
        own = (R.groupBy("__id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) if exclude_self else 0
        if sizes["v"] < n_right / 2:  # of equal rows the smallest keys
            w = Window.partitionBy(*kind, "x").orderBy("__id")  # limited before the shuffle
            R = R.withColumn("__nth", F.row_number().over(w)).where(F.col("__nth") <= k + own).drop("__nth")
            n_right = min(n_right, sizes["v"] * (k + own))
        few = WAVES * _parallelism(left)  # a small file would be one task
        L, R = _cells(L.repartition(few), R.repartition(few), k + own, metric, n_right, groups, block_rows)
        keys.append("cell")
    elif not by:
        L, R = L.withColumn("cell", F.lit(0)), R.withColumn("cell", F.lit(0))
        keys.append("cell")
    L, R = _in_blocks(L, R, keys, block_rows)
    blocks = [*keys, "__lb", "__rb"]
    if many:  # by number: joined by their size, blocks would be too few tasks for their work
        tasks = max(WAVES * WAVES * _parallelism(left), int(L.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        L, R = L.repartition(tasks, *blocks), R.repartition(tasks, *blocks)
    cand = L.groupBy(*blocks).cogroup(R.groupBy(*blocks)).applyInPandas(_block_topk(k, exclude_self, metric, bool(per)), OUT_SCHEMA)
    # a left row has one candidate list per ``by`` group it was sent to
    w = Window.partitionBy("left_id", "grp").orderBy("dist", "right_id")
    out = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select("left_id", "rank", "right_id", "dist", *(["grp"] if by or per else []))
