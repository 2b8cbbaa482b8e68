"""Hard negatives by best-first search in STR-packed R-trees (operator 12).

Rows are (id, label, integer vector). They are packed by Sort-Tile-Recursive: the rows of a label are cut
into slabs along one coordinate after the other, widest first, into tiles; inside a tile the same goes on
down to leaves, whose minimum bounding boxes are packed into upper levels. A box bounds every inner
product with an anchor from both sides, coordinate by coordinate: the largest product takes the upper
side where the anchor's coordinate is positive and the lower side where it is negative. A queue takes boxes
by descending upper bound and leaves out those outside the wanted score windows, or strictly below the
k-th score found.

The search runs twice: an anchor's positives are the best rows of its label; each positive's score
then opens a window for rows of other labels. Each time an anchor first looks in its most promising tile, which gives
it k-th scores, and then in all other tiles whose box can still matter, in tasks of a tile and a block
of anchors. Nothing is approximate: cuts come from a sample of about SAMPLE rows, but every row is in a tile
and boxes are those of all their rows.

Tiles number at most about MAX_TILES (their rows grow with the table beyond), so the boxes that every task
holds are bounded. Equal vectors of one label are one group of ties, of which only the smallest ids can
be among the first: `k` + 1 of them are kept (one may be the anchor itself), so copies form no hot tile; tiles
that are still too full are dealt out by a hash.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part; a
shorter vector counts as filled up with zeros; exact repeats of a row count once; other rows with the
anchor's id (or a null id) are never its own positives or negatives if the ids are equal; a null id is no
anchor, and comes last among ties; anchors that share an id are asked separately; an empty table gives no
rows; columns besides id, vector and label are not read. Scores are exact in 64 bits.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows from which cuts are taken; rows of a tile and most tiles; rows of a leaf and boxes of an upper box; anchors of a task.
SAMPLE, TILE_ROWS, MAX_TILES, LEAF, FAN, BLOCK = 20_000, 4_096, 16_384, 64, 16, 4_096
#: Beyond any score.
FAR = 1 << 62


# -- packing ----------------------------------------------------------------------------------
def _slabs(pages: int, dims: int) -> int:
    """Sort-Tile-Recursive: slabs along a coordinate, with `dims` coordinates to go."""
    return max(2, math.ceil(pages ** (1 / max(1, dims)) - 1e-9))


def pack(x: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The order of rows in leaves of `leaf`: by label, then STR over the coordinates, widest first."""
    wide = np.argsort(-x.std(axis=0), kind="stable") if len(x) else np.empty(0, int)

    def tile(rows: np.ndarray, depth: int) -> list[np.ndarray]:
        pages = math.ceil(len(rows) / leaf)
        if pages <= 1 or depth >= len(wide):
            return [rows]
        rows = rows[np.argsort(x[rows, wide[depth]], kind="stable")]
        slabs = _slabs(pages, len(wide) - depth)
        step = math.ceil(pages / slabs) * leaf
        return [t for a in range(0, len(rows), step) for t in tile(rows[a:a + step], depth + 1)]
    out = [t for c in np.unique(labels) for t in tile(np.flatnonzero(labels == c), 0)]
    return np.concatenate(out) if out else np.empty(0, int)


class Cuts:
    """Tiles of a group of rows, by cuts that a sample gives: (coordinate, cuts, parts) or a tile's number."""

    def __init__(self, sample: np.ndarray, tiles: int, first: int):
        self.next = first
        wide = np.argsort(-sample.std(axis=0), kind="stable") if len(sample) else np.empty(0, int)
        self.root = self._cut(sample, tiles, wide, 0)

    def _cut(self, rows: np.ndarray, tiles: int, wide: np.ndarray, depth: int):
        if tiles <= 1 or depth >= len(wide) or len(rows) < 2:
            self.next += 1
            return self.next - 1
        slabs = _slabs(tiles, len(wide) - depth)
        c = wide[depth]
        cuts = np.unique(np.quantile(rows[:, c], np.arange(1, slabs) / slabs, method="inverted_cdf"))
        side = np.searchsorted(cuts, rows[:, c], side="right")
        return int(c), cuts, [self._cut(rows[side == i], math.ceil(tiles / slabs), wide, depth + 1) for i in range(len(cuts) + 1)]

    def tile(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), np.int32)

        def walk(node, rows):
            if isinstance(node, int):
                out[rows] = node
            elif len(rows):
                side = np.searchsorted(node[1], x[rows, node[0]], side="right")
                for i, part in enumerate(node[2]):
                    walk(part, rows[side == i])
        walk(self.root, np.arange(len(x)))
        return out


def _exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """As doubles where inner products are exact in them (below 2^53), else as 64-bit integers."""
    most = [float(np.abs(a).max()) if a.size else 0.0 for a in arrays]
    small = max(most) ** 2 * max(a.shape[-1] for a in arrays) < 2 ** 53
    return [a.astype(np.float64 if small else np.int64) for a in arrays]


def bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) inner product of every row of `q` with a point of every box."""
    q, lo, hi = _exact(q, lo, hi)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T


class RTree:
    """A tile: rows in packed order, and boxes of leaves and upper levels, highest level last."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, ids: np.ndarray, null: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        self.x, self.labels, self.ids, self.null, self.leaf, self.fan = x, labels, ids, null, leaf, fan
        at = np.arange(0, len(x), leaf)
        box = [f.reduceat(v, at) for f, v in ((np.minimum, x), (np.maximum, x), (np.minimum, labels), (np.maximum, labels))]
        self.levels = [box]
        while len(box[0]) > fan:
            at = np.arange(0, len(box[0]), fan)
            box = [f.reduceat(v, at) for f, v in zip((np.minimum, np.maximum, np.minimum, np.maximum), box)]
            self.levels.append(box)

    def search(self, q: np.ndarray, own: np.ndarray, label: np.ndarray, windows: list[list[tuple[int, int]]], floors: list[list[int]],
               same: bool, k: int) -> list[list[list[tuple]]]:
        """Per query and window: the first k rows (-score, null, id) of the same or of other labels with a score inside the
        window and not below its floor. Rows with the query's own id are left out."""
        sides = [bounds(q, lo, hi) for lo, hi, _, _ in self.levels]
        fits = [(a <= label[:, None]) & (b >= label[:, None]) if same else ~((a == label[:, None]) & (b == label[:, None]))
                for _, _, a, b in self.levels]
        q, x = _exact(q, self.x)
        return [self._one(x, q[i], own[i], label[i], windows[i], floors[i], [(a[i].tolist(), b[i].tolist()) for a, b in sides],
                          [f[i].tolist() for f in fits], same, k) for i in range(len(q))]

    def _one(self, x, q, own, label, windows, floors, sides, fits, same, k):
        found = [[] for _ in windows]
        need = [max(lo, f) for (lo, _), f in zip(windows, floors)]  # a score below it does not matter
        cap = max((hi for _, hi in windows), default=-FAR)
        queue = []

        def enter(level, nodes):
            low, high = sides[level]
            for n in nodes:
                if fits[level][n] and any(high[n] >= least and low[n] <= hi for (_, hi), least in zip(windows, need)):
                    heapq.heappush(queue, (-min(high[n], cap), level, n))
        enter(len(self.levels) - 1, range(len(self.levels[-1][0])))
        while queue:
            most, level, n = heapq.heappop(queue)
            if -most < min(need):
                break  # strictly below every k-th score: no box left can matter
            if level:
                enter(level - 1, range(n * self.fan, min((n + 1) * self.fan, len(self.levels[level - 1][0]))))
                continue
            a = n * self.leaf
            s = x[a:a + self.leaf] @ q
            if s.max() < min(need):
                continue
            here = slice(a, a + self.leaf)
            ok = ((self.labels[here] == label) if same else (self.labels[here] != label)) & ((self.ids[here] != own) | self.null[here])
            for w, (_, hi) in enumerate(windows):
                at = np.flatnonzero(ok & (s >= need[w]) & (s <= hi))
                if len(at):
                    best = found[w] + [(-int(s[j]), bool(self.null[a + j]), int(self.ids[a + j])) for j in at.tolist()]
                    best.sort()
                    found[w] = best[:k]
                    if len(best) >= k:
                        need[w] = max(need[w], -best[k - 1][0])
        return found


# -- the table --------------------------------------------------------------------------------
def prepared(df: DataFrame, vector: Column, id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """(id, label, x): complete rows once each, vectors filled up to one length. `vector`: a column of numbers, of
    which the floor counts."""
    rows = df.select(df[id_col].cast("long").alias("id"), df[label_col].cast("long").alias("label"), vector.alias("v"))
    finite = F.forall("v", lambda c: F.abs(c.cast("double")) < float("inf"))  # false for NaN, null for null
    rows = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    rows = written(rows.select("id", "label", F.transform("v", lambda c: F.floor(c).cast("long")).alias("x")), "rtree-rows")
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x")))
    return written(rows.withColumn("x", filled).distinct(), "rtree-distinct")


def first_copies(rows: DataFrame, keep: int) -> DataFrame:
    """Of equal vectors of a label, the rows with the `keep` smallest ids: no other can be among the first."""
    order = Window.partitionBy("label", "x").orderBy(F.col("id").asc_nulls_last())
    return written(rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep).drop("n"), "rtree-first")


def _matrix(cells, dims: int) -> np.ndarray:
    return np.array(list(cells), np.int64).reshape(len(cells), dims)


def _tiled(rows: DataFrame, dims: int, tile_rows: int, sample: int) -> DataFrame:
    """Rows with the number of their tile. Labels of half a tile and more have tiles of their own."""
    n = rows.count()
    tile_rows = max(tile_rows, math.ceil(n / MAX_TILES))
    large = {r["label"]: r["count"] for r in rows.groupBy("label").count().where(F.col("count") >= tile_rows // 2).collect()}
    seen = F.pmod(F.xxhash64("id", "x"), F.lit(1 << 20)) <= int((1 << 20) * min(1.0, sample / max(n, 1)))
    some = rows.where(seen).select("label", "x").limit(2 * sample).toArrow()
    x, label = _matrix(some["x"].to_pylist(), dims), some["label"].to_numpy()
    cuts, first = {}, 0
    for c in [*sorted(large), None]:
        mine = x[label == c] if c is not None else x[~np.isin(label, list(large))]
        size = large[c] if c is not None else n - sum(large.values())
        cuts[c] = Cuts(mine, math.ceil(size / tile_rows), first)
        first = cuts[c].next

    def assign(batches):
        for pdf in batches:
            x = _matrix(pdf["x"], dims)
            tile = np.empty(len(pdf), np.int32)
            group = np.array([c if c in large else FAR for c in pdf["label"]], np.int64)
            for c in np.unique(group):
                tile[group == c] = cuts[None if c == FAR else c].tile(x[group == c])
            yield pdf.assign(tile=tile, x=list(x))
    out = written(rows.mapInPandas(assign, "id long, label long, x array<long>, tile int"), "rtree-tiled")
    full = out.groupBy("tile").count().select("tile", F.ceil(F.col("count") / (4 * tile_rows)).cast("int").alias("parts"))
    return out.join(F.broadcast(full), "tile").withColumn("part", F.pmod(F.xxhash64("id", "x"), F.col("parts")).cast("int")).drop("parts")


_TREE = "tile int, part int, low binary, high binary, first long, last long, ids binary, nulls binary, labels binary, x binary"


def build(rows: DataFrame, tile_rows: int = TILE_ROWS, sample: int = SAMPLE, leaf: int = LEAF) -> tuple[DataFrame, int]:
    """(a row for each tile: its box, the span of its labels, and its rows in packed order; vectors' length)."""
    one = rows.select(F.size("x").alias("d")).first()
    dims = one["d"] if one else 0

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        x, labels = _matrix(pdf["x"], dims), pdf["label"].to_numpy(np.int64)
        null = pdf["id"].isna().to_numpy()
        ids = np.array([0 if gone else int(i) for i, gone in zip(pdf["id"], null)], np.int64)
        by_id = np.lexsort((ids, null))
        order = by_id[pack(x[by_id], labels[by_id], leaf)]
        x, labels = x[order], labels[order]
        return pd.DataFrame([(pdf["tile"].iloc[0], pdf["part"].iloc[0], x.min(axis=0).tobytes(), x.max(axis=0).tobytes(), labels.min(), labels.max(),
                              ids[order].tobytes(), null[order].tobytes(), labels.tobytes(), x.tobytes())], columns=[c.split()[0] for c in _TREE.split(", ")])
    # ids as text: pandas would turn a column with nulls into doubles
    tiled = _tiled(rows, dims, tile_rows, sample).withColumn("id", F.col("id").cast("string"))
    tiles = written(tiled.groupBy("tile", "part").applyInPandas(packed, _TREE), "rtree-tiles")
    return tiles, dims


_FOUND = "q long, w int, id long, score long"


def _search(asked: DataFrame, tiles: DataFrame, dims: int, same: bool, k: int, block: int, leaf: int) -> DataFrame:
    """(q, w, nth, id, score) of the first k rows in every window. `asked`: (q, id, label, x, low, high), q unique, low and high
    the ends of its windows."""
    boxes = tiles.select("tile", "part", "low", "high", "first", "last").toArrow()  # at most a few times MAX_TILES small rows
    name = np.stack([boxes["tile"].to_numpy(), boxes["part"].to_numpy()], axis=1) if len(boxes) else np.empty((0, 2), np.int32)
    lo, hi = (np.array([np.frombuffer(b, np.int64) for b in boxes[c].to_pylist()], np.int64).reshape(len(boxes), dims) for c in ("low", "high"))
    first, last = boxes["first"].to_numpy(), boxes["last"].to_numpy()
    width = max(1, math.ceil(asked.count() / block))
    columns = asked.columns

    def candidates(seed: bool):
        def run(batches):
            for pdf in batches:
                for a in range(0, len(pdf), 256):
                    part = pdf.iloc[a:a + 256]
                    low, high = bounds(_matrix(part["x"], dims), lo, hi)
                    label = part["label"].to_numpy()[:, None]
                    fits = (first <= label) & (last >= label) if same else ~((first == label) & (last == label))
                    may = np.zeros(fits.shape, bool)
                    for i, (ls, hs, fs) in enumerate(zip(part["low"], part["high"], part["floor"])):
                        for l, h, f in zip(ls, hs, fs):
                            may[i] |= fits[i] & (high[i] >= max(l, f)) & (low[i] <= h)
                    best = np.where(may, high, -np.inf).argmax(axis=1) if len(name) else np.zeros(len(part), int)
                    if seed:
                        at = np.flatnonzero(may.any(axis=1))
                        tile = best[at]
                    else:
                        done = part["seed"].to_numpy(int)
                        may[np.flatnonzero(done >= 0), done[done >= 0]] = False
                        at, tile = np.nonzero(may)
                    yield part.iloc[at][[*columns, "floor"]].assign(tile=name[tile, 0], part=name[tile, 1], seed=tile.astype(np.int32))
        return run
    types = dict(asked.dtypes)
    sent = ", ".join(f"{c} {types[c]}" for c in columns) + ", floor array<long>, tile int, part int, seed int"

    def looked(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            t = right.iloc[0]
            tree = RTree(np.frombuffer(t["x"], np.int64).reshape(-1, dims), np.frombuffer(t["labels"], np.int64), np.frombuffer(t["ids"], np.int64),
                         np.frombuffer(t["nulls"], bool), leaf)
            windows = [list(zip(map(int, ls), map(int, hs))) for ls, hs in zip(left["low"], left["high"])]
            found = tree.search(_matrix(left["x"], dims), left["id"].to_numpy(), left["label"].to_numpy(), windows,
                                [list(map(int, f)) for f in left["floor"]], same, k)
            out = [(q, w, None if gone else i, -s) for q, ws in zip(left["q"].tolist(), found) for w, rows in enumerate(ws) for s, gone, i in rows]
        return pd.DataFrame({c: pd.Series([r[i] for r in out], dtype="Int64") for i, c in enumerate(("q", "w", "id", "score"))})

    def look(some: DataFrame) -> DataFrame:
        some = some.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(width)).cast("int"))
        where = some.select("tile", "part", "block").distinct().join(tiles.drop("low", "high", "first", "last"), ["tile", "part"])
        keys = ["tile", "part", "block"]
        where = where.withColumnsRenamed({c: f"of_{c}" for c in keys})
        return some.groupBy(*keys).cogroup(where.groupBy(*[f"of_{c}" for c in keys])).applyInPandas(looked, _FOUND)

    def firsts(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("q", "w").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
        return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
    none = F.transform("low", lambda _: F.lit(-FAR).cast("long"))
    seeds = written(asked.withColumn("floor", none).withColumn("seed", F.lit(-1)).mapInPandas(candidates(True), sent), "rtree-seeds")
    seen = written(look(seeds), "rtree-seen")
    # what the seeds' tiles gave: a window with k rows has a floor
    kth = (seen.groupBy("q", "w").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= k)
           .groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("w", "s"))).alias("floors")))
    known = asked.join(seeds.select("q", "seed"), "q", "left").join(kth, "q", "left")
    floor = F.transform("low", lambda _, i: F.coalesce(F.try_element_at("floors", i), F.lit(-FAR).cast("long")))
    rest = known.select(*columns, floor.alias("floor"), F.coalesce("seed", F.lit(-1)).alias("seed")).mapInPandas(candidates(False), sent)
    return firsts(seen.unionByName(look(written(rest, "rtree-rest"))))


def mine(df: DataFrame, vector: Column, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", positives: int = 5,
         negatives: int = 3, low: int = 50, high: int = 95, tile_rows: int = TILE_ROWS, sample: int = SAMPLE, block: int = BLOCK,
         leaf: int = LEAF) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    The `positives` best other rows of an anchor's label, and for each the `negatives` best rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. `vector`: a column of `df`; `is_anchor`: a
    condition on `id`."""
    rows = prepared(df, vector, id_col, label_col)
    tiles, dims = build(first_copies(rows, max(positives, negatives) + 1), tile_rows, sample, leaf)
    whole = F.array(F.lit(-FAR).cast("long")), F.array(F.lit(FAR).cast("long"))
    anchors = written(rows.where(F.col("id").isNotNull() & is_anchor).select(
        F.monotonically_increasing_id().alias("q"), "id", "label", "x", whole[0].alias("low"), whole[1].alias("high")), "rtree-anchors")
    good = written(_search(anchors, tiles, dims, True, positives, block, leaf).select(
        "q", F.col("nth").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "rtree-positives")
    # the windows of an anchor, in the order of its positives (at most `positives` of them)
    ends = good.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("p", "positive_score"))).alias("ps"))
    share = lambda c, percent: c["positive_score"].cast("decimal(20,0)") * percent / F.lit(100).cast("decimal(3,0)")
    lows = F.transform("ps", lambda c: F.ceil(share(c, low)).cast("long"))
    highs = F.transform("ps", lambda c: F.floor(share(c, high)).cast("long"))
    asked = written(anchors.drop("low", "high").join(ends, "q").select("q", "id", "label", "x", lows.alias("low"), highs.alias("high")), "rtree-windows")
    bad = _search(asked, tiles, dims, False, negatives, block, leaf).select(
        "q", (F.col("w") + 1).alias("p"), F.col("nth").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return (good.join(bad, ["q", "p"]).join(anchors.select("q", F.col("id").alias("anchor_id")), "q")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
