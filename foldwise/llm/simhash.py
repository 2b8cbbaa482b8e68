"""SimHash near-duplicates with BK-trees (operator 10).

A fingerprint holds, per bit, the majority of the 64-bit hashes of a text's word shingles.
Fingerprints at most `radius` bits apart are linked; a document's component is the smallest
doc_id that it reaches. Distinct fingerprints are sharded so that linked ones meet: their 64
bits are cut into radius + 1 bands, and two fingerprints within the radius agree in at least
one. Each shard (band, value) is searched with a BK-tree, whose children are keyed by their
integer Hamming distance to the parent, so that only edges within the radius are followed. A
shard of more than SHARD_ROWS fingerprints is dealt out as several trees, each of which meets
every block of the shard, so no task holds an unbounded shard. A shard passes on a spanning
forest of its links, never all pairs.

Defined results: a null or empty text has fingerprint zero, which links like any other; one
or two words make one shingle; a null doc_id is grouped but never names a component unless
it is alone (then null); repeated rows give repeated results; other columns are not read; an
empty table gives an empty result; texts of any length count whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, shuffle_width, texts_of, written

#: Fingerprints of one tree.
SHARD_ROWS = 20_000
SEED = 42


def shingle_hashes(text: str, size: int) -> np.ndarray:
    from xxhash import xxh64_intdigest
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    k = min(size, len(words))
    pairs = zip(begins[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in pairs], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as a signed 64-bit integer."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(df: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in chunks(batches):
            fps = [fingerprint(shingle_hashes(t, shingle)) for t in texts]
            yield pa.RecordBatch.from_arrays([keys, pa.array(fps, pa.int64())], names=["doc_id", "fp"])
    return texts_of(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Distinct 64-bit fingerprints; children are keyed by their distance to the parent."""

    def __init__(self, fps: list[int]):
        self.fps = fps
        self.children: list[dict[int, int]] = [{} for _ in fps]
        for i in range(1, len(fps)):
            at, x = 0, fps[i]
            while True:
                d = (x ^ fps[at]).bit_count()
                nxt = self.children[at].get(d)
                if nxt is None:
                    self.children[at][d] = i
                    break
                at = nxt

    def within(self, x: int, radius: int) -> list[int]:
        """Indexes of all members at most `radius` bits from x."""
        if not self.fps:
            return []
        found, stack = [], [0]
        while stack:
            at = stack.pop()
            d = (x ^ self.fps[at]).bit_count()
            if d <= radius:
                found.append(at)
            kids = self.children[at]
            if kids:
                if len(kids) > 2 * radius + 1:
                    stack.extend(kids[e] for e in range(d - radius, d + radius + 1) if e in kids)
                else:
                    stack.extend(i for e, i in kids.items() if d - radius <= e <= d + radius)
        return found


def _forest(fps: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between a tree's members and the queries."""
    if len(fps) == 2 and queries is fps:  # the commonest shard
        return [(fps[0], fps[1])] if (fps[0] ^ fps[1]).bit_count() <= radius else []
    tree, parent, out = BKTree(fps), {}, []

    def root(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x
    for x in queries:
        for i in tree.within(x, radius):
            a, b = root(x), root(fps[i])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((x, fps[i]))
    return out


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that span all components."""
    spark = fps.sparkSession
    cuts = [round(i * 64 / (radius + 1)) for i in range(radius + 2)]
    bands = F.array(*[F.struct(F.lit(i).alias("band"),
                               F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value"))
                      for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:]))])
    rows = fps.select("fp", F.inline(bands))
    sizes = rows.groupBy("band", "value").agg(F.count("*").alias("n"))
    # only large shards reach this side: at most rows / SHARD_ROWS of them
    large = written(sizes.where(F.col("n") > SHARD_ROWS)
                    .withColumn("parts", F.ceil(F.col("n") / F.lit(SHARD_ROWS)).cast("int")).drop("n"), "large-shards")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by shard; a shard is at most two blocks of about SHARD_ROWS."""
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            key = pdf[["band", "value", "tree", "block"]].to_numpy()
            new = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
            last = int(new[-1]) if len(new) else 0
            rest = pdf.iloc[last:]
            yield from _search(pdf.iloc[:last], new, radius)
        if rest is not None and len(rest):
            yield from _search(rest, np.zeros(0, np.int64), radius)

    def pairs(shards: DataFrame) -> DataFrame:
        keys = ["band", "value", "tree", "block"]
        return (shards.repartition(shuffle_width(spark), *keys).sortWithinPartitions(*keys, "fp")
                .mapInPandas(search, "a long, b long"))

    zero = F.lit(0).alias("tree"), F.lit(0).alias("block"), F.lit(True).alias("member")
    small = rows.join(large, ["band", "value"], "left_anti").select("band", "value", *zero, "fp")
    big = rows.join(large, ["band", "value"]).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    big = big.withColumn("other", other).select(  # this row as a member of its tree, and as a query of every other tree
        "band", "value", F.least("mine", "other").alias("tree"), F.greatest("mine", "other").alias("block"),
        (F.col("mine") <= F.col("other")).alias("member"), "fp")
    return pairs(small.unionByName(big)).distinct()


def _search(pdf: pd.DataFrame, borders: np.ndarray, radius: int) -> Iterator[pd.DataFrame]:
    if not len(pdf):
        return
    fps = pdf["fp"].to_numpy().view(np.uint64).tolist()
    member, same = pdf["member"].to_numpy(), (pdf["tree"] == pdf["block"]).to_numpy()
    edges = np.concatenate([[0], borders[borders < len(pdf)], [len(pdf)]])
    out = []
    for k in np.flatnonzero(np.diff(edges) > 1).tolist():
        lo, hi = int(edges[k]), int(edges[k + 1])
        shard = fps[lo:hi]
        if same[lo]:
            out += _forest(shard, shard, radius)
        else:
            m = member[lo:hi]
            out += _forest([x for x, y in zip(shard, m) if y], [x for x, y in zip(shard, m) if not y], radius)
    if out:
        yield pd.DataFrame(np.array(out, np.uint64).astype(np.int64), columns=["a", "b"])


def spread_minimum(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, component): smallest `least` over the nodes that each node reaches.

    Alternating star steps on the links alone: every round hangs neighbours on the smallest
    neighbour; rounds grow with the logarithm of a component's size. State is written to the
    shared folder each round. Nodes without links never take part.
    """
    spark = nodes.sparkSession
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(),
                "links")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low2, "u")
        nxt = (small.select("u", F.col("m").alias("v"))
               .unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
               .where("u <> v").distinct())
        nxt = written(nxt, "links")
        now = tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        e, state = nxt, now
    root = nodes.join(nxt.withColumnRenamed("u", "fp"), "fp", "left")
    root = root.withColumn("root", F.coalesce("v", "fp")).drop("v")
    least = root.groupBy("root").agg(F.min("least").alias("component"))
    return root.join(least, "root").select("fp", "component")


def near_duplicates(df: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    marks = written(fingerprints(df, shingle, id_col, text_col), "fingerprints")
    nodes = marks.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = spread_minimum(nodes, links(nodes.select("fp"), radius))
    return marks.join(found, "fp").select("doc_id", "fp", F.col("component").alias("component_id"))


def keep_first(df: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """The rows of one document of each group: the one whose doc_id names it (rows that share a
    doc_id are one document). Rows with a null doc_id stay only where no other row is near."""
    found = near_duplicates(df, shingle, radius, id_col, text_col)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__stay")).distinct()
    return df.join(stay, df[id_col].cast("long").eqNullSafe(stay["__stay"]), "left_semi")
