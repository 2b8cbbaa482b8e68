"""op12 (hard negatives): the SQL, brute force on awkward tables, tiles and cuts, the tree itself."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.llm import hard_negatives as hn
from foldwise.llm.oracle import oracle_sql
from foldwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
SCHEMA = "vec_id long, embedding array<double>, label int, x string, tile string, q string, id string"


def rows_of(df):
    return sorted(map(repr, (tuple(r[c] for c in COLUMNS) for r in df.collect())))


def brute_force(rows, every=50, positives=5, negatives=3):
    """Rows: (id, vector, label)."""
    whole = [(i, c, np.floor(v).astype(int)) for i, v, c in rows
             if c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dims = max((len(v) for _, _, v in whole), default=0)
    whole = sorted({(i, c, *v.tolist(), *[0] * (dims - len(v))) for i, c, v in whole}, key=repr)
    out = []
    for i, c, *v in whole:
        if i is None or i % every:
            continue
        scored = sorted((-int(np.dot(v, w)), j is None, j or 0, d) for j, d, *w in whole if j != i)
        for p, gone, pid, _ in [s for s in scored if s[3] == c][:positives]:
            near = [s for s in scored if s[3] != c and 50 * -p <= 100 * -s[0] <= 95 * -p][:negatives]
            out += [(i, None if gone else pid, n + 1, None if g else j, -p, -s) for n, (s, g, j, _) in enumerate(near)]
    return sorted(map(repr, out))


def mined(df, **kw):
    return rows_of(hn.mine(df, F.col("embedding"), F.col("id") % 50 == 0, **kw))


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({oracle_sql()['op12_hard_negatives']})").fetchall()
    assert rows_of(QUERIES["op12_hard_negatives"](spark, SF)) == sorted(map(repr, want))


def test_awkward_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in rng.integers(-9, 10, 3)], int(rng.integers(0, 3))) for i in range(130)]
    hot = [5.0, 5.0, 1.0]
    rows += [(1000 + i, hot, i % 2) for i in range(60)]  # one common vector, ties by id
    rows += [(100, hot, 0), (100, hot, 0), (100, hot, 1), (150, hot, 2)]  # repeated rows, one id with several labels
    rows += [(None, hot, 0), (None, None, None), (50, None, 1), (200, [1.0, None, 2.0], 1), (250, [float("nan"), 1.0, 1.0], 0),
             (300, [float("inf"), 1.0, 1.0], 0), (350, hot, None), (400, [4.0, 4.0], 1), (450, [], 2), (500, [0.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], SCHEMA).repartition(5)
    want = brute_force(rows)
    assert len(want) > 20
    assert mined(df) == want
    assert mined(df, tile_rows=10, sample=40, block=2, leaf=4) == want  # many tiles, blocks and leaves
    assert mined(df.limit(0)) == []
    assert mined(df.where("vec_id % 50 != 0")) == []


def test_scores_beyond_doubles(spark):
    big = 2 ** 29 + 1
    rows = [(50 * i, [float(big + i), float(big - 7 * i), float(i)], i % 2) for i in range(9)]
    assert mined(spark.createDataFrame([(*r, "", "", "", "") for r in rows], SCHEMA)) == brute_force(rows)


@pytest.mark.parametrize("seed", range(4))
def test_tree_prunes_and_is_exact(seed):
    rng = np.random.default_rng(seed)
    n, dims, k = 1500, 4, 3
    x = rng.integers(-200, 200, (n, dims))
    labels = rng.integers(0, 3, n)
    order = hn.pack(x, labels, 16)
    assert sorted(order.tolist()) == list(range(n))
    tree = hn.RTree(x[order], labels[order], order, np.zeros(n, bool), 16, 4)
    lo, hi = hn.bounds(x[:7], *tree.levels[0][:2])
    for b in range(len(tree.levels[0][0])):  # boxes bound what is in them
        s = x[:7] @ x[order][b * 16:(b + 1) * 16].T
        assert (s >= lo[:, b:b + 1]).all() and (s <= hi[:, b:b + 1]).all()
    windows = [[(-hn.FAR, hn.FAR), (100, 20_000), (-5000, -4000)]] * 20
    got = tree.search(x[:20], np.arange(20), labels[:20], windows, [[-hn.FAR] * 3] * 20, False, k)
    for i in range(20):
        s = x @ x[i]
        for (a, b), rows in zip(windows[0], got[i]):
            at = [j for j in range(n) if labels[j] != labels[i] and a <= s[j] <= b]
            assert [(-r[0], r[2]) for r in rows] == sorted(((int(s[j]), j) for j in at), key=lambda p: (-p[0], p[1]))[:k]


def test_cuts_cover_every_row():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 5))
    cuts = hn.Cuts(x[:300], 12, 7)
    tile = cuts.tile(x)
    assert tile.min() >= 7 and tile.max() < cuts.next and np.bincount(tile - 7).max() < 4000 / 4
    assert set(hn.Cuts(x[:0], 12, 0).tile(x)) == {0}
