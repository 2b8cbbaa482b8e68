"""Forest draws by whole levels, rows of a node in one piece; distances first in single precision."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators import forest, neighbors, selectors


def test_md5_of_many_messages():
    rng = np.random.default_rng(0)
    for size in (1, 54, 55, 56, 64, 119, 120):
        messages = rng.integers(32, 127, (5, size)).astype(np.uint8)
        plain = [np.frombuffer(hashlib.md5(m.tobytes()).digest()[:8], ">u4") for m in messages]
        assert forest.md5_heads(messages).tolist() == np.array(plain).tolist()
    names = ["1" + "".join(rng.choice(["0", "1"], 48)) for _ in range(60)]
    order, place = forest._level_draws(3, 11, names, 12)
    for i, name in enumerate(names):
        one = forest.draws(3, 11, name, 12)
        assert order[i].tolist() == one[0].tolist() and place[i].tolist() == one[1].tolist()


def test_nodes_of_few_features_are_grown_in_one_task(spark):
    """60 000 rows of two features are fewer numbers than 50 000 of 64: no job for each level."""
    df = spark.range(60_000).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), (F.col("id") % 2).cast("int").alias("DX"))
    jobs = []
    collect = type(df).collect
    try:
        type(df).collect = lambda self: jobs.append(1) or collect(self)
        splits = forest.extra_trees(df, ["a", "b"], num_trees=2, max_depth=2)
    finally:
        type(df).collect = collect
    assert len(jobs) == 1  # the classes
    by_level = forest.extra_trees(df, ["a", "b"], num_trees=2, max_depth=2, local_rows=20_000)
    assert sorted(splits.collect()) == sorted(by_level.collect())


@pytest.mark.parametrize("metric", ["manhattan", "mixed:1,3"])
@pytest.mark.parametrize("shift, factor", [(0.0, 1.0), (1e6, 1.0), (0.0, 1e35)])
def test_first_look_in_single_precision_loses_no_neighbour(metric, shift, factor):
    rng = np.random.default_rng(4)
    a, b = rng.random((40, 6)), rng.random((900, 6))
    b[:300] = np.round(b[:300], 1)  # ties
    a[:, 1], b[:, 1] = np.round(3 * a[:, 1]), np.round(3 * b[:, 1])
    b[600:, 3] = b[0, 3] + 1e-12 * np.arange(300)  # differ in double precision alone
    a, b = a * factor + shift, b * factor + shift
    whole = neighbors._summed(a, b, metric)
    single = neighbors._single(a, b, metric)
    assert (single is None) == (factor > 1)
    if single is not None:
        assert single[0].dtype == np.float32 and (np.abs(single[0] - whole) <= single[1][:, None]).all()
    i, j, d = neighbors._near_pairs(a, b, 5, metric, None)
    for row in range(len(a)):
        mine = sorted(zip(d[i == row].tolist(), j[i == row].tolist()))[:5]
        plain = neighbors._paired(a[row][None, :], b, metric)
        assert [q for q, _ in mine] == sorted(plain.tolist())[:5]


def test_own_keys_do_not_count_whatever_their_order():
    rng = np.random.default_rng(5)
    lid, rid = np.array([9, 2, 2, 7, 100]), np.array([2, 9, 2, 5, 7, 9, 1])
    a, b = rng.random((5, 3)), rng.random((7, 3))
    found = [(lid[p], rid[q]) for i, j, _ in neighbors._best(lid, a, rid, b, 7, True, "manhattan") for p, q in zip(i, j)]
    assert len(found) == sum((rid != k).sum() for k in lid) and all(p != q for p, q in found)


def test_rankings_of_a_store_run_together(spark, monkeypatch):
    import threading
    seen, gate = [], threading.Barrier(2, timeout=60)

    def waits(df, features, *_, **__):
        gate.wait()  # two views' rankings meet here
        seen.append(len(features))
        return df.sparkSession.createDataFrame([(f, i, float(i)) for i, f in enumerate(features)], "feature string, position int, score double")
    monkeypatch.setattr("foldwise.operators.relief.relieff", waits)
    df = spark.createDataFrame([(1, 1.0, 2.0, 0), (2, 2.0, 1.0, 1)], "row_id long, a double, b double, DX int")
    store = selectors.score_store(df, {"x": ["a", "b"], "y": ["b"]}, ("relieff",))
    assert [(r["dataset"], r["feature"], r["rank"]) for r in store.orderBy("dataset", "rank").collect()] == [("x", "b", 1), ("x", "a", 2), ("y", "b", 1)]
    assert sorted(seen) == [1, 2]
