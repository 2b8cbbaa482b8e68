"""kNN join against brute force; SMOTE and ReliefF properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators import models, sampling
from foldwise.operators.neighbors import knn_join
from foldwise.operators.relief import relieff


def points(spark, n=60, d=3, seed=0, classes=3):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, d))
    rows = [(i, int(i % classes), *map(float, X[i])) for i in range(n)]
    cols = "row_id long, DX int, " + ", ".join(f"f{j} double" for j in range(d))
    return spark.createDataFrame(rows, cols), X


def test_knn_join_matches_brute_force_with_blocks(spark):
    df, X = points(spark)
    feats = ["f0", "f1", "f2"]
    got = knn_join(df, df, feats, 4, exclude_self=True, block_rows=7).collect()
    res = {}
    for r in got:
        res.setdefault(r["left_id"], []).append((r["rank"], r["right_id"]))
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(axis=2))
    for i in range(len(X)):
        order = [j for j in np.lexsort((np.arange(len(X)), D[i])) if j != i][:4]
        assert [rid for _, rid in sorted(res[i])] == order


def test_knn_join_by_class(spark):
    df, X = points(spark, n=40)
    got = knn_join(df, df, ["f0", "f1", "f2"], 2, by=["DX"], exclude_self=True, block_rows=5).collect()
    assert all(r["left_id"] % 3 == r["right_id"] % 3 for r in got)
    assert len(got) == 80


def test_smote_balances_and_interpolates(spark):
    rows = [(i, 0 if i < 30 else 1, float(i), float(i % 7)) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, DX int, a double, b double")
    out = sampling.smote(df, ["a", "b"], k=3, seed=2, block_rows=8)
    counts = {r["DX"]: r["count"] for r in out.groupBy("DX").count().collect()}
    assert counts == {0: 30, 1: 30}
    syn = out.where("synthetic = 1").collect()
    assert len(syn) == 20 and all(r["row_id"] < 0 for r in syn)
    # synthetic points of class 1 lie inside the class-1 bounding box
    assert all(30 <= r["a"] <= 39 for r in syn)


def test_gaussian_nb_separable(spark):
    rows = [(i, i % 2, float(i % 2) * 10 + (i % 5) * 0.1) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, DX int, x double")
    s = models.gaussian_nb(df, df, ["x"])
    best = s.groupBy("row_id").agg(F.max_by("class", "p").alias("c")).join(df, "row_id")
    assert best.where("c = DX").count() == 40


def test_relieff_ranks_planted_feature_first(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 2, float(i % 2) + rng.normal() * 0.05, float(rng.normal())) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, DX int, good double, noise double")
    w = {r["feature"]: r["score"] for r in relieff(df, ["good", "noise"], k=5, block_rows=16).collect()}
    assert w["good"] > w["noise"]


def test_relieff_anchor_subset_still_ranks_planted_first(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, float(i % 2) + rng.normal() * 0.05, float(rng.normal())) for i in range(80)]
    df = spark.createDataFrame(rows, "row_id long, DX int, good double, noise double")
    w = {r["feature"]: r["score"] for r in relieff(df, ["good", "noise"], k=5, anchors=30, block_rows=16).collect()}
    assert w["good"] > w["noise"]


def test_nearest_of_every_kind_with_discrete_features(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F

    from foldwise.operators import neighbors
    rng = np.random.default_rng(5)
    x = np.stack([rng.normal(size=90), rng.integers(0, 3, 90), rng.normal(size=90)], axis=1)
    kind = [None if i % 17 == 0 else "abc"[i % 3] for i in range(90)]
    df = spark.createDataFrame([(i, k, *map(float, v)) for i, (k, v) in enumerate(zip(kind, x))], "row_id long, kind string, p double, q double, r double")
    d = np.abs(x[:, None] - x[None])
    d[..., 1] = d[..., 1] > 0
    d = d.sum(axis=2)
    for pairs in (0, 5_000_000):  # with and without cells
        monkeypatch.setattr(neighbors, "TASK_PAIRS", pairs)
        got = {}
        for r in neighbors.knn_join(df, df, ["p", "q", "r"], 4, exclude_self=True, metric="manhattan", block_rows=30, per="kind", discrete=[1]).collect():
            got.setdefault((r["left_id"], r["grp"]), []).append((r["rank"], r["right_id"]))
        assert len(got) == 90 * 3
        for (i, k), rows in got.items():
            want = sorted((d[i, j], j) for j in range(90) if j != i and kind[j] == k)[:4]
            assert sorted(rows) == [(n + 1, j) for n, (_, j) in enumerate(want)]


def test_distances_in_bounded_memory():
    import tracemalloc

    import numpy as np

    from foldwise.operators import neighbors
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(20_000, 64)), rng.normal(size=(256, 64))
    tracemalloc.start()
    d = neighbors._distances(a, b, "euclidean")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert d.shape == (20_000, 256) and peak < 300e6
    i, j, near = neighbors._near_pairs(a[:50], b, 5, "euclidean", None)
    assert all(set(np.argsort(d[r])[:5]) <= set(j[i == r]) for r in range(50)) and np.array_equal(near, d[i, j])
