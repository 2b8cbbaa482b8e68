"""Network settings are honoured or refused; the k-NN join leaves out what it can."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators import models, network, neighbors
from foldwise.operators.neighbors import knn_join


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(5, 3)), np.eye(4)[rng.integers(0, 4, 5)]
    for act in ("tanh", "sigmoid", "linear", "relu"):
        for loss, last in (("categorical_crossentropy", "softmax"), ("mean_squared_error", "linear")):
            shape = network.network_shape(3, [["6", act], ["5", act], ["4", last]], ["0", "0", "0"], 4)
            w = network.initial_weights(3, shape, 1)
            g = network.gradient(x, y, w, shape, loss)

            def total(ws):
                out = network.forward(x, ws, shape)[-1][2]
                return -(y * np.log(out)).sum() if loss == "categorical_crossentropy" else ((out - y) ** 2).sum() / 4
            for layer in range(len(w)):
                for at in [(0, 0), (1, 2), (-1, 1)]:
                    eps = 1e-6
                    up = [v.copy() for v in w]
                    down = [v.copy() for v in w]
                    up[layer][at] += eps
                    down[layer][at] -= eps
                    assert g[layer][at] == pytest.approx((total(up) - total(down)) / (2 * eps), rel=1e-4, abs=1e-6)


@pytest.mark.parametrize("bad", [dict(layers=[["4", "swish"], ["3", "softmax"]]), dict(opt="lion"), dict(loss="hinge"),
                                 dict(dropouts=["0", "1.5"]), dict(layers=[["4", "softmax"], ["3", "softmax"]])])
def test_unknown_settings_are_refused(spark, bad):
    df = spark.createDataFrame([(1, 0.0, 0), (2, 1.0, 1)], "row_id long, a double, DX int")
    args = dict(layers=[["4", "tanh"], ["3", "softmax"]], dropouts=["0", "0"], epochs=1) | bad
    with pytest.raises(ValueError):
        models.mlp_classifier(df, df, ["a"], 3, **args)


@pytest.mark.parametrize("opt,act", [("adam", "tanh"), ("sgd", "relu"), ("adagrad", "sigmoid")])
def test_settings_learn_separable_classes(spark, opt, act):
    df = spark.range(120).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("DX"),
                                 (F.cos(F.col("id") % 3 * 2.1) * 3 + F.randn(1) * 0.2).alias("a"),
                                 (F.sin(F.col("id") % 3 * 2.1) * 3 + F.randn(2) * 0.2).alias("b")).persist()
    out = models.mlp_classifier(df, df, ["a", "b"], 3, [["8", act], ["3", "softmax"]], ["0", "0.05"], epochs=25, batch_size=16,
                                opt=opt, rate=0.05 if opt == "adam" else 0.3)
    hit = out.where("p = 1").join(df, "row_id").agg(F.avg((F.col("class") == F.col("DX")).cast("int"))).first()[0]
    assert hit > 0.9


@pytest.fixture(scope="module")
def clusters(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(scale=50, size=(12, 5))
    x = np.vstack([c + rng.normal(size=(40, 5)) for c in centres])
    x[10:14] = x[9]  # ties
    rows = [(int(i) * 3, *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "row_id long, " + ", ".join(f"f{i} double" for i in range(5))), x


def test_pruned_join_within_groups_is_exact(clusters, monkeypatch):
    monkeypatch.setattr(neighbors, "TASK_PAIRS", 0)
    df, x = clusters
    feats = [f"f{i}" for i in range(5)]
    df2 = df.withColumn("g", F.when(F.col("row_id") % 7 != 0, (F.col("row_id") / 3).cast("int") % 4))
    group = [None if i * 3 % 7 == 0 else i % 4 for i in range(len(x))]
    got = {}
    for r in knn_join(df2, df2, feats, 3, by=["g"], exclude_self=True, block_rows=60).collect():
        got.setdefault(r["left_id"], []).append((r["rank"], r["right_id"]))
    d = neighbors._distances(x, x, "euclidean")
    for i in range(len(x)):
        want = sorted((d[i, j], j * 3) for j in range(len(x)) if j != i and group[i] is not None and group[j] == group[i])[:3]
        assert sorted(got.get(i * 3, [])) == [(n + 1, j) for n, (_, j) in enumerate(want)]


@pytest.mark.parametrize("pairs", [0, 5_000_000])
@pytest.mark.parametrize("metric", neighbors.METRICS)
def test_pruned_join_is_exact(clusters, metric, pairs, monkeypatch):
    monkeypatch.setattr(neighbors, "TASK_PAIRS", pairs)  # 0: cut whatever the size
    df, x = clusters
    feats = [f"f{i}" for i in range(5)]
    got = {}
    for r in knn_join(df, df, feats, 4, exclude_self=True, metric=metric, block_rows=50).collect():
        got.setdefault(r["left_id"], []).append((r["rank"], r["right_id"], r["dist"]))
    d = neighbors._distances(x, x, metric)
    np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        want = sorted((d[i, j], j * 3) for j in range(len(x)) if j != i)[:4]
        assert [(r, j) for r, j, _ in sorted(got[i * 3])] == [(n + 1, j) for n, (_, j) in enumerate(want)]
        assert [v for _, _, v in sorted(got[i * 3])] == pytest.approx([v for v, _ in want])


def test_rows_out_of_reach_are_left_out(clusters):
    df, x = clusters
    v = neighbors._vectors(df, "row_id", [f"f{i}" for i in range(5)], F.lit("").alias("__grp"))
    left, right = neighbors._cells(v, v, 5, "euclidean", len(x))
    n, m = ({r["cell"]: r["count"] for r in t.groupBy("cell").count().collect()} for t in (left, right))
    assert sum(n.values()) == len(x)
    compared = sum(n[c] * m.get(c, 0) for c in n)
    assert compared < 0.4 * len(x) ** 2


def test_blocks_follow_parallelism(clusters):
    df, x = clusters
    v = neighbors._vectors(df, "row_id", ["f0"], F.lit("").alias("__grp"), F.lit(1).alias("cell"))
    left, right = neighbors._in_blocks(v, v, ["cell"], 20_000)
    assert left.select("__lb", "__rb").distinct().count() > 1
    pairs = left.join(right.select("cell", "__lb", "__rb", F.col("__id").alias("r")), ["cell", "__lb", "__rb"])
    assert pairs.count() == len(x) ** 2 == pairs.select("__id", "r").distinct().count()


def test_unknown_metric_is_refused(clusters):
    with pytest.raises(ValueError):
        knn_join(clusters[0], clusters[0], ["f0"], 1, metric="cosine")


def test_a_right_row_is_sent_once_a_block(spark, monkeypatch):
    """Where boxes leave out nothing, rows are not repeated for every cell; the join stays exact."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 24))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, " + ", ".join(f"f{i} double" for i in range(24)))
    feats = [f"f{i}" for i in range(24)]
    v = neighbors._vectors(df, "row_id", feats, F.lit("").alias("__grp"))
    left, right = neighbors._cells(v, v, 4, "euclidean", len(x))
    assert left.count() == right.count() == len(x)
    monkeypatch.setattr(neighbors, "TASK_PAIRS", 0)
    d = neighbors._distances(x, x, "euclidean")
    np.fill_diagonal(d, np.inf)
    got = {}
    for r in knn_join(df, df, feats, 3, exclude_self=True).collect():
        got.setdefault(r["left_id"], []).append((r["rank"], r["right_id"]))
    assert all(sorted(got[i]) == [(n + 1, int(j)) for n, j in enumerate(np.argsort(d[i])[:3])] for i in range(len(x)))


def test_many_equal_rows_are_not_all_compared(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "TASK_PAIRS", 0)
    rows = [(i, float(i % 3), float(i % 2)) for i in range(1200)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double")
    sent, cells = [], neighbors._cells
    monkeypatch.setattr(neighbors, "_cells", lambda left, right, *a: sent.append(right.count()) or cells(left, right, *a))
    got = {}
    for r in knn_join(df, df, ["a", "b"], 3, exclude_self=True).collect():
        got.setdefault(r["left_id"], []).append((r["rank"], r["right_id"], r["dist"]))
    assert sent[0] <= 6 * 4  # six different rows, k and the row itself of each
    for i in (0, 7, 601, 1199):
        want = [j for j in range(i % 6, 1200, 6) if j != i][:3]
        assert sorted(got[i]) == [(n + 1, j, 0.0) for n, j in enumerate(want)]
