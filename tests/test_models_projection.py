"""Properties of the iterative / projection operators (no SQL statement exists for them)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators import models, projection
from foldwise.plans.experiment import check_config, cross_validate


def planted(spark, n=120, seed=0, classes=2):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        c = i % classes
        rows.append((i, c, float(c * 3 + rng.normal() * 0.3), float(rng.normal()), float(rng.normal())))
    return spark.createDataFrame(rows, "row_id long, DX int, good double, n1 double, n2 double")


FEATS = ["good", "n1", "n2"]


def test_rf_importance_planted_first(spark):
    imp = {r["feature"]: r["score"] for r in models.rf_importance(planted(spark), FEATS, num_trees=10).collect()}
    assert max(imp, key=imp.get) == "good"
    assert sum(imp.values()) == pytest.approx(1.0)


def test_pca_ratios_and_uncorrelated_axes(spark):
    out, ratios = projection.pca_project(planted(spark), FEATS, 2)
    assert all(a >= b - 1e-12 for a, b in zip(ratios, ratios[1:]))
    assert 0 < sum(ratios) <= 1 + 1e-9
    assert abs(out.stat.corr("pc0", "pc1")) < 1e-6


def test_lda_caps_components_and_separates(spark):
    out, ratios = projection.lda_project(planted(spark), FEATS, 5)
    assert [c for c in out.columns if c.startswith("ld")] == ["ld0"]  # classes - 1 = 1
    m = {r["DX"]: r["m"] for r in out.groupBy("DX").agg(F.avg("ld0").alias("m")).collect()}
    sd = out.agg(F.stddev("ld0")).collect()[0][0]
    assert abs(m[0] - m[1]) > sd


def test_gmm_single_gaussian_closed_form(spark):
    df = planted(spark)
    res = {r["k"]: r for r in projection.gmm_components(df, ["n1", "n2"], max_k=2, ridge=0.0).collect()}
    X = np.array([[r["n1"], r["n2"]] for r in df.collect()])
    mu, cov = X.mean(axis=0), np.cov(X.T, bias=True)
    inv, (_, logdet) = np.linalg.inv(cov), np.linalg.slogdet(cov)
    ll = sum(-0.5 * (2 * math.log(2 * math.pi) + logdet + (x - mu) @ inv @ (x - mu)) for x in X)
    assert res[1]["log_likelihood"] == pytest.approx(ll, rel=1e-9)
    for k, r in res.items():
        p = (k - 1) + k * 2 + k * 3
        assert r["aic"] == pytest.approx(2 * p - 2 * r["log_likelihood"])
    assert sum(r["chosen"] for r in res.values()) == 1


def _acc(scores, df):
    best = scores.groupBy("row_id").agg(F.max_by("class", "p").alias("c")).join(df, "row_id")
    return best.where("c = DX").count() / best.count()


def test_iterative_slots_beat_majority(spark):
    df = planted(spark, n=90)
    train, test = df.where("row_id % 3 != 0"), df.where("row_id % 3 = 0")
    assert _acc(models.boosted_trees(train, test, FEATS, rounds=5), test) > 0.8
    assert _acc(models.mlp_classifier(train, test, FEATS, 2, layers=[["8", "tanh"], ["2", "softmax"]],
                                      dropouts=["0", "0"], epochs=50), test) > 0.8
    assert _acc(models.rbf_svc(train, test, FEATS, C=10.0), test) > 0.8


def test_mlp_layer_quirk():
    layers = [["64", "tanh"], ["64", "tanh"], ["5", "softmax"]]
    assert models.mlp_layers(10, layers, ["0", "0", "0"], 5) == [10, 64, 64, 64, 5]
    assert models.mlp_layers(10, layers, ["0", "0"], 5) == [10, 64, 64, 5]


def test_ragged_config():
    cfg = {"data_list": ["a", "b", "c"], "feature_selection": ["ig", "ig", "ig"], "classifiers": ["nb_1", "nb_2", "nb_3"],
           "n_components": ["2", "3"]}
    with pytest.raises(ValueError):
        check_config("x", cfg)
    with pytest.warns(UserWarning):
        assert len(check_config("x", cfg, strict=False)) == 2
    with pytest.raises(ValueError):
        check_config("x", {**cfg, "feature_selection": "rf"})


def test_cross_validate_end_to_end(spark):
    df = planted(spark, n=60, classes=3)
    cfg = {"classifiers": ["knn_1", "nb_1"], "folds": "3"}
    preds, m = cross_validate(cfg, [(df.select("row_id", "good", "DX"), ["good"]),
                                    (df.select("row_id", "n1", "n2", "DX"), ["n1", "n2"])], seed=1)
    assert preds.count() == preds.select("row_id").distinct().count() == 60  # classes already balanced
    got = {(r["fold"], r["metric"]): r["value"] for r in m.where("class = -1").collect()}
    for f in range(3):
        acc = got[(f, "accuracy")]
        assert got[(f, "auc")] == pytest.approx((1 + acc - (1 - acc) / 2) / 2)


def test_lda_with_tasks_that_have_no_rows(spark):
    rows = [tuple(r) for r in planted(spark, 30).collect()]
    many = spark.createDataFrame(spark.sparkContext.parallelize(rows, 45), "row_id long, DX int, good double, n1 double, n2 double")
    one = projection.lda_project(spark.createDataFrame(rows, many.schema).coalesce(1), FEATS, 1)[0].orderBy("row_id").collect()
    spread = projection.lda_project(many, FEATS, 1)[0].orderBy("row_id").collect()
    assert np.allclose(np.abs([r["ld0"] for r in one]), np.abs([r["ld0"] for r in spread]))
