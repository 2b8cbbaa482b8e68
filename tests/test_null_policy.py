"""Rows in = rows out, or an error: NULL labels and features, degenerate classes, slot order."""

import math
import warnings
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foldwise.operators import metrics, models, projection, sampling, selectors
from foldwise.operators.ensemble import soft_vote
from foldwise.operators.neighbors import knn_join
from foldwise.operators.nulls import complete_features
from foldwise.plans.experiment import cross_validate, same_rows


@pytest.fixture(scope="module")
def rows(spark):
    """60 rows, 3 classes; feature b is NULL in 12 of them."""
    data = [(i, float(i % 7) + (i % 3) * 4, None if i % 5 == 0 else float(i % 11) - (i % 3) * 3, i % 3) for i in range(60)]
    return spark.createDataFrame(data, "row_id long, a double, b double, DX int")


def test_folds_keep_rows_without_a_label(spark, rows):
    df = rows.withColumn("DX", F.when(F.col("row_id") % 4 != 0, F.col("DX")))
    out = sampling.stratified_folds(df, 3, 1).collect()
    assert len(out) == 60
    by = Counter((r["DX"], r["fold"]) for r in out)
    for c in (None, 0, 1, 2):
        sizes = [by[(c, f)] for f in range(3)]
        assert max(sizes) - min(sizes) <= 1


def test_incomplete_rows_are_an_error_or_dropped_on_request(rows):
    with pytest.raises(Exception, match="NULL feature"):
        complete_features(rows, ["a", "b"], "test").collect()
    assert complete_features(rows, ["a", "b"], "test", "drop").count() == 48
    assert complete_features(rows, ["a"], "test").select("a").count() == 60
    with pytest.raises(ValueError):
        complete_features(rows, ["a"], "test", "skip")


@pytest.mark.parametrize("run", [
    lambda d: knn_join(d, d, ["a", "b"], 2, exclude_self=True),
    lambda d: models.knn_scores(d, d, ["a", "b"]),
    lambda d: models.gaussian_nb(d, d, ["a", "b"]),
    lambda d: models.boosted_trees(d, d, ["a", "b"], rounds=2),
    lambda d: models.rbf_svc(d, d, ["a", "b"]),
    lambda d: models.rf_importance(d, ["a", "b"]),
    lambda d: models.mlp_classifier(d, d, ["a", "b"], 3, [["4", "tanh"], ["3", "softmax"]], ["0", "0"], epochs=1),
    lambda d: sampling.smote(d, ["a", "b"]),
])
def test_no_operator_loses_incomplete_rows_silently(rows, run):
    with pytest.raises(Exception, match="NULL feature"):
        run(rows.withColumn("DX", F.when(F.col("row_id") < 40, F.lit(0)).otherwise(1))).collect()


def test_every_feature_is_scored_and_perfect_ones_come_first(spark):
    df = spark.createDataFrame([(i, float(i % 2), None, float(i % 5), 1.0, i % 2) for i in range(40)],
                               "row_id long, exact double, nothing double, noise double, flat double, DX int")
    feats = ["nothing", "noise", "flat", "exact"]
    for scores in (selectors.info_gain(df, feats), selectors.anova_f(df, feats)):
        ranked = {r["feature"]: (r["rank"], r["score"]) for r in selectors.rank_scores(scores).collect()}
        assert set(ranked) == set(feats) and ranked["exact"][0] == 1 and ranked["nothing"][1] is None
    f = {r["feature"]: r["score"] for r in selectors.anova_f(df, feats).collect()}
    assert f["exact"] == math.inf and f["flat"] is None
    picks = selectors.mrmr_miq(df, feats, 4).collect()
    assert [p["feature"] for p in picks][0] == "exact" and picks[-1]["feature"] == "nothing" and picks[-1]["score"] is None


def test_smote_refuses_classes_without_neighbours(spark):
    data = [(i, float(i), float(i * i), 0 if i < 8 else 1 if i < 11 else 2) for i in range(12)]
    df = spark.createDataFrame(data, "row_id long, a double, b double, DX int")
    with pytest.raises(ValueError, match=r"1 \(3\).*2 \(1\)|2 \(1\).*1 \(3\)"):
        sampling.smote(df, ["a", "b"])
    out = sampling.smote(df, ["a", "b"], small_classes="adapt")
    assert Counter(r["DX"] for r in out.collect()) == {0: 8, 1: 8, 2: 8}
    assert {(r["a"], r["b"]) for r in out.where("DX = 2").collect()} == {(11.0, 121.0)}


def test_smote_makes_many_copies_of_few_rows_in_runs(spark, monkeypatch):
    monkeypatch.setattr(sampling, "SMOTE_RUN", 50)
    df = spark.range(506).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("a"),
                                 (F.col("id") < 6).cast("int").alias("DX"))
    out = sampling.smote(df, ["a"]).where("synthetic = 1").collect()
    assert len(out) == 494 and len({r["row_id"] for r in out}) == 494 and all(0 <= r["a"] <= 5 for r in out)


def test_slot_order_does_not_change_the_rows(rows):
    a, b = (rows.select("row_id", f, "DX") for f in ("a", "b"))
    for order in ([(a, ["a"]), (b, ["b"])], [(b, ["b"]), (a, ["a"])]):
        with warnings.catch_warnings(record=True) as seen:
            warnings.simplefilter("always")
            preds, _ = cross_validate({"classifiers": ["nb_1", "nb_1"], "folds": 3}, order, use_smote=False)
        assert any("12 rows" in str(w.message) for w in seen)
        assert sorted(r["row_id"] for r in preds.collect()) == [i for i in range(60) if i % 5]
    with pytest.raises(ValueError, match="12 rows"):
        same_rows([(a, ["a"]), (b, ["b"])], "error")


def test_hold_out_split_in_cross_validation(rows):
    a = rows.select("row_id", "a", "DX")
    preds, m = cross_validate({"classifiers": ["nb_1"], "data_split": "hold-out"}, [(a, ["a"])], use_smote=False)
    assert sorted(r["row_id"] for r in preds.collect()) == list(range(40, 60))
    assert {r["fold"] for r in m.collect()} == {0}


def test_a_slot_without_a_row_is_an_error_in_the_vote(spark):
    s = spark.createDataFrame([(1, 0, 0, 0.9), (1, 1, 1, 0.4), (2, 0, 1, 1.0)], "row_id long, slot int, class int, p double")
    assert soft_vote(s.where("row_id = 1"), 2, 2).first()["pred"] == 0
    with pytest.raises(Exception, match="no score for row 2"):
        soft_vote(s, 2, 2).collect()


def test_singular_mixture_does_not_win_by_its_singularity(spark):
    df = spark.range(300).select((F.col("id") % 2 * 10 + F.rand(3)).alias("x")).select("x", F.col("x").alias("y"))
    got = {r["k"]: r for r in projection.gmm_components(df, ["x", "y"], max_k=2).collect()}
    assert got[2]["log_likelihood"] > got[1]["log_likelihood"] and got[2]["chosen"]


def test_auc_without_groups(spark):
    df = spark.createDataFrame([(1.0, 0.9), (1.0, 0.4), (0.0, 0.6), (0.0, 0.1)], "y double, p double")
    assert metrics.auc_micro(df).columns == ["auc"]
    assert metrics.auc_micro(df).first()["auc"] == pytest.approx(0.75)
