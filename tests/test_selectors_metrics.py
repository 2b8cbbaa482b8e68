"""Selectors, scaling, splits and metrics on literal fixtures and properties."""

import math

import pytest
from pyspark.sql import functions as F

from foldwise.operators import ensemble, metrics, sampling, scaling, selectors


def test_info_gain_copy_and_independent(spark):
    df = spark.createDataFrame([(i, x, z, y) for i, (x, z, y) in enumerate([(0, 0, 0), (0, 1, 0), (1, 0, 1), (1, 1, 1)])],
                               "row_id long, x int, z int, DX int")
    s = {r["feature"]: r["score"] for r in selectors.info_gain(df, ["x", "z"]).collect()}
    assert s["x"] == pytest.approx(math.log(2))
    assert s["z"] == pytest.approx(0.0, abs=1e-12)


def test_anova_f(spark):
    rows = [(i, v, 0) for i, v in enumerate([1.0, 2.0, 3.0])] + [(3 + i, v, 1) for i, v in enumerate([2.0, 3.0, 4.0])]
    df = spark.createDataFrame(rows, "row_id long, x double, DX int")
    assert selectors.anova_f(df, ["x"]).collect()[0]["score"] == pytest.approx(1.5)


def test_topn_and_kbest_ties(spark):
    sc = spark.createDataFrame([("a", 0, 1.0), ("b", 1, 2.0), ("c", 2, 2.0)], "feature string, position int, score double")
    assert [r["feature"] for r in selectors.top_n(sc, 1).collect()] == ["b"]
    assert [r["feature"] for r in selectors.top_n(sc, 0).collect()] == ["b"]
    assert len(selectors.top_n(sc, 10).collect()) == 3
    assert [r["feature"] for r in selectors.kbest_mask(sc, 1, 3).collect()] == ["c"]
    with pytest.raises(ValueError):
        selectors.kbest_mask(sc, 4, 3)


def test_standard_scale(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0), (1, 3.0, 5.0)], "row_id long, a double, b double")
    out = {r["row_id"]: (r["a"], r["b"]) for r in scaling.standard_scale(df, ["a", "b"]).collect()}
    assert out == {0: (-1.0, 0.0), 1: (1.0, 0.0)}


def test_class_weights(spark):
    df = spark.createDataFrame([(i, y) for i, y in enumerate([0, 0, 0, 1])], "row_id long, DX int")
    w = {r["class"]: r["weight"] for r in scaling.class_weights(df).collect()}
    assert w[0] == pytest.approx(2 / 3) and w[1] == pytest.approx(2.0)


def test_holdout(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "row_id long")
    out = {r["row_id"]: r["is_test"] for r in sampling.ordered_holdout(df, 0.33, buckets=3).collect()}
    assert [k for k, v in sorted(out.items()) if not v] == list(range(6))


def test_folds_are_stratified(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("DX"))
    f = sampling.stratified_folds(df, 5, 7, buckets=13)
    counts = f.groupBy("DX", "fold").count().collect()
    by_class = {}
    for r in counts:
        by_class.setdefault(r["DX"], []).append(r["count"])
    for c, v in by_class.items():
        assert len(v) == 5 and max(v) - min(v) <= 1
    assert f.select("row_id").distinct().count() == 1000


def test_fold_ranks_do_not_depend_on_bucket_count(spark):
    df = spark.range(300).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("DX"))
    a = {r["row_id"]: r["fold"] for r in sampling.stratified_folds(df, 3, 1, buckets=1).collect()}
    b = {r["row_id"]: r["fold"] for r in sampling.stratified_folds(df, 3, 1, buckets=17).collect()}
    assert a == b


def test_soft_vote_tie_lowest(spark):
    s = spark.createDataFrame([(1, 0, 0, 0.5), (1, 0, 1, 0.5), (1, 1, 0, 0.5), (1, 1, 1, 0.5)],
                              "row_id long, slot int, class int, p double")
    assert ensemble.soft_vote(s, 2, 2).collect()[0]["pred"] == 0


def test_soft_vote_slot_order_invariant(spark):
    rows = [(r, s, c, ((r * 7 + s * 3 + c) % 5) / 5.0) for r in range(20) for s in range(3) for c in range(4)]
    a = spark.createDataFrame(rows, "row_id long, slot int, class int, p double")
    b = a.withColumn("slot", 2 - F.col("slot"))
    va = {r["row_id"]: r["pred"] for r in ensemble.soft_vote(a, 3, 4).collect()}
    vb = {r["row_id"]: r["pred"] for r in ensemble.soft_vote(b, 3, 4).collect()}
    assert va == vb


def test_rates(spark):
    pairs = [(0, 0), (0, 0), (0, 1), (1, 1), (1, 1), (1, 1)]
    p = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "row_id long, DX int, pred int")
    r = {x["class"]: (x["sensitivity"], x["specificity"]) for x in metrics.class_rates(metrics.confusion_matrix(p)).collect()}
    assert r[0] == pytest.approx((2 / 3, 1.0)) and r[1] == pytest.approx((1.0, 2 / 3))


def test_auc_hard_five_class(spark):
    # accuracy 0.6 over 10 rows, 5 classes -> TPR 0.6, FPR 0.1 -> AUC 0.75
    y = [0, 1, 2, 3, 4, 0, 1, 2, 3, 4]
    yhat = [0, 1, 2, 3, 4, 0, 2, 3, 4, 0]
    p = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(y, yhat))], "row_id long, DX int, pred int")
    t = metrics.one_hot(p, "DX", 5)
    s = metrics.one_hot(p, "pred", 5).withColumnRenamed("y", "p")
    auc = metrics.auc_micro(t.join(s, ["row_id", "class"]).withColumn("g", F.lit(0)), ["g"]).collect()[0]["auc"]
    assert auc == pytest.approx(0.75)


def test_boxplot(spark):
    v = spark.createDataFrame([("c", float(x)) for x in [1, 2, 3, 4, 5]], "config string, value double")
    r = metrics.boxplot_stats(v, ["config"]).collect()[0]
    assert (r["q1"], r["median"], r["q3"], r["whisker_lo"], r["whisker_hi"], r["n_outliers"]) == (2, 3, 4, 1, 5, 0)


def test_hex_digits_compare_like_draws(spark):
    from fractions import Fraction

    from foldwise.functions.hashing import hex_of, md5_hex, md5_uniform
    df = spark.range(3000)
    for share in (0.0, 0.1, 0.5, 0.6, 0.7, 1.0):
        assert df.where((md5_uniform(7, "ok", F.col("id")) < share) != (md5_hex(7, "ok", F.col("id")) < hex_of(share))).count() == 0
    for i in range(1, 5):
        assert df.where((F.floor(md5_uniform(7, F.col("id")) * 5) >= i) != (md5_hex(7, F.col("id")) >= hex_of(Fraction(i, 5)))).count() == 0


def test_predictions_are_made_once(spark):
    from foldwise.operators import metrics
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b
    pred = spark.createDataFrame([(i, i % 3, i % 2, i % 4) for i in range(60)], "row_id long, fold int, DX int, pred int")
    metrics.fold_metrics(pred.mapInArrow(count, pred.schema), 4).collect()
    assert made.value == 60
