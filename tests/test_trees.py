"""Boosted trees and extremely randomised trees: independent recomputation, partition independence, models grown together."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators import boosting, forest
from foldwise.operators.models import boosted_trees, rf_importance
from foldwise.plans.experiment import cross_validate, cross_validate_many

FEATS = ["a", "b", "c", "d"]


def table(spark, n=150, classes=3, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    x = np.stack([y + rng.normal(0, 1, n), np.round(rng.normal(0, 2, n)), rng.normal(0, 1, n), np.zeros(n)], axis=1)
    rows = [(i, int(c), *map(float, v)) for i, (c, v) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, "row_id long, DX int, a double, b double, c double, d double"), x, y


def slow_boosting(x, y, rounds, depth, classes, step=0.1, bins=8):
    """Margins of the training rows, split by split in plain Python."""
    n = len(y)
    cuts = [sorted({sorted(x[:, f])[max(1, int(np.ceil(b * n / bins))) - 1] for b in range(1, bins)}) for f in range(x.shape[1])]
    m = np.zeros((n, classes))
    for _ in range(rounds):
        p = np.exp(m) / np.exp(m).sum(axis=1, keepdims=True)
        new = m.copy()
        for k in range(classes):
            g, h = p[:, k] - (y == k), 2 * p[:, k] * (1 - p[:, k])
            todo = [(np.arange(n), 0)]
            while todo:
                rows, level = todo.pop()
                G, H = g[rows].sum(), h[rows].sum()
                best = None
                for f in range(x.shape[1]) if level < depth else ():
                    for c in cuts[f]:
                        left = rows[x[rows, f] <= c]
                        gl, hl = g[left].sum(), h[left].sum()
                        if hl >= 1 and H - hl >= 1:
                            gain = round(gl ** 2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G ** 2 / (H + 1), 6)
                            if gain > 1e-6 and (best is None or gain > best[0]):
                                best = gain, f, c
                if best is None:
                    new[rows, k] -= step * G / (H + 1)
                else:
                    side = x[rows, best[1]] <= best[2]
                    todo += [(rows[side], level + 1), (rows[~side], level + 1)]
        m = new
    return m


@pytest.mark.parametrize("rounds,depth", [(1, 1), (3, 2), (13, 3)])  # 13 rounds: margins are written once on the way
def test_boosting_against_plain_python(spark, rounds, depth):
    df, x, y = table(spark)
    model = boosting.fit_boosted(df.withColumn("fit", F.lit(4)).repartition(5), FEATS, 3, rounds, depth, max_bins=8)[4]
    got = boosting.margins(model.bins(x), model.rounds, 3)
    assert np.allclose(got, slow_boosting(x, y, rounds, depth, 3), atol=1e-6)


def test_boosted_models_grown_together_equal_those_alone(spark):
    df, _, _ = table(spark)
    both = df.withColumn("fit", F.explode(F.array(F.lit(0), F.lit(1)))).where("fit = 0 or row_id % 3 > 0")
    together = boosting.fit_boosted(both, FEATS, 3, 3, 2)
    for fit in (0, 1):
        alone = boosting.fit_boosted(both.where(f"fit = {fit}").repartition(3), FEATS, 3, 3, 2)[fit]
        for a, b in zip(together[fit].rounds, alone.rounds):
            assert all(np.array_equal(u, v) for u, v in zip(a, b))


def test_boosted_scores(spark):
    df, _, y = table(spark, 120, 2)
    s = boosted_trees(df, df, FEATS, rounds=20).toPandas()
    assert np.allclose(s.groupby("row_id").p.sum(), 1) and len(s) == 240
    assert (s[s["class"] == 1].sort_values("row_id").p.round().to_numpy() == y).mean() > 0.75
    with pytest.raises(Exception, match="boosted trees"):
        boosted_trees(df.withColumn("a", F.when(F.col("row_id") > 3, F.col("a"))), df, FEATS, rounds=1)


def splits(df, **kw):
    return sorted((r["tree"], r["node"], r["feature"], r["cut"], r["n"], round(r["decrease"], 6)) for r in forest.extra_trees(df, FEATS, **kw).collect())


@pytest.mark.parametrize("local_rows", [1, 20, 149])
def test_trees_do_not_depend_on_where_nodes_are_handled(spark, local_rows):
    df, _, _ = table(spark)
    whole = splits(df, num_trees=3, seed=5)
    assert splits(df.repartition(7), num_trees=3, seed=5, local_rows=local_rows) == whole
    assert splits(df, num_trees=3, seed=6) != whole


def test_tree_by_hand(spark):
    df, x, y = table(spark, 60)
    got = {(r[1]): r for r in splits(df, num_trees=1, seed=9)}

    def check(node, rows):
        """The split of a node and of those below, from the definition."""
        counts = np.bincount(y[rows], minlength=3)
        if len(rows) < 2 or counts.max() == len(rows):
            assert node not in got
            return 1
        h = {f: hashlib.md5(f"9|0|{node}|{f}".encode()).hexdigest() for f in range(4)}
        order = sorted((f for f in range(4) if np.ptp(x[rows, f]) > 0), key=lambda f: (int(h[f][:8], 16), f))[:2]  # sqrt(4) candidates
        if not order:
            assert node not in got
            return 1
        gini = lambda r: len(r) - (np.bincount(y[r], minlength=3) ** 2).sum() / len(r)
        best = None
        for f in order:
            v = x[rows, f]
            cut = v.min() + int(h[f][8:16], 16) / 2 ** 32 * (v.max() - v.min())
            left, right = rows[v <= cut], rows[v > cut]
            gain = round(gini(rows) - gini(left) - gini(right), 9)
            if best is None or gain > best[0]:
                best = gain, f, cut, left, right
        assert got[node][2] == best[1] and got[node][3] == pytest.approx(best[2]) and got[node][5] == pytest.approx(best[0], abs=1e-5)
        return 1 + check(node + "0", best[3]) + check(node + "1", best[4])
    assert check("1", np.arange(60)) == 2 * len(got) + 1


def test_importances(spark):
    df, _, _ = table(spark)
    r = {v["feature"]: v["score"] for v in rf_importance(df, FEATS, num_trees=8).collect()}
    assert max(r, key=r.get) == "a" and r["d"] == 0 and sum(r.values()) == pytest.approx(1)
    assert splits(df.limit(0), num_trees=2) == []


def test_repetitions_together_equal_single_runs(spark):
    df, _, _ = table(spark, 60)
    df = df.where("DX < 2 or row_id % 2 = 0")  # uneven classes, so that rows are made up
    cfg = {"classifiers": ["knn_1", "nb_1", "xgb_1"], "folds": "3", "rounds": "2"}
    slots = [(df.select("row_id", "a", "b", "DX"), ["a", "b"]), (df.select("row_id", "c", "DX"), ["c"]), (df.select("row_id", "a", "DX"), ["a"])]
    many = {s: sorted(map(tuple, p)) for s, p in ((s, cross_validate_many(cfg, slots, [1, 2, 5])[0].where(f"rep = {s}").drop("rep").collect()) for s in (2,))}
    assert many[2] == sorted(map(tuple, cross_validate(cfg, slots, 2)[0].collect()))
