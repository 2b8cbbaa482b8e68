"""Classifier slots. Every slot returns long class scores (row_id, class, p).

Closed-form slots (Gaussian naive Bayes, k-NN vote shares) are aggregates and joins and can
be checked exactly. Iterative slots are fitted by aggregates over the rows, for all folds and repetitions at once:
softmax gradient-boosted trees, RBF-kernel SVMs, and a feed-forward net.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.operators.boosting import boosted_scores, fit_boosted
from foldwise.operators.forest import extra_trees, importances
from foldwise.operators.kernel_svm import fit_svc, svc_scores
from foldwise.operators.neighbors import knn_join
from foldwise.operators.network import network_scores, network_shape, train_networks
from foldwise.operators.nulls import complete_features
from foldwise.operators.scaling import merge_moments, moments, scaled_moments
from foldwise.sources.sink import write_and_read


# -- Gaussian naive Bayes -------------------------------------------------------------------
def gaussian_nb_fit(train: DataFrame, features: list[str], label: str = "DX",
                    var_smoothing: float = 1e-9, nulls: str = "error") -> dict:
    """Per-class priors, means and variances (+ var_smoothing x largest feature variance).
    One grouped aggregate; C x F numbers reach the driver. Rows without a label are not
    training rows."""
    train = complete_features(train.where(F.col(label).isNotNull()), features, "naive Bayes, training rows", nulls)
    per = moments(train, features, [label])  # features are complete, so every count is the class size
    return gaussian_nb_model({c: m for (c,), m in per.items()}, features, var_smoothing)


def gaussian_nb_model(per: dict, features: list[str], var_smoothing: float = 1e-9) -> dict:
    """{class: (prior, {feature: (mean, variance)})} from {class: {feature: (n, mean, m2)}}."""
    tot = {f: merge_moments([m[f] for m in per.values()]) for f in features}
    eps = var_smoothing * max((q / n if n else 0.0) for n, _, q in tot.values())
    sizes = {c: max(n for n, _, _ in m.values()) for c, m in per.items()}
    n_all = sum(sizes.values())
    return {c: (sizes[c] / n_all, {f: (m[f][1], (m[f][2] / m[f][0] if m[f][0] else 0.0) + eps) for f in features})
            for c, m in sorted(per.items())}


class _NaiveBayes:
    """Vectorised joint log-likelihoods of a model."""

    def __init__(self, model: dict, features: list[str]):
        self.classes = np.array(sorted(model), dtype=np.int32)
        self.mu = np.array([[model[c][1][f][0] for f in features] for c in self.classes])
        var = np.array([[model[c][1][f][1] for f in features] for c in self.classes])
        self.const = np.log([model[c][0] for c in self.classes]) - 0.5 * np.log(2 * math.pi * var).sum(axis=1)
        self.inv = 1.0 / (2 * var)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        jll = self.const[None, :] - (((x[:, None, :] - self.mu[None, :, :]) ** 2) * self.inv[None, :, :]).sum(axis=2)
        p = np.exp(jll - jll.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def rows(self, ids: np.ndarray, x: np.ndarray, key: str) -> pd.DataFrame:
        return pd.DataFrame({key: np.repeat(ids.astype(np.int64), len(self.classes)),
                             "class": np.tile(self.classes, len(ids)), "p": self.probabilities(x).reshape(-1)})


def gaussian_nb_fold_scores(df: DataFrame, features: list[str], per: dict, params: dict, key: str = "row_id") -> DataFrame:
    """(rep, key, class, p) of all tested folds (the keys of ``params``) in one pass: each fold's model
    comes from the other folds' moments, in that fold's scaled space."""
    models, shift, scale = {}, {}, {}
    for (rep, i), p in params.items():
        others = [by for j, by in per[rep].items() if j != i]
        train = {c: {f: merge_moments([by[c][f] for by in others if c in by]) for f in features} for c in sorted({c for by in others for c in by})}
        models[rep, i] = _NaiveBayes(gaussian_nb_model({c: scaled_moments(m, p["train"]) for c, m in train.items()}, features), features)
        shift[rep, i] = np.array([p["test"][f][0] for f in features])
        scale[rep, i] = np.array([p["test"][f][1] for f in features])

    def score(batches):
        for pdf in batches:
            for of, rows in pdf.groupby(["rep", "fold"]):
                x = (rows[features].to_numpy(dtype=np.float64) - shift[of]) / scale[of]
                yield models[of].rows(rows[key].to_numpy(), x, key).assign(rep=of[0])
    df = df.where(F.col("fold").isin([i for _, i in params]))
    sel = df.select(F.col("rep").cast("long").alias("rep"), F.col(key).cast("long").alias(key), F.col("fold").cast("int").alias("fold"),
                    *[F.col(f"`{f}`").cast("double").alias(f) for f in features])
    return sel.mapInPandas(score, f"rep long, {key} long, class int, p double")


def gaussian_nb_scores(test: DataFrame, features: list[str], model: dict, key: str = "row_id",
                       nulls: str = "error") -> DataFrame:
    """Class probabilities from the joint log-likelihood
    log prior_c - 0.5 sum_f log(2 pi var_cf) - sum_f (x_f - mu_cf)^2 / (2 var_cf).

    Scoring is a vectorised matrix expression per Arrow batch (the C x F model travels with
    the task); rows stay in their partitions and no shuffle is involved.
    """
    nb = _NaiveBayes(model, features)

    def score(batches):
        for pdf in batches:
            yield nb.rows(pdf[key].to_numpy(), pdf[features].to_numpy(dtype=np.float64), key)
    test = complete_features(test, features, "naive Bayes, scored rows", nulls)
    sel = test.select(F.col(key).cast("long").alias(key), *[F.col(f"`{f}`").cast("double").alias(f) for f in features])
    return sel.mapInPandas(score, f"{key} long, class int, p double")


def gaussian_nb(train: DataFrame, test: DataFrame, features: list[str], label: str = "DX",
                key: str = "row_id") -> DataFrame:
    return gaussian_nb_scores(test, features, gaussian_nb_fit(train, features, label), key)


# -- k nearest neighbours ---------------------------------------------------------------------
def knn_scores(train: DataFrame, test: DataFrame, features: list[str], k: int = 2, label: str = "DX",
               key: str = "row_id", block_rows: int = 20000, test_rows: int | None = None) -> DataFrame:
    """Uniform vote share of each class among the k nearest training rows."""
    nn = knn_join(test, train, features, k, key=key, block_rows=block_rows, left_rows=test_rows)
    lab = train.select(F.col(key).alias("right_id"), F.col(label).alias("class"))
    return (nn.join(lab, "right_id").groupBy(F.col("left_id").alias(key), "class")
            .agg((F.count(F.lit(1)) / F.lit(float(k))).alias("p")))


def fold_rows(df: DataFrame, features: list[str], params: dict, label: str = "DX", key: str = "row_id") -> DataFrame:
    """(rep, tested, fit, is_test, key, label, z): every row once for each tested fold of its repetition, a test
    row in its own fold and a training row in the others, scaled for each; ``fit`` numbers the keys of ``params``."""
    numbers = [(rep, i, n, which == "test", [p[which][f][0] for f in features], [p[which][f][1] for f in features])
               for n, ((rep, i), p) in enumerate(params.items()) for which in ("train", "test")]  # repetitions x folds x features
    scales = df.sparkSession.createDataFrame(numbers, "rep long, tested int, fit int, is_test boolean, shift array<double>, scale array<double>")
    x = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    rows = (df.select(F.col("rep").cast("long").alias("rep"), key, label, F.col("fold").cast("int").alias("fold"), x.alias("x"))
            .withColumn("tested", F.explode(F.array(*[F.lit(i) for i in sorted({i for _, i in params})])))
            .withColumn("is_test", F.col("fold") == F.col("tested")).join(F.broadcast(scales), ["rep", "tested", "is_test"]))
    z = F.transform(F.arrays_zip("x", "shift", "scale"), lambda c: (c["x"] - c["shift"]) / c["scale"])
    return rows.select("rep", "tested", "fit", "is_test", key, label, z.alias("z"))


def _of_repetition(scores: DataFrame, params: dict, key: str = "row_id") -> DataFrame:
    """(rep, key, class, p) of scores (fit, key, class, p)."""
    reps = F.array(*[F.lit(int(rep)).cast("long") for rep, _ in params])
    return scores.select(F.get(reps, F.col("fit")).alias("rep"), key, "class", "p")


def knn_fold_scores(df: DataFrame, features: list[str], params: dict, k: int = 2, label: str = "DX",
                    key: str = "row_id") -> DataFrame:
    """(rep, key, class, p): vote shares of all tested folds by one join whose key holds repetition and
    fold. A key's label is the same in all repetitions."""
    rows = fold_rows(df, features, params, label, key)
    nn = knn_join(rows.where("is_test"), rows.where("not is_test"), "z", k, key=key, by=["fit"])
    lab = df.select(F.col(key).alias("right_id"), F.col(label).alias("class")).distinct()
    votes = (nn.join(lab, "right_id").groupBy(F.col("grp").cast("int").alias("fit"), F.col("left_id").alias(key), "class")
             .agg((F.count(F.lit(1)) / F.lit(float(k))).alias("p")))
    return _of_repetition(votes, params, key)


def boosted_fold_scores(df: DataFrame, features: list[str], params: dict, n_classes: int, rounds: int = 100, label: str = "DX",
                        key: str = "row_id") -> DataFrame:
    """(rep, key, class, p) of all tested folds, whose models are grown together."""
    rows = write_and_read(fold_rows(df, features, params, label, key), "boost_folds")
    grown = fit_boosted(rows.where("not is_test"), "z", n_classes, rounds=rounds, label=label)
    return _of_repetition(boosted_scores(rows.where("is_test"), "z", grown, n_classes, key), params, key)


# -- iterative slots ----------------------------------------------------------------------------
def rf_importance(df: DataFrame, features: list[str], label: str = "DX", seed: int = 1,
                  num_trees: int = 38, max_depth: int | None = None) -> DataFrame:
    """Impurity importances of extremely randomised trees grown on all rows, sqrt(F) candidate features a
    split (:mod:`foldwise.operators.forest`): (feature, position, score)."""
    return importances(extra_trees(df, features, label, seed, num_trees, max_depth=max_depth), features, num_trees)


def boosted_trees(train: DataFrame, test: DataFrame, features: list[str], label: str = "DX",
                  key: str = "row_id", rounds: int = 100, depth: int = 3, step: float = 0.1) -> DataFrame:
    """Softmax gradient-boosted trees (:mod:`foldwise.operators.boosting`); classes are 0..C-1."""
    n_classes = (train.agg(F.max(label)).first()[0] or 0) + 1
    grown = fit_boosted(train.withColumn("fit", F.lit(0)), features, n_classes, rounds, depth, step, label=label)
    return boosted_scores(test.withColumn("fit", F.lit(0)), features, grown, n_classes, key).drop("fit")


def mlp_layers(n_in: int, layers: list, dropouts: list, n_classes: int) -> list[int]:
    """Widths of the network that a layer list builds, input first."""
    return [n_in, *[w for w, _, _ in network_shape(n_in, layers, dropouts, n_classes)]]


def mlp_classifier(train: DataFrame, test: DataFrame, features: list[str], n_classes: int,
                   layers=(("64", "tanh"), ("64", "tanh"), ("5", "softmax")), dropouts=("0", "0", "0"),
                   epochs: int = 40, batch_size: int = 32, label: str = "DX", key: str = "row_id",
                   seed: int = 1, hard: bool = True, opt: str = "adam", loss: str = "categorical_crossentropy",
                   rate: float | None = None) -> DataFrame:
    """Feed-forward net as configured (:mod:`foldwise.operators.network`). With ``hard`` the
    slot scores are the one-hot argmax, as the deep-learning slot reports them."""
    shape = network_shape(len(features), list(layers), list(dropouts), n_classes)
    nets = train_networks(train.withColumn("fit", F.lit(0)), features, shape, int(epochs), int(batch_size), opt, loss, rate, label, key, {0: seed})
    return network_scores(test.withColumn("fit", F.lit(0)), features, nets, shape, key, hard).drop("fit")


def mlp_fold_scores(df: DataFrame, features: list[str], params: dict, n_classes: int, layers: list, dropouts: list, epochs: int, batch_size: int,
                    opt: str, loss: str, label: str = "DX", key: str = "row_id") -> DataFrame:
    """(rep, key, class, p) of all tested folds, whose networks are trained by the same jobs."""
    rows = write_and_read(fold_rows(df, features, params, label, key), "network_folds")
    shape = network_shape(len(features), list(layers), list(dropouts), n_classes)
    seeds = {n: int(rep) for n, (rep, _) in enumerate(params)}
    nets = train_networks(rows.where("not is_test"), "z", shape, epochs, batch_size, opt, loss, None, label, key, seeds)
    return _of_repetition(network_scores(rows.where("is_test"), "z", nets, shape, key), params, key)


def rbf_svc(train: DataFrame, test: DataFrame, features: list[str], label: str = "DX", key: str = "row_id",
            C: float = 0.0016, seed: int = 1) -> DataFrame:
    """RBF-kernel SVM with coupled pairwise probabilities (:mod:`foldwise.operators.kernel_svm`)."""
    fitted = fit_svc(train.withColumn("fit", F.lit(0)), features, C, label=label, key=key, seed=seed)
    return svc_scores(test.withColumn("fit", F.lit(0)), features, fitted, key).drop("fit")


def svc_fold_scores(df: DataFrame, features: list[str], params: dict, label: str = "DX", key: str = "row_id") -> DataFrame:
    """(rep, key, class, p) of all tested folds, whose machines are fitted together."""
    rows = write_and_read(fold_rows(df, features, params, label, key), "svm_folds")
    fitted = fit_svc(rows.where("not is_test"), "z", label=label, key=key)
    return _of_repetition(svc_scores(rows.where("is_test"), "z", fitted, key), params, key)
