"""Experiment orchestration: configs -> datasets -> selection -> cross-validation -> metrics.

Design choices where the original pipeline was ambiguous:
- one ``fold`` per row key, shared by every classifier slot (slots stay row-aligned); rows
  with a NULL in any slot are left out of all, with a warning that counts them;
- SMOTE runs per slot dataset before the split (the reference order); synthetic keys depend
  only on (class, j), so the slots' synthetic rows line up too;
- test rows are scaled with their own statistics by default (``fit_on='self'``);
- ragged parameter lists are rejected unless ``strict=False`` (then truncated);
- the fold-tagged datasets are checkpointed to the shared checkpoint folder, so later fold
  jobs neither recompute nor depend on the SMOTE/neighbour lineage.
"""

from __future__ import annotations

import os
import warnings
from functools import reduce
from multiprocessing.pool import ThreadPool
from operator import and_

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.operators import ensemble, metrics, models, projection, sampling, scaling, selectors
from foldwise.operators.datasets import features_of
from foldwise.plans.tables import CONF_DIR
from foldwise.session import scratch_scope
from foldwise.sources.sink import write_and_read


SELECTORS = ("ig", "univariate", "mrmr", "relieff", "rf")


def load_configs(path: str | None = None) -> dict:
    with open(path or os.path.join(CONF_DIR, "experiments.yml")) as fh:
        return yaml.safe_load(fh)


def check_config(name: str, cfg: dict, strict: bool = True) -> list[tuple]:
    """Zip the parallel lists into slots (dataset, selector, n or None, classifier)."""
    lists = {k: cfg.get(k) for k in ("data_list", "feature_selection", "classifiers")}
    for k, v in lists.items():
        if not isinstance(v, list):
            raise ValueError(f"{name}: '{k}' must be a list, got {type(v).__name__}")
    sizes = cfg.get("n_components")
    if sizes is not None and not isinstance(sizes, list):
        raise ValueError(f"{name}: 'n_components' must be a list")
    lens = [len(v) for v in lists.values()] + ([len(sizes)] if sizes is not None else [])
    if len(set(lens)) > 1:
        if strict:
            raise ValueError(f"{name}: parameter lists have different lengths {lens}")
        warnings.warn(f"{name}: ragged parameter lists {lens}; truncating to {min(lens)}")
    n = min(lens)
    sizes = sizes if sizes is not None else [None] * n
    return list(zip(lists["data_list"][:n], lists["feature_selection"][:n], sizes[:n], lists["classifiers"][:n]))


def select_slots(cfg: dict, datasets: dict[str, DataFrame], seed: int = 1, name: str = "config",
                 strict: bool = True):
    """Per slot: run the selector on the whole dataset (reference scope) and project.
    Returns ([(slot dataset, features)], report of (config, slot, dataset, method, rank, feature, score))."""
    spark = next(iter(datasets.values())).sparkSession
    out, reports = [], []
    for i, (dname, method, n, clf) in enumerate(check_config(name, cfg, strict)):
        df = datasets[dname]
        feats = features_of(df)
        if n is None and method in SELECTORS:  # as many features as the best mixture has components
            n = projection.gmm_components(df, feats, seed=seed).where("chosen").first()["k"]
        n = int(n) if n is not None else len(feats)
        names, ranked = selectors.dispatch(method, df, feats, n, seed=seed)
        if names == ["All"]:
            chosen = feats
            rep = spark.createDataFrame([(1, "All", None)], "rank int, feature string, score double")
        else:
            chosen = names
            rep = ranked.select(F.col("rank").cast("int"), "feature", F.col("score").cast("double"))
        out.append((selectors.select_features(df, chosen), chosen))
        reports.append(rep.select(F.lit(name).alias("config"), F.lit(i).alias("slot"), F.lit(dname).alias("dataset"),
                                  F.lit(method).alias("method"), "rank", "feature", "score"))
    report = reports[0]
    for r in reports[1:]:
        report = report.unionByName(r)
    return out, report


FAMILIES = ("knn", "nb", "svc", "xgb", "dl")
#: Configurations that run at once.
PARALLEL_CONFIGS = 4
#: Rows of all repetitions that are cross-validated together.
REPEATED_ROWS = 500_000


def family_of(classifier: str) -> str:
    """The family is 'dl' by substring, else the name's prefix."""
    family = "dl" if "dl" in classifier else classifier.split("_")[0]
    if family not in FAMILIES:
        raise ValueError(f"unknown classifier '{classifier}'")
    return family


def slot_scores(classifier: str, train: DataFrame, test: DataFrame, features: list[str], n_classes: int,
                cfg: dict, seed: int = 1) -> DataFrame:
    """Long class scores (row_id, class, p) of one slot for one split."""
    family = family_of(classifier)
    if family == "knn":
        return models.knn_scores(train, test, features, 2)
    if family == "nb":
        return models.gaussian_nb(train, test, features)
    if family == "svc":
        return models.rbf_svc(train, test, features, seed=seed)
    if family == "xgb":
        return models.boosted_trees(train, test, features, rounds=int(cfg.get("rounds", 100)))
    return models.mlp_classifier(train, test, features, n_classes, seed=seed, **_network(cfg))


def _network(cfg: dict) -> dict:
    return {"layers": cfg.get("layers", [["64", "tanh"], ["5", "softmax"]]), "dropouts": cfg.get("dropouts", ["0", "0"]),
            "epochs": int(cfg.get("epochs", 40)), "batch_size": int(cfg.get("batch_size", 32)), "opt": str(cfg.get("opt", "adam")),
            "loss": str(cfg.get("loss", "categorical_crossentropy"))}


def fold_scores(classifier: str, df: DataFrame, features: list[str], per: dict, params: dict, n_classes: int,
                cfg: dict) -> DataFrame:
    """(rep, row_id, class, p) of all repetitions and tested folds of one slot, fitted and scored together."""
    family = family_of(classifier)
    if family == "nb":
        return models.gaussian_nb_fold_scores(df, features, per, params)
    if family == "knn":
        return models.knn_fold_scores(df, features, params)
    if family == "xgb":
        return models.boosted_fold_scores(df, features, params, n_classes, rounds=int(cfg.get("rounds", 100)))
    if family == "svc":
        return models.svc_fold_scores(df, features, params)
    return models.mlp_fold_scores(df, features, params, n_classes, **_network(cfg))


def same_rows(slots: list[tuple[DataFrame, list[str]]], nulls: str = "exclude") -> list[tuple[DataFrame, list[str]]]:
    """All slots on one set of rows, whatever their order: those with a label and complete
    features in every slot. With nulls="error" a row that is not in this set is an error;
    with "exclude" it is left out of all slots, and a warning says how many were."""
    if nulls not in ("error", "exclude"):
        raise ValueError("nulls must be 'error' or 'exclude'")
    whole = [F.col("DX").isNotNull() & reduce(and_, [F.col(f"`{f}`").isNotNull() for f in feats], F.lit(True)) for _, feats in slots]
    counts = [df.agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("ok")).first() for (df, _), ok in zip(slots, whole)]
    if all(c["n"] == c["ok"] for c in counts) and len({c["n"] for c in counts}) == 1:
        return slots
    keys = reduce(lambda a, b: a.join(b, "row_id", "left_semi"), [df.where(ok).select("row_id") for (df, _), ok in zip(slots, whole)])
    keys = write_and_read(keys.distinct(), "cv_rows")
    left_out = max(c["n"] for c in counts) - keys.count()
    if nulls == "error":
        raise ValueError(f"{left_out} rows have a NULL label or feature in some slot")
    warnings.warn(f"{left_out} rows with a NULL label or feature in some slot are left out of all slots")
    return [(df.join(keys, "row_id", "left_semi"), feats) for df, feats in slots]


def cross_validate_many(cfg: dict, slots: list[tuple[DataFrame, list[str]]], seeds: list[int], use_smote: bool = True,
                        fit_on: str = "self", nulls: str = "exclude") -> tuple[DataFrame, DataFrame]:
    """k-fold CV of the soft-voting ensemble for every seed, or one ordered hold-out if ``data_split``
    says so (its test rows are fold 0, the others fold -1). Returns (predictions, per-fold metrics), both with
    the seed as ``rep``.

    The seed is a key column of one plan: synthetic rows of all seeds come from one neighbour search,
    folds from one ranking, statistics from one aggregate, and a slot's models of all seeds and folds are fitted by
    the same jobs; so the number of jobs does not depend on the number of seeds."""
    classifiers = cfg["classifiers"][:len(slots)]
    slots = same_rows(slots, nulls)
    n_classes = slots[0][0].select("DX").distinct().count()
    seeds = [int(s) for s in seeds]
    prepared = []
    for s, (df, feats) in enumerate(slots):
        if use_smote:
            df = sampling.smote(df, feats, k=5, repetitions=seeds).drop("synthetic")
        else:
            df = df.select(F.explode(F.array(*[F.lit(r) for r in seeds])).alias("rep"), "*")
        prepared.append((write_and_read(df, f"cv_rows{s}"), feats))
    labels = prepared[0][0].select("rep", "row_id", "DX")
    if str(cfg.get("data_split", "k-fold")) == "hold-out":  # the keys are the same for every seed
        split = sampling.ordered_holdout(labels.where(F.col("rep") == seeds[0]).drop("rep"), float(cfg.get("test_size", 0.33)))
        folds = labels.select("rep", "row_id").join(split.select("row_id", (F.col("is_test").cast("int") - 1).alias("fold")), "row_id")
        tested = [0]
    else:
        k = int(cfg.get("folds", 3))
        folds, tested = sampling.stratified_folds(labels, k, F.col("rep"), by=["rep"]).select("rep", "row_id", "fold"), list(range(k))
    folds = write_and_read(folds, "cv_folds")
    scores, truth = [], None
    for s, ((df, feats), clf) in enumerate(zip(prepared, classifiers)):
        # written once to the shared checkpoint folder: later jobs read it, and neither
        # recompute nor depend on the SMOTE / neighbour lineage
        t = write_and_read(df.join(folds, ["rep", "row_id"]), f"cv_slot{s}")
        truth = t.select("rep", "row_id", "DX", "fold") if truth is None else truth
        per = scaling.fold_moments(t, feats)
        params = scaling.fold_scale_params(per, feats, tested, fit_on)
        sc = fold_scores(clf, t, feats, per, params, n_classes, cfg)
        scores.append(sc.select("rep", "row_id", F.lit(s).alias("slot"), F.col("class").cast("int").alias("class"), "p"))
    vote = ensemble.soft_vote(reduce(DataFrame.unionByName, scores), len(scores), n_classes, group_cols=["rep"])
    preds = vote.join(truth.where(F.col("fold").isin(tested)), ["rep", "row_id"]).select(
        F.col("rep").cast("int").alias("rep"), "fold", "row_id", "DX", "pred")
    preds = write_and_read(preds, "cv_predictions")
    return preds, metrics.fold_metrics(preds, n_classes, ["rep"])


def cross_validate(cfg: dict, slots: list[tuple[DataFrame, list[str]]], seed: int = 1, use_smote: bool = True,
                   fit_on: str = "self", nulls: str = "exclude") -> tuple[DataFrame, DataFrame]:
    """:func:`cross_validate_many` with one seed."""
    preds, m = cross_validate_many(cfg, slots, [seed], use_smote, fit_on, nulls)
    return preds.drop("rep"), m.drop("rep")


def _seeded(cfg: dict) -> bool:
    """Whether selection depends on the seed: a forest's draws, or a mixture that sets the number of features."""
    methods = cfg.get("feature_selection")
    return "rf" in methods or (cfg.get("n_components") is None and any(m in SELECTORS for m in methods))


def run_many(name: str, cfg: dict, datasets: dict[str, DataFrame], seeds: list[int], strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(metrics, feature report) of one configuration for every seed. Metrics: (config, fold, metric, class,
    value, repetition); fold = -1 holds the mean over folds. Seeds with the same selected features are
    cross-validated together, so many at once that they have REPEATED_ROWS rows (or one seed); what one lot
    has written is gone before the next."""
    check_config(name, cfg, strict)
    chosen, reports = {}, []
    for seed in seeds if _seeded(cfg) else seeds[:1]:
        slots, report = select_slots(cfg, datasets, seed, name, strict)
        alike = chosen.setdefault(tuple(tuple(f) for _, f in slots), (slots, []))
        alike[1].extend([seed] if _seeded(cfg) else seeds)
        reports.append(report.withColumn("repetition", F.lit(seed)))
    out = []
    lots = []
    for slots, alike in chosen.values():
        at_once = len(alike)
        if at_once > 1:
            at_once = max(1, min(at_once, REPEATED_ROWS // max(1, slots[0][0].count())))
        if at_once == len(alike):
            lots.append(write_and_read(cross_validate_many(cfg, slots, alike)[1], "cv_metrics"))
            continue
        for a in range(0, len(alike), at_once):
            with scratch_scope(slots[0][0].sparkSession) as keep:
                lots.append(write_and_read(cross_validate_many(cfg, slots, alike[a:a + at_once])[1], "cv_metrics"))
                keep.append(lots[-1])
    for m in lots:
        avg = metrics.fold_average(m, ["rep"]).select("rep", F.lit(-1).alias("fold"), "metric", "class", "value")
        out.append(m.select("rep", "fold", "metric", "class", "value").unionByName(avg))
    rows = reduce(DataFrame.unionByName, out)
    return (rows.select(F.lit(name).alias("config"), "fold", "metric", "class", "value", F.col("rep").cast("int").alias("repetition")),
            reduce(DataFrame.unionByName, reports))


def run_experiment(name: str, cfg: dict, datasets: dict[str, DataFrame], seed: int = 1,
                   strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """:func:`run_many` with one seed: (config, fold, metric, class, value), and the report."""
    m, report = run_many(name, cfg, datasets, [seed], strict)
    return m.drop("repetition"), report.drop("repetition")


def run_all(cfgs: dict, datasets: dict[str, DataFrame], seed: int = 1) -> DataFrame:
    """Every config with one seed, a few at a time."""
    with ThreadPool(PARALLEL_CONFIGS) as pool:
        runs = pool.map(lambda c: run_experiment(c[0], c[1], datasets, seed)[0], cfgs.items())
    return reduce(DataFrame.unionByName, runs)


def repeat(cfgs: dict, datasets: dict[str, DataFrame], seeds=tuple(range(1, 21))) -> DataFrame:
    """Every config for every seed, the seeds of a config in one plan; all draws derive from the seed."""
    return reduce(DataFrame.unionByName, [run_many(name, cfg, datasets, list(seeds))[0] for name, cfg in cfgs.items()])
