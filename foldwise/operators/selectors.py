"""Feature scoring and selection: information gain, ANOVA F, mRMR (MIQ), top-n cuts.

Scores are computed on the long layout with map-side partial aggregation, so the shuffle
is bounded by the number of distinct (feature, value, label) triples, and a hot value or
label only makes its partial aggregate larger, never a single task's input.
Every selector returns a score table (feature, position, score); cuts are separate.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.operators.longform import to_long


def _every_feature(scores: DataFrame, features: list[str]) -> DataFrame:
    """(feature, position, score) with a row for each feature; without a usable value its
    score is NULL, which ranks last."""
    names = scores.sparkSession.createDataFrame(list(zip(features, range(len(features)))), "feature string, position int")
    return names.join(scores.select("feature", "score"), "feature", "left")


def _xlogx(c):
    return F.when(c > 0, c * F.log(c)).otherwise(F.lit(0.0))


def mutual_info_long(long: DataFrame, label: str = "DX") -> DataFrame:
    """MI(feature; label) in nats, every distinct value a category: (feature, mi).

    MI = (sum n_xy ln n_xy - sum n_x ln n_x - sum n_y ln n_y + N ln N) / N, so after the
    contingency counts only sums per feature are needed (no joins of counts back onto rows).
    Rows whose value or label is NULL are left out.
    """
    kept = long.where(F.col("value").isNotNull() & F.col(label).isNotNull())
    nxy = kept.groupBy("feature", "value", label).agg(F.count(F.lit(1)).cast("double").alias("n"))
    per_x = nxy.groupBy("feature", "value").agg(F.sum("n").alias("nx"), F.sum(_xlogx(F.col("n"))).alias("a"))
    fx = per_x.groupBy("feature").agg(F.sum("a").alias("s_xy"), F.sum(_xlogx(F.col("nx"))).alias("s_x"),
                                      F.sum("nx").alias("n_all"))
    fy = (nxy.groupBy("feature", label).agg(F.sum("n").alias("ny"))
          .groupBy("feature").agg(F.sum(_xlogx(F.col("ny"))).alias("s_y")))
    n_all = F.col("n_all")
    return (fx.join(fy, "feature")
            .select("feature", ((F.col("s_xy") - F.col("s_x") - F.col("s_y") + _xlogx(n_all)) / n_all).alias("mi")))


def info_gain(df: DataFrame, features: list[str], label: str = "DX", key: str = "row_id") -> DataFrame:
    """(feature, position, score) with score = MI(feature; label)."""
    mi = mutual_info_long(to_long(df, features, key, label), label)
    return _every_feature(mi.select("feature", F.col("mi").alias("score")), features)


def anova_f(df: DataFrame, features: list[str], label: str = "DX", key: str = "row_id") -> DataFrame:
    """One-way ANOVA F per feature: F = (SSB/(k-1)) / (SSW/(N-k)); (feature, position, score).
    A feature that is constant within classes but not between them has F = infinity."""
    long = to_long(df, features, key, label).where(F.col("value").isNotNull() & F.col(label).isNotNull())
    g = long.groupBy("feature", label).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"),
        (F.var_pop("value") * F.count(F.lit(1))).alias("m2"))
    w = Window.partitionBy("feature")  # over the (feature x class) table only
    g = g.withColumn("n_all", F.sum("n").over(w)).withColumn(
        "grand", F.sum(F.col("n") * F.col("mean")).over(w) / F.col("n_all"))
    s = g.groupBy("feature").agg(
        F.sum(F.col("n") * (F.col("mean") - F.col("grand")) ** 2).alias("ssb"),
        F.sum("m2").alias("ssw"), F.count(F.lit(1)).alias("k"), F.first("n_all").alias("n_all"))
    score = F.when((F.col("k") > 1) & (F.col("ssw") == 0) & (F.col("ssb") > 0), F.lit(math.inf)).when(
        F.col("k") > 1, F.try_divide(F.col("ssb") / (F.col("k") - 1), F.col("ssw") / (F.col("n_all") - F.col("k"))))
    return _every_feature(s.select("feature", score.alias("score")), features)


def rank_scores(scores: DataFrame, group_cols=(), tie: str = "first") -> DataFrame:
    """Add ``rank`` (1-based) by score desc. Ties: 'first' -> earlier position wins (stable
    sort of the scores), 'last' -> later position wins (select-k-best). NULL scores rank last.
    The window runs over the score table: one row per feature (per group)."""
    pos = F.col("position").asc() if tie == "first" else F.col("position").desc()
    w = Window.partitionBy(*group_cols).orderBy(F.col("score").desc_nulls_last(), pos)
    return scores.withColumn("rank", F.row_number().over(w))


def top_n(scores: DataFrame, n: int, group_cols=()) -> DataFrame:
    """First n features by score (n = 0 means 1; n above the feature count keeps all)."""
    n = max(1, int(n))
    return rank_scores(scores, group_cols).where(F.col("rank") <= n)


def kbest_mask(scores: DataFrame, n: int, n_features: int, group_cols=()) -> DataFrame:
    """Top n by score, returned in original column order (select-k-best). n above the
    feature count is an error, as in the library it mirrors."""
    n = max(1, int(n))
    if n > n_features:
        raise ValueError(f"k={n} is larger than the number of features ({n_features})")
    return rank_scores(scores, group_cols, tie="last").where(F.col("rank") <= n)


def pairwise_mi(df: DataFrame, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], float]:
    """MI of pairs of features, in both orders, from one aggregate (a row a pair reaches the driver)."""
    number = [F.struct(F.lit(i).alias("feature"), F.col(f"`{f}`").cast("double").alias("value"), F.col(f"`{g}`").cast("double").alias("__s"))
              for i, (f, g) in enumerate(pairs)]
    if not pairs:
        return {}
    found = mutual_info_long(df.select(F.inline(F.array(*number))), "__s").collect()
    mi = {pairs[r["feature"]]: r["mi"] for r in found}
    return mi | {(g, f): v for (f, g), v in mi.items()}


def mrmr_miq(df: DataFrame, features: list[str], n: int, label: str = "DX", key: str = "row_id",
             eps: float = 1e-4, relevance: dict | None = None, redundancy: dict | None = None) -> DataFrame:
    """Greedy max-relevance / min-redundancy, quotient form (Peng et al. 2005).

    step 1: argmax MI(f; label); step t: argmax MI(f; label) / (mean_s MI(f; s) + eps) over
    the picks s so far. One job per step: the wide rows are unpivoted with the last pick's
    value carried along, so MI(f; last pick) for all remaining f is one aggregate, no join.
    Ties go to the earlier column; a feature without a usable value comes last, with NULL
    scores. Returns (rank, feature, position, relevance, score). The features and the label
    are written once and read by every step; one number per feature and step reaches the
    driver. With ``relevance`` {feature: MI} and ``redundancy`` {(feature, feature): MI} known, no job is run.
    """
    n = max(1, min(int(n), len(features)))
    if n > 1 and redundancy is None:
        from foldwise.sources.sink import write_and_read
        df = write_and_read(df.select(key, *[F.col(f"`{f}`").cast("double").alias(f) for f in features], label), "mrmr_input")
    rel = relevance
    if rel is None:
        rel = {r["feature"]: r["mi"] for r in mutual_info_long(to_long(df, features, key, label), label).collect()}
    empty = [f for f in features if rel.get(f) is None]
    features_all, features = features, [f for f in features if f not in empty]
    n_scored = min(n, len(features))
    pos = {f: i for i, f in enumerate(features_all)}
    picks = []
    if features:
        first = max(features, key=lambda f: (rel[f], -pos[f]))
        picks = [(first, rel[first])]
        red_sum = {f: 0.0 for f in features if f != first}
    while 0 < len(picks) < n_scored:
        last = picks[-1][0]
        remaining = [f for f in features if f not in {p for p, _ in picks}]
        if redundancy is not None:
            for f in remaining:
                red_sum[f] += redundancy.get((f, last), 0.0)
        else:
            long = (df.select(key, F.col(f"`{last}`").cast("double").alias("__s"),
                              *[F.col(f"`{f}`").cast("double").alias(f) for f in remaining])
                    .unpivot([key, "__s"], remaining, "feature", "value"))
            for r in mutual_info_long(long, "__s").collect():
                red_sum[r["feature"]] += r["mi"]
        k = len(picks)
        score = {f: rel[f] / (red_sum[f] / k + eps) for f in remaining}
        best = max(remaining, key=lambda f: (score[f], -pos[f]))
        picks.append((best, score[best]))
        del red_sum[best]
    spark = df.sparkSession
    picks += [(f, None) for f in empty[:n - len(picks)]]
    rows = [(i + 1, f, pos[f], rel.get(f), s) for i, (f, s) in enumerate(picks)]
    return spark.createDataFrame(rows, "rank int, feature string, position int, relevance double, score double")


def select_features(df: DataFrame, selected: list[str], key: str = "row_id", label: str = "DX") -> DataFrame:
    """Project onto the selected features, label always last."""
    feats = [f for f in selected if f != label]
    return df.select(key, *[f"`{f}`" for f in feats], label)


def dispatch(method: str, df: DataFrame, features: list[str], n, label: str = "DX", key: str = "row_id",
             seed: int = 1, **kw) -> tuple[list[str], DataFrame | None]:
    """Run one named selector; returns (selected feature names, score table or None).

    Unknown names (including 'none' and '') keep all features and report ['All'].
    """
    n = max(1, int(n))
    if method == "ig":
        ranked = top_n(info_gain(df, features, label, key), n)
    elif method == "univariate":
        ranked = kbest_mask(anova_f(df, features, label, key), n, len(features))
    elif method == "mrmr":
        ranked = mrmr_miq(df, features, n, label, key)
    elif method == "relieff":
        from foldwise.operators.relief import relieff
        ranked = top_n(relieff(df, features, label, key, **kw), n)
    elif method == "rf":
        from foldwise.operators.models import rf_importance
        ranked = top_n(rf_importance(df, features, label, seed=seed, num_trees=kw.get("num_trees", 38)), n)
    else:
        return ["All"], None
    from foldwise.sources.sink import write_and_read
    ranked = write_and_read(ranked, "ranking")  # a row per feature, read for the names and the report
    order = "position" if method == "univariate" else "rank"
    names = [r["feature"] for r in ranked.orderBy(order).select("feature").collect()]
    return names, ranked


SELECTORS = ("ig", "univariate", "mrmr", "relieff", "rf")
#: Rankings of a store that are made at once: most of their jobs are too short for all cores.
PARALLEL_RANKINGS = 4


def score_store(df: DataFrame, views: dict[str, list[str]], methods=SELECTORS, label: str = "DX", key: str = "row_id",
                seed: int = 1) -> DataFrame:
    """(dataset, selector, rank, feature, position, score): every feature of every view ranked once by each
    selector; a selection of any size is a cut of it. Scores that do not depend on the other features of a view (ig,
    univariate) are computed once for all views; greedy mRMR ranks a view to its end, so that each size is a prefix.
    ``views``: feature lists over the columns of ``df``."""
    unknown = [m for m in methods if m not in SELECTORS]
    if unknown:
        raise ValueError(f"selectors {unknown} are not in {SELECTORS}")
    spark = df.sparkSession
    layout = spark.createDataFrame([(v, f, i) for v, fs in views.items() for i, f in enumerate(fs)], "dataset string, feature string, position int")
    every = list(dict.fromkeys(f for fs in views.values() for f in fs))
    columns = ["dataset", "selector", "rank", "feature", "position", "score"]
    from foldwise.sources.sink import write_and_read
    out = []
    gains = write_and_read(info_gain(df, every, label, key), "score_ig") if {"ig", "mrmr"} & set(methods) else None
    for method, tie in (("ig", "first"), ("univariate", "last")):
        if method in methods:
            scores = gains if method == "ig" else anova_f(df, every, label, key)
            scored = layout.join(scores.select("feature", "score"), "feature").withColumn("selector", F.lit(method))
            out.append(rank_scores(scored, ["dataset"], tie).select(*columns))
    relevance, redundancy = None, None
    if "mrmr" in methods:  # views share their pairs of features
        relevance = {r["feature"]: r["score"] for r in gains.collect()}
        redundancy = pairwise_mi(df, sorted({tuple(sorted(p)) for fs in views.values() for p in combinations(fs, 2)}))
    def ranked_by(view: str, method: str) -> DataFrame:
        features = views[view]
        if method == "mrmr":
            ranked = mrmr_miq(df, features, len(features), label, key, relevance=relevance, redundancy=redundancy)
        elif method == "relieff":
            from foldwise.operators.relief import relieff
            ranked = write_and_read(rank_scores(relieff(df, features, label, key)), "score_relieff")
        else:
            from foldwise.operators.models import rf_importance
            ranked = rank_scores(rf_importance(df, features, label, seed=seed))
        return ranked.select(F.lit(view).alias("dataset"), F.lit(method).alias("selector"), "rank", "feature", "position",
                             F.col("score").cast("double").alias("score"))
    jobs = [(view, method) for view in views for method in methods if method in ("mrmr", "relieff", "rf")]
    with ThreadPool(PARALLEL_RANKINGS) as pool:
        out += pool.starmap(ranked_by, jobs)
    return write_and_read(reduce(DataFrame.unionByName, out), "score_store")


def size_grid(views: dict[str, list[str]]) -> dict[str, dict[str, int]]:
    """Small, medium and large selections of each view: a quarter, half and three quarters of its features."""
    return {v: {s: max(1, len(fs) * q // 4) for s, q in (("S", 1), ("M", 2), ("L", 3))} for v, fs in views.items()}


def cut_sizes(store: DataFrame, sizes: dict[str, dict[str, int]]) -> DataFrame:
    """(dataset, selector, size, n, rank, feature, score): the selections of a grid, from the store's ranks."""
    grid = store.sparkSession.createDataFrame([(v, s, n) for v, by in sizes.items() for s, n in by.items()], "dataset string, size string, n int")
    return store.join(F.broadcast(grid), "dataset").where(F.col("rank") <= F.col("n")).select(
        "dataset", "selector", "size", "n", "rank", "feature", "score")
