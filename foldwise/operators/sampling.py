"""Fold assignment, ordered hold-out and SMOTE oversampling.

Ranks inside a class are computed without a per-class window: rows are first spread over
``buckets`` sub-ranges of their ordering key, ranked inside (class, bucket), and shifted by
the sizes of the earlier buckets of the same class (a table of classes x buckets counts).
Because the buckets are ranges of the ordering key, the result equals a row_number over the
whole class, yet a class holding a third of all rows is split over ``buckets`` tasks.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.ml.feature import Bucketizer

from foldwise.functions.hashing import TWO_32, md5_u32, md5_uniform


def _default_buckets(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def rank_in_buckets(df: DataFrame, part_cols: list[str], bucket_col: str, order_cols: list[str],
                    out: str = "rank0") -> DataFrame:
    """0-based rank inside ``part_cols`` by ``order_cols``, given a ``bucket_col`` that is
    monotone in the ordering. Windows only ever see one (partition, bucket). NULL is a
    partition like any other, so every row comes back. The table of offsets has one row per
    (partition value, bucket); how it is joined is left to AQE, which sees its size."""
    w = Window.partitionBy(*part_cols, bucket_col).orderBy(*order_cols)
    ranked = df.withColumn("__rn", F.row_number().over(w))
    counts = df.groupBy(*part_cols, bucket_col).agg(F.count(F.lit(1)).alias("__c"))
    wo = Window.partitionBy(*part_cols).orderBy(bucket_col)  # over the counts table only
    offsets = counts.withColumn("__off", F.sum("__c").over(wo) - F.col("__c")).drop("__c")
    keys = [*part_cols, bucket_col]
    offsets = offsets.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], "__off")
    same = reduce(and_, [ranked[c].eqNullSafe(offsets[f"__k{i}"]) for i, c in enumerate(keys)])
    return (ranked.join(offsets, same, "inner")
            .withColumn(out, F.col("__off") + F.col("__rn") - 1)
            .drop("__rn", "__off", *[f"__k{i}" for i in range(len(keys))]))


def rank_by_hash(df: DataFrame, part_cols: list[str], seed, key: str = "row_id", salt: str = "",
                 buckets: int | None = None, out: str = "rank0") -> DataFrame:
    """0-based rank inside ``part_cols`` in the order of md5(seed|salt|key), ties by key."""
    buckets = buckets or _default_buckets(df)
    parts = [salt, F.col(key)] if salt else [F.col(key)]
    u = md5_u32(seed, *parts)
    tagged = df.withColumn("__u", u).withColumn("__b", F.floor(F.col("__u") * buckets / F.lit(TWO_32)).cast("int"))
    return rank_in_buckets(tagged, part_cols, "__b", ["__u", key], out).drop("__u", "__b")


def stratified_folds(df: DataFrame, k: int, seed, label: str = "DX", key: str = "row_id",
                     buckets: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Add ``fold`` in 0..k-1: per class, rows in md5(seed|key) order are dealt round-robin,
    so fold sizes within a class differ by at most one. Rows without a label are dealt like a
    class of their own. ``by``: columns whose values are dealt apart (``seed`` may be one of them)."""
    ranked = rank_by_hash(df, [*(by or []), label], seed, key, buckets=buckets)
    return ranked.withColumn("fold", (F.col("rank0") % k).cast("int")).drop("rank0")


def global_rank(df: DataFrame, order_col: str, buckets: int | None = None, rel_err: float = 1e-3,
                out: str = "rank0") -> DataFrame:
    """0-based rank of every row by ``order_col`` (ties: the column itself must be unique).

    Range buckets come from approximate quantiles (``buckets`` - 1 numbers reach the
    driver); rows are ranked inside their bucket and shifted by earlier buckets' counts.
    """
    buckets = buckets or _default_buckets(df)
    probs = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(df.approxQuantile(order_col, probs, rel_err))) if probs else []
    splits = [-math.inf] + [float(c) for c in cuts] + [math.inf]
    tagged = df.withColumn("__k", F.col(order_col).cast("double"))
    tagged = Bucketizer(splits=splits, inputCol="__k", outputCol="__b", handleInvalid="keep").transform(tagged)
    tagged = tagged.withColumn("__b", F.col("__b").cast("int")).withColumn("__p", F.lit(0))
    return rank_in_buckets(tagged, ["__p"], "__b", [order_col], out).drop("__k", "__b", "__p")


def ordered_holdout(df: DataFrame, test_size: float = 0.33, key: str = "row_id",
                    buckets: int | None = None) -> DataFrame:
    """Add ``is_test``: the last ceil(test_size * n) rows in key order, no shuffling."""
    n = df.count()
    n_test = math.ceil(test_size * n)
    n_train = n - n_test
    ranked = global_rank(df, key, buckets)
    return ranked.withColumn("is_test", F.col("rank0") >= F.lit(n_train)).drop("rank0")


#: Synthetic rows of one generating task.
SMOTE_RUN = 10_000


def smote(df: DataFrame, features: list[str], label: str = "DX", key: str = "row_id", k: int = 5,
          seed=1, buckets: int | None = None, block_rows: int = 20000, nulls: str = "error",
          small_classes: str = "refuse", repetitions: list | None = None) -> DataFrame:
    """Oversample every class below the majority count up to it (SMOTE, Chawla et al. 2002).

    For class c with n_c rows and need_c = n_max - n_c: synthetic j = 0..need_c-1 takes base
    row number j mod n_c in md5(seed|'base'|key) order, one of its k nearest same-class
    neighbours chosen by md5(seed|'nn'|c|j), and a step u = md5(seed|'step'|c|j):
    x = base + u * (neighbour - base). Synthetic keys are -(1 + j * C + class_index).
    Output = input rows + synthetic rows, with ``synthetic`` 0/1.

    A class that needs rows but has at most k of them has no k neighbours: an error that
    names it, unless ``small_classes="adapt"`` (then its n_c - 1 neighbours serve, and a class
    of one row repeats that row). A NULL label is an error; ``nulls`` is the policy for NULL
    features. Class counts stay a table; the numbers j are made in runs of SMOTE_RUN, so few
    base rows with many copies are still many tasks.

    ``repetitions``: seeds that share one plan and one neighbour search; the output then has all
    rows once for each, told apart by a column ``rep``.
    """
    from foldwise.operators.neighbors import knn_join
    from foldwise.operators.nulls import complete_features
    from foldwise.sources.sink import write_and_read
    if small_classes not in ("refuse", "adapt"):
        raise ValueError("small_classes must be 'refuse' or 'adapt'")
    base = complete_features(df.select(key, label, *features), features, "smote", nulls)
    every = Window.partitionBy()  # over the class counts: one row per class
    classes = (df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
               .select(F.col(label).alias("__c"), "__n", (F.max("__n").over(every) - F.col("__n")).alias("__need"),
                       (F.row_number().over(every.orderBy(label)) - 1).alias("__ci"), F.count(F.lit(1)).over(every).alias("__nc")))
    classes = write_and_read(classes, "smote_classes")
    if classes.where(F.col("__c").isNull()).limit(1).count():
        raise ValueError("smote: a row has no label")
    minority = classes.where("__need > 0")
    if small_classes == "refuse":
        bad = minority.where(F.col("__n") <= k).limit(3).collect()
        if bad:
            raise ValueError(f"smote: fewer than k + 1 = {k + 1} rows in class " + ", ".join(f"{r['__c']} ({r['__n']})" for r in bad))
    reps = F.explode(F.array(*[F.lit(r) for r in (repetitions if repetitions is not None else [seed])])).alias("rep")
    out = base.select(reps, "*").withColumn("synthetic", F.lit(0))
    src = base.join(minority.select(F.col("__c").alias(label)), label, "left_semi")
    runs = minority.withColumn("__run", F.explode(F.sequence(F.lit(0), F.ceil(F.col("__need") / SMOTE_RUN) - 1)))
    first = F.col("__run") * SMOTE_RUN
    syn = (runs.repartition("__c", "__run")
           .withColumn("j", F.explode(F.sequence(first, F.least(first + SMOTE_RUN, F.col("__need")) - 1)))
           .withColumn("p", F.col("j") % F.col("__n")).select(reps, "*"))
    rep = F.col("rep")
    k_eff = F.least(F.lit(k), F.col("__n") - 1)
    syn = syn.select(
        "rep", "__c", "__ci", "__nc", "j", "p",
        F.when(k_eff > 0, F.floor(md5_uniform(rep, "nn", F.col("__c"), F.col("j")) * k_eff) + 1).otherwise(0).cast("int").alias("__nn"),
        md5_uniform(rep, "step", F.col("__c"), F.col("j")).alias("__u"))
    # only base rows that a synthetic row starts from look for neighbours, among all rows of their class
    ranked = rank_by_hash(src.select(reps, key, label), ["rep", label], rep, key, salt="base", buckets=buckets, out="p")
    needs = minority.select(F.col("__c").alias(label), "__need")
    ranked = write_and_read(ranked.join(needs, label).where(F.col("p") < F.col("__need")).drop("__need"), "smote_bases")
    asked = src.join(ranked.select(key), key, "left_semi")
    nn = knn_join(asked, src, features, k, key=key, by=[label], exclude_self=True, block_rows=block_rows)
    numbers = F.array(*[F.col(f"`{f}`").cast("double") for f in features])  # one column: plans do not grow with features
    own = ranked.join(src.select(key, numbers.alias("__a")), key).select("rep", F.col(label).alias("__c"), "p", F.col(key).alias("__base"), "__a")
    other = src.select(F.col(key).alias("__nbr"), numbers.alias("__b"))
    near = nn.select(F.col("left_id").alias("__base"), F.col("rank").alias("__nn"), F.col("right_id").alias("__nbr")).join(other, "__nbr")
    syn = syn.join(own, ["rep", "__c", "p"]).join(near.drop("__nbr"), ["__base", "__nn"], "left")
    x = F.when(F.col("__nn") == 0, F.col("__a")).otherwise(
        F.zip_with("__a", "__b", lambda a, b: a + F.col("__u") * (b - a)))
    syn = syn.withColumn("__x", x)
    whole = out.unionByName(syn.select(
        "rep", (-(F.lit(1) + F.col("j") * F.col("__nc") + F.col("__ci"))).cast("bigint").alias(key), F.col("__c").alias(label),
        *[F.col("__x")[i].alias(f) for i, f in enumerate(features)], F.lit(1).alias("synthetic")))
    return whole if repetitions is not None else whole.drop("rep")
