"""Registered queries: one per operator of the experiment engine, over the driver tables.

Each query is ``fn(spark, sf_dir) -> DataFrame``. Outputs use fixed column names; doubles
are rounded to 6 decimals and floats widened to double by ``finish`` so that an SQL
re-statement (``foldwise.plans.oracle``) can be compared value by value.
"""

from __future__ import annotations

from fractions import Fraction
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.functions.hashing import hex_of, md5_hex, md5_u32, md5_uniform
from foldwise.operators import datasets as ds
from foldwise.operators import boosting, ensemble, forest, metrics, models, projection, sampling, scaling, selectors
from foldwise.operators.joins import drop_columns, label_encode, left_join_enrich, rename_columns
from foldwise.operators.neighbors import knn_join
from foldwise.operators.relief import relieff
from foldwise.operators.rules import RuleProgram, clean
from foldwise.plans import tables as tb
from foldwise.sources.catalog import driver_catalog
from foldwise.sources.sink import write_and_read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Widen floats to double and round doubles (engine-independent comparison)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.round(c.cast("double"), digits)
        cols.append(c.alias(f.name))
    return df.select(*cols)


# ---------------------------------------------------------------------------------------------
# shared inputs
LINE_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
CUST_RULE_FEATURES = ["acctbal_txt", "nation_code", "acctbal", "segment_txt"]


def lineitem_dataset(spark, sf):
    """Line items as (row_id, 4 discrete features, DX = l_returnflag). The generated table has
    no unique line key, so row_id (order key * 8 + line number) is a label, not a join key;
    no selector joins on it."""
    li = tb.table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
                                          "l_returnflag"])
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), "l_quantity",
                     (F.col("l_discount") + 0.0).alias("l_discount"), (F.col("l_tax") + 0.0).alias("l_tax"),
                     "l_linenumber", F.col("l_returnflag").alias("DX"))


def wide_table(spark, sf) -> DataFrame:
    """The enriched entity table, joined once and written: for queries that read it more than
    once (fitted means, then the data; several datasets)."""
    return write_and_read(tb.order_table(spark, sf), "wide")


def cleaned_modalities(spark, sf) -> dict[str, DataFrame]:
    """Each modality cleaned by its own rule program; the programs' means are fitted by one
    aggregate over the wide table, and each modality is a projection of it."""
    from foldwise.operators.rules import fit_together
    wide = wide_table(spark, sf)
    rules = tb.rule_groups()
    raw = ds.modality_datasets(wide, tb.full_catalog(spark), tb.MODALITIES)
    programs = {n: RuleProgram(d, rules[n]) for n, d in raw.items()}
    fit_together(wide, list(programs.values()))
    if any(p.has_filters for p in programs.values()):
        return {n: p.result() for n, p in programs.items()}
    return {n: wide.select(*p.exprs()) for n, p in programs.items()}


def cleaned_views(spark, sf) -> dict[str, DataFrame]:
    """Modalities cleaned by their own rule programs; since no program filters rows, every
    view is one projection of the wide table (no joins)."""
    wide = wide_table(spark, sf)
    rules = tb.rule_groups()
    raw = ds.modality_datasets(wide, tb.full_catalog(spark), tb.MODALITIES)
    programs = {n: RuleProgram(d, rules[n]) for n, d in raw.items()}
    from foldwise.operators.rules import fit_together
    fit_together(wide, list(programs.values()))
    out = {}
    if any(p.has_filters for p in programs.values()):
        return ds.dataset_views({n: p.result() for n, p in programs.items()}, tb.VIEWS)
    for n, p in programs.items():
        out[n] = wide.select(*p.exprs())
    for view, parts in tb.VIEWS.items():
        exprs = [e for part in parts for e in programs[part].exprs(exclude=("row_id", "DX"))]
        out[view] = wide.select("row_id", *exprs, "DX")
    return out


def order_labels(spark, sf) -> DataFrame:
    """(row_id, DX) straight from orders: the enrichment joins never change the row set."""
    o = tb.table(spark, sf, "orders", ["o_orderkey", "o_orderpriority"])
    return o.select(F.col("o_orderkey").alias("row_id"), label_encode("o_orderpriority", tb.PRIORITY_LABELS).alias("DX"))


def materialized_views(spark, sf) -> dict[str, DataFrame]:
    """The cleaned ``full`` view written once to the shared checkpoint folder; the other views
    are projections of that table. For consumers that read the views many times (selection
    per slot, every fold), so the joins and cleaning run once."""
    views = cleaned_views(spark, sf)
    full = write_and_read(views["full"], "view_full")
    return {name: full.select(*df.columns) for name, df in views.items() if name in tb.VIEWS}


def md5_predictions(spark, sf, seed=7, p_ok=0.6, k=3) -> DataFrame:
    """Orders with folds and a deterministic noisy prediction of DX (5 classes)."""
    o = order_labels(spark, sf)
    o = sampling.stratified_folds(o, k, 1)
    pred = F.when(md5_uniform(seed, "ok", F.col("row_id")) < p_ok, F.col("DX")).otherwise(
        F.floor(md5_uniform(seed, "guess", F.col("row_id")) * 5).cast("int"))
    return o.withColumn("pred", pred.cast("int"))


def emb_split(spark, sf, dims=64, start=0):
    e = tb.embeddings_wide(spark, sf, dims, start)
    return sampling.stratified_folds(e, 3, 1)


# ---------------------------------------------------------------------------------------------
# 2.1 sources, sinks, catalog
@query("scan_alias")
def q_scan_alias(spark, sf):
    return driver_catalog(sf).read(spark, "orders", ["o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"])


def _profile(spark, sf) -> DataFrame:
    w = tb.order_table(spark, sf)
    feats = sorted({f for f, _ in tb.CATALOG_ORDER_SIDE + tb.CATALOG_LINE_SIDE})
    wide = w.agg(*[F.count(F.col(f)).alias(f) for f in feats])
    return wide.unpivot([], feats, "Feature", "n_nonnull")


def _tagged_catalog(spark) -> DataFrame:
    a, b = tb.catalogs(spark)
    return a.withColumn("source", F.lit("order_side")).union(b.withColumn("source", F.lit("line_side")))


@query("feature_catalog_union")
def q_feature_catalog_union(spark, sf):
    return _tagged_catalog(spark).join(_profile(spark, sf), "Feature", "left") \
        .select("Feature", "Grouping", "source", F.col("n_nonnull").cast("bigint"))


CSV_SCHEMA = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("csv_round_trip")
def q_csv_round_trip(spark, sf):
    """Customers to CSV with a header, read back through an alias with an explicit schema."""
    from foldwise.session import scratch_path
    from foldwise.sources.catalog import Catalog, Entry
    from foldwise.sources.sink import write_table
    cols = [c.split()[0] for c in CSV_SCHEMA.split(", ")]
    path = write_table(tb.table(spark, sf, "customer", cols), scratch_path(spark, "customer_csv"), fmt="csv")
    return Catalog({"customer": Entry(path, "csv", CSV_SCHEMA)}).read(spark, "customer")


@query("csv_inferred")
def q_csv_inferred(spark, sf):
    """The same file with inferred types, as the reference reads; per segment."""
    from foldwise.session import scratch_path
    from foldwise.sources.catalog import Catalog, Entry
    from foldwise.sources.sink import write_table
    path = write_table(tb.table(spark, sf, "customer", ["c_custkey", "c_acctbal", "c_mktsegment"]),
                       scratch_path(spark, "customer_csv"), fmt="csv")
    c = Catalog({"customer": Entry(path, "csv")}).read(spark, "customer", ["c_mktsegment", "c_custkey", "c_acctbal"])
    return finish(c.groupBy("c_mktsegment").agg(F.sum("c_custkey").cast("bigint").alias("key_sum"), F.avg("c_acctbal").alias("mean_acctbal")))


@query("filter_in_list")
def q_filter_in_list(spark, sf):
    cat = _tagged_catalog(spark).filter(F.col("Grouping").isin(tb.MODALITIES["customer"]))
    return cat.join(_profile(spark, sf), "Feature", "left") \
        .select("Feature", "Grouping", "source", F.col("n_nonnull").cast("bigint"))


NOISE_LEVELS = (0.5, 0.6, 0.7, 0.8)


def _metric_runs(spark, sf, repetitions=tuple(range(1, 21)), levels=NOISE_LEVELS, k=5) -> DataFrame:
    """Per-fold metrics of several (repetition, noise level) runs in one pipeline: each order
    row is repeated once per run (the runs are rows, not plan branches), its prediction drawn
    with the run's seed, and all metrics grouped by run."""
    runs = [(rep, f"noise_{lv}", rep * 100 + int(lv * 10), lv) for rep in repetitions for lv in levels]
    arr = F.array(*[F.struct(F.lit(r).alias("repetition"), F.lit(c).alias("config"), F.lit(str(sd)).alias("seed"),
                             F.lit(hex_of(lv)).alias("ok")) for r, c, sd, lv in runs])
    base = sampling.stratified_folds(order_labels(spark, sf), k, 1)
    x = base.select("row_id", "DX", "fold", F.explode(arr).alias("run")).select("row_id", "DX", "fold", "run.*")
    # draws are compared as hex digits, which spares making numbers of them
    draw = F.transform(F.array(md5_hex(F.col("seed"), "guess", F.col("row_id"))), lambda h: sum(
        ((h >= hex_of(Fraction(i, 5))).cast("int") for i in range(1, 5)), F.lit(0)))[0]
    pred = F.when(md5_hex(F.col("seed"), "ok", F.col("row_id")) < F.col("ok"), F.col("DX")).otherwise(draw)
    p = x.withColumn("pred", pred.cast("int"))
    return metrics.fold_metrics(p, 5, ["repetition", "config"])


@query("metrics_sink")
def q_metrics_sink(spark, sf):
    m = _metric_runs(spark, sf)
    back = write_and_read(m, "metrics_sink", partition_by=("repetition",))
    return finish(back.select("repetition", "config", "fold", "metric", "class", "value"))


@query("materialize_datasets")
def q_materialize_datasets(spark, sf):
    out = None
    for name, df in cleaned_modalities(spark, sf).items():
        back = write_and_read(df, f"dataset_{name}")
        s = back.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("row_id").alias("key_sum")).select(
            F.lit(name).alias("dataset"), "n_rows", "key_sum", F.lit(len(df.columns) - 2).alias("n_features"))
        out = s if out is None else out.unionByName(s)
    return out


# 2.2 projections / derivations ----------------------------------------------------------------
ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("drop_columns")
def q_drop_columns(spark, sf):
    return drop_columns(tb.table(spark, sf, "orders", ORDER_COLS), "o_orderdate", "o_comment")


@query("rename_columns")
def q_rename_columns(spark, sf):
    o = tb.table(spark, sf, "orders", ORDER_COLS).drop("o_orderdate")
    return rename_columns(o, {"o_orderkey": "row_id", "o_orderpriority": "priority"})


@query("label_encode")
def q_label_encode(spark, sf):
    o = tb.table(spark, sf, "orders", ["o_orderkey", "o_orderpriority"])
    return o.select(F.col("o_orderkey").alias("row_id"), label_encode("o_orderpriority", tb.PRIORITY_LABELS).alias("DX"))


@query("left_join_enrich")
def q_left_join_enrich(spark, sf):
    return finish(tb.order_table(spark, sf).drop("o_orderdate"))


@query("left_join_enrich_variant")
def q_left_join_enrich_variant(spark, sf):
    o = tb.table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"])
    la = tb.line_agg(spark, sf).select(F.col("l_orderkey").alias("o_orderkey"), "n_lines")
    cu = tb.table(spark, sf, "customer", ["c_custkey", "c_mktsegment", "c_acctbal"]) \
        .withColumnRenamed("c_custkey", "o_custkey")
    return left_join_enrich(o, [(la, ["o_orderkey"]), (cu, ["o_custkey"])]).select(
        "o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", "n_lines", "c_mktsegment", "c_acctbal")


@query("left_join_composite")
def q_left_join_composite(spark, sf):
    """A two-column key whose right side repeats keys and misses some: lines enriched by the
    returned lines of the same order and line number."""
    cols = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"]
    li = tb.table(spark, sf, "lineitem", cols)
    back = li.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("returned_qty"))
    return finish(left_join_enrich(li.select(*cols[:3]), [(back, ["l_orderkey", "l_linenumber"])]))


@query("left_join_duplicates")
def q_left_join_duplicates(spark, sf):
    """Duplicate right keys multiply rows, as in SQL: orders with each of their lines."""
    o = tb.table(spark, sf, "orders", ["o_orderkey", "o_orderpriority"]).withColumnRenamed("o_orderkey", "row_id")
    li = tb.table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"])
    return finish(left_join_enrich(o, [(li, {"row_id": "l_orderkey"})]))


@query("anova_nulls")
def q_anova_nulls(spark, sf):
    """ANOVA on columns with NULL values, NULL labels, no value at all, and a perfect one."""
    c = _null_bearing(spark, sf)
    return finish(selectors.anova_f(c, NULL_FEATURES).withColumn("score", F.when(F.col("score") < float("inf"), F.col("score"))
                                                                 .otherwise(F.when(F.col("score").isNotNull(), F.lit(-1.0)))))


@query("info_gain_nulls")
def q_info_gain_nulls(spark, sf):
    return finish(selectors.info_gain(_null_bearing(spark, sf), NULL_FEATURES))


@query("folds_null_labels")
def q_folds_null_labels(spark, sf):
    return sampling.stratified_folds(_null_bearing(spark, sf).select("row_id", "DX"), 4, 1)


NULL_FEATURES = ["acctbal", "nation_code", "nothing", "exact"]


def _null_bearing(spark, sf) -> DataFrame:
    c = tb.customer_raw(spark, sf)
    dx = F.when(F.col("c_custkey") % 13 != 0, label_encode("c_mktsegment", tb.SEGMENT_LABELS))
    return c.select(F.col("c_custkey").alias("row_id"), "acctbal", "nation_code", F.lit(None).cast("double").alias("nothing"),
                    label_encode("c_mktsegment", tb.SEGMENT_LABELS).cast("double").alias("exact"), dx.alias("DX"))


@query("feature_subset")
def q_feature_subset(spark, sf):
    return finish(ds.feature_subset(tb.order_table(spark, sf), tb.full_catalog(spark), tb.MODALITIES["customer"]))


@query("modality_datasets")
def q_modality_datasets(spark, sf):
    """All modalities from one aggregate of the wide table."""
    wide = tb.order_table(spark, sf)
    parts = {n: ds.features_of(d) for n, d in ds.modality_datasets(wide, tb.full_catalog(spark), tb.MODALITIES).items()}
    feats = sorted({f for fs in parts.values() for f in fs})
    counts = wide.agg(F.count(F.lit(1)).alias("__n"), *[F.count(F.col(f"`{f}`")).alias(f) for f in feats])
    rows = [F.struct(F.lit(n).alias("dataset"), F.lit(f).alias("feature"), F.col(f"`{f}`").cast("bigint").alias("n_nonnull"),
                     F.col("__n").cast("bigint").alias("n_rows")) for n, fs in parts.items() for f in fs]
    return counts.select(F.inline(F.array(*rows)))


def cleaned_parts(spark, sf, views: bool = False):
    """(wide table, {name: [(feature, cleaning expression)]}) for the modalities (or views):
    all cleaned datasets are projections of the one wide table, fitted by one aggregate."""
    from foldwise.operators.rules import fit_together
    wide = wide_table(spark, sf)
    rules = tb.rule_groups()
    raw = ds.modality_datasets(wide, tb.full_catalog(spark), tb.MODALITIES)
    programs = {n: RuleProgram(d, rules[n]) for n, d in raw.items()}
    fit_together(wide, list(programs.values()))
    if any(p.has_filters for p in programs.values()):
        raise ValueError("row filters in modality rules: use cleaned_modalities (keyed joins)")
    parts = {n: p.named_exprs(exclude=("row_id", "DX")) for n, p in programs.items()}
    if views:
        parts = {v: [e for part in ps for e in parts[part]] for v, ps in tb.VIEWS.items()}
    return wide, parts


def _moments_long(wide: DataFrame, parts: dict, label: str) -> DataFrame:
    """(label, feature, position, n_nonnull, mean) for every part, in one aggregate."""
    entries, aggs = [], []
    for name, exprs in parts.items():
        for i, (f, e) in enumerate(exprs):
            j = len(entries)
            entries.append((name, f, i, j))
            aggs += [F.count(e).alias(f"n_{j}"), F.avg(e.cast("double")).alias(f"m_{j}")]
    stats = wide.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias(label), F.lit(f).alias("feature"), F.lit(i).alias("position"),
                                        F.col(f"n_{j}").cast("bigint").alias("n_nonnull"), F.col(f"m_{j}").alias("mean"))
                               for name, f, i, j in entries]))
    return finish(stats.select(rows.alias("r")).select("r.*"))


@query("clean_all")
def q_clean_all(spark, sf):
    wide, parts = cleaned_parts(spark, sf)
    return _moments_long(wide, parts, "dataset")


@query("dataset_views")
def q_dataset_views(spark, sf):
    wide, parts = cleaned_parts(spark, sf, views=True)
    return _moments_long(wide, parts, "view")


@query("align_by_row")
def q_align_by_row(spark, sf):
    mods = cleaned_modalities(spark, sf)
    from foldwise.operators.joins import align_by_row
    return finish(align_by_row([mods["order"], mods["customer"], mods["lines"]]))


@query("choose_datasets")
def q_choose_datasets(spark, sf):
    views = cleaned_views(spark, sf)
    out = None
    for slot, (name, df) in enumerate(ds.choose_datasets(views, ["buyer", "basket", "buyer"])):
        s = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(slot).alias("slot"), F.lit(name).alias("dataset"), "n_rows",
            F.lit(len(ds.features_of(df))).alias("n_features"))
        out = s if out is None else out.unionByName(s)
    return out


# 2.3 / 2.4 filters and cleansing rules ---------------------------------------------------------
def _customer(spark, sf):
    return tb.customer_dataset(spark, sf)


def _rules_subset(keys: set[str]) -> dict:
    full = tb.rule_groups()["customer"]
    return {f: {k: v for k, v in r.items() if k in keys} for f, r in full.items()}


@query("null_tokens")
def q_null_tokens(spark, sf):
    out = clean(_customer(spark, sf), _rules_subset({"nullVals"}))
    return finish(out.select("row_id", "acctbal_txt", "nation_code", "ACCTBAL", "segment_txt"))


@query("mean_impute")
def q_mean_impute(spark, sf):
    out = clean(_customer(spark, sf), _rules_subset({"nullVals", "nullHandling"}))
    return finish(out.select("row_id", F.col("acctbal_txt").try_cast("double").alias("acctbal_txt"),
                             "nation_code", "ACCTBAL"))


@query("remove_nulls")
def q_remove_nulls(spark, sf):
    rules = {"segment_txt": {"nullVals": ["None"], "nullHandling": "remove"}}
    return clean(_customer(spark, sf), rules).select("row_id", "segment_txt")


@query("replace_values")
def q_replace_values(spark, sf):
    r = _rules_subset({"nullVals", "replaceVals"})
    return clean(_customer(spark, sf), {"segment_txt": r["segment_txt"]}).select("row_id", "segment_txt")


@query("replace_values_literal")
def q_replace_values_literal(spark, sf):
    r = _rules_subset({"nullVals", "replaceVals"})
    return clean(_customer(spark, sf), {"segment_txt": r["segment_txt"]}, null_key=False).select("row_id", "segment_txt")


@query("cast_type")
def q_cast_type(spark, sf):
    rules = {"acctbal_txt": {"fieldType": "float"}, "segment_txt": {"fieldType": "integer"},
             "nation_code": {"fieldType": "float"}}
    return finish(clean(_customer(spark, sf), rules).select("row_id", *["acctbal_txt", "segment_txt", "nation_code"]))


@query("ratio_normalize")
def q_ratio_normalize(spark, sf):
    rules = {"acctbal_txt": {"nullVals": ["-1", "-4", "None"], "replaceVals": [[">9000", "9000"]],
                             "fieldType": "float", "normalizeOtherFt": "NATION_CODE"}}
    return finish(clean(_customer(spark, sf), rules).select("row_id", "acctbal_txt"))


@query("clean_rules")
def q_clean_rules(spark, sf):
    return finish(clean(_customer(spark, sf), tb.rule_groups()["customer"]))


@query("clean_rules_preclean")
def q_clean_rules_preclean(spark, sf):
    return finish(clean(_customer(spark, sf), tb.preclean_rules()["customer"]))


@query("agg_mean")
def q_agg_mean(spark, sf):
    c = tb.customer_raw(spark, sf)
    return finish(c.agg(F.avg(F.col("acctbal_txt").try_cast("double")).alias("mean_acctbal_txt"),
                        F.avg("nation_code").alias("mean_nation_code"), F.avg("acctbal").alias("mean_acctbal")))


# 2.6 / 2.8 aggregation, ranking, selection -------------------------------------------------------
@query("info_gain")
def q_info_gain(spark, sf):
    return finish(selectors.info_gain(lineitem_dataset(spark, sf), LINE_FEATURES))


@query("rank_topk")
def q_rank_topk(spark, sf):
    r = selectors.top_n(selectors.info_gain(lineitem_dataset(spark, sf), LINE_FEATURES), 3)
    return finish(r.select("rank", "feature", "score"))


@query("mrmr_miq")
def q_mrmr_miq(spark, sf):
    return finish(selectors.mrmr_miq(lineitem_dataset(spark, sf), LINE_FEATURES, 3))


def _customer_anova_input(spark, sf):
    c = tb.table(spark, sf, "customer", ["c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment"])
    return c.select(F.col("c_custkey").alias("row_id"), "c_acctbal", "c_nationkey",
                    label_encode("c_mktsegment", tb.SEGMENT_LABELS).alias("DX"))


@query("anova_f")
def q_anova_f(spark, sf):
    return finish(selectors.anova_f(_customer_anova_input(spark, sf), ["c_acctbal", "c_nationkey"]))


@query("kbest_mask")
def q_kbest_mask(spark, sf):
    full = cleaned_views(spark, sf)["full"]
    feats = ds.features_of(full)
    r = selectors.kbest_mask(selectors.anova_f(full, feats), 5, len(feats))
    return finish(r.select("feature", "position", "score"))


@query("label_append")
def q_label_append(spark, sf):
    basket = cleaned_views(spark, sf)["basket"]
    names, _ = selectors.dispatch("ig", basket, ds.features_of(basket), 2)
    sel = selectors.select_features(basket, names)  # (row_id, picks..., DX): label always last
    assert sel.columns[-1] == "DX"
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("feature")).cast("int")
    long = sel.select("row_id", "DX", *[F.col(n).cast("double").alias(n) for n in names]).unpivot(
        ["row_id", "DX"], names, "feature", "value")
    return finish(long.select("row_id", rank.alias("rank"), "feature", "value", "DX"))


@query("select_none")
def q_select_none(spark, sf):
    basket = cleaned_views(spark, sf)["basket"]
    names, _ = selectors.dispatch("none", basket, ds.features_of(basket), 2)
    assert names == ["All"]
    return finish(basket)


def _grid(spark, sf, methods) -> DataFrame:
    """Three views at three sizes, every selection a cut of one store of scores."""
    wide, parts = cleaned_parts(spark, sf, views=True)
    exprs: dict = {}
    for v in tb.VIEWS:
        for f, e in parts[v]:
            exprs.setdefault(f, e)
    rows = write_and_read(wide.select("row_id", *[e.alias(f) for f, e in exprs.items()], "DX"), "grid_rows")
    views = {v: [f for f, _ in parts[v]] for v in tb.VIEWS}
    return finish(selectors.cut_sizes(selectors.score_store(rows, views, methods), selectors.size_grid(views)))


@query("ranking_grid")
def q_ranking_grid(spark, sf):
    return _grid(spark, sf, ("ig", "univariate", "mrmr"))


@query("ranking_grid_all")
def q_ranking_grid_all(spark, sf):
    """The grid with all five selectors."""
    return _grid(spark, sf, selectors.SELECTORS)


@query("feature_rank_report")
def q_feature_rank_report(spark, sf):
    from foldwise.plans.experiment import load_configs, select_slots
    cfg = load_configs()["ORDERS_NB_IG"]
    views = cleaned_views(spark, sf)
    _, report = select_slots(cfg, views, seed=1, name="ORDERS_NB_IG")
    return finish(report)


# 2.9 resample / split / scale / weight ---------------------------------------------------------
@query("standard_scale")
def q_standard_scale(spark, sf):
    return finish(scaling.standard_scale(_customer_anova_input(spark, sf).drop("DX"), ["c_acctbal", "c_nationkey"]))


@query("stratified_folds")
def q_stratified_folds(spark, sf):
    return sampling.stratified_folds(order_labels(spark, sf), 3, 1).select("row_id", "DX", "fold")


@query("ordered_holdout")
def q_ordered_holdout(spark, sf):
    return sampling.ordered_holdout(order_labels(spark, sf), 0.33).select("row_id", "is_test")


@query("class_weights")
def q_class_weights(spark, sf):
    return finish(scaling.class_weights(tb.documents_toxic(spark, sf)))


SMOTE_FEATURES = ["n_chars", "n_spaces", "n_newlines"]


@query("smote")
def q_smote(spark, sf):
    d = tb.documents_toxic(spark, sf)
    return finish(sampling.smote(d, SMOTE_FEATURES, k=5, seed=3))


# 2.5 / 2.10 neighbours and classifiers --------------------------------------------------------
EMB64 = [f"e{i:02d}" for i in range(64)]
BOOST_ROUNDS = 100


@query("knn_join")
def q_knn_join(spark, sf):
    e = tb.embeddings_wide(spark, sf)
    return finish(knn_join(e, e, EMB64, 3, exclude_self=True))


def _emb_train_test(spark, sf):
    e = emb_split(spark, sf)
    return e.where("fold != 0"), e.where("fold = 0")


@query("knn_predict")
def q_knn_predict(spark, sf):
    train, test = _emb_train_test(spark, sf)
    s = models.knn_scores(train, test, EMB64, 2).withColumn("slot", F.lit(0))
    v = ensemble.soft_vote(s, 1, 10)
    return v.join(test.select("row_id", "DX"), "row_id").select("row_id", "DX", "pred")


@query("gaussian_nb")
def q_gaussian_nb(spark, sf):
    train, test = _emb_train_test(spark, sf)
    s = models.gaussian_nb(train, test, EMB64).withColumn("slot", F.lit(0))
    v = ensemble.soft_vote(s, 1, 10)
    return v.join(test.select("row_id", "DX"), "row_id").select("row_id", "DX", "pred")


@query("relieff")
def q_relieff(spark, sf):
    return finish(relieff(tb.embeddings_wide(spark, sf), EMB64, k=10))


@query("relieff_mixed")
def q_relieff_mixed(spark, sf):
    """Two continuous features, and two that are discrete by their number of values."""
    c = tb.table(spark, sf, "customer", ["c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment"])
    k = F.col("c_custkey")
    rows = c.select(k.alias("row_id"), F.col("c_acctbal").cast("double").alias("acctbal"), (k % 97).cast("double").alias("cycle"),
                    F.col("c_nationkey").cast("double").alias("nation"), (k % 3).cast("double").alias("third"),
                    label_encode("c_mktsegment", tb.SEGMENT_LABELS).alias("DX"))
    return finish(relieff(rows, ["acctbal", "cycle", "nation", "third"], k=10, discrete_threshold=30))


@query("rf_importance")
def q_rf_importance(spark, sf):
    r = selectors.rank_scores(models.rf_importance(tb.embeddings_wide(spark, sf), EMB64, seed=1))
    return r.select("rank", "feature", "position", "score")


@query("forest_splits")
def q_forest_splits(spark, sf):
    """The splits of the two upper levels of six trees."""
    s = forest.extra_trees(tb.embeddings_wide(spark, sf), EMB64, seed=1, num_trees=6, max_depth=2)
    return finish(s.select("tree", "node", F.get(F.array(*[F.lit(f) for f in EMB64]), "feature").alias("feature"), "cut", "n", "decrease"))


@query("pca_project")
def q_pca_project(spark, sf):
    out, ratios = projection.pca_project(tb.embeddings_wide(spark, sf), EMB64, 3)
    return out.withColumn("explained", F.array(*[F.lit(r) for r in ratios]))


@query("lda_project")
def q_lda_project(spark, sf):
    out, ratios = projection.lda_project(tb.embeddings_wide(spark, sf), EMB64, 3)
    return out.withColumn("explained", F.array(*[F.lit(r) for r in ratios]))


@query("gmm_components")
def q_gmm_components(spark, sf):
    """Every size from 1 to the number of features, on all features."""
    return projection.gmm_components(tb.embeddings_wide(spark, sf), EMB64, seed=1)


@query("gmm_single")
def q_gmm_single(spark, sf):
    """The closed-form size: one Gaussian of the documents' text counts."""
    docs = tb.documents_toxic(spark, sf).select(*[F.log1p(f).alias(f) for f in SMOTE_FEATURES])
    return finish(projection.gmm_components(docs, SMOTE_FEATURES, max_k=1, ridge=0.0), 3)


@query("boosted_trees")
def q_boosted_trees(spark, sf):
    train, test = _emb_train_test(spark, sf)
    return models.boosted_trees(train, test, EMB64, rounds=BOOST_ROUNDS)


@query("boosted_stumps")
def q_boosted_stumps(spark, sf):
    """Every split and leaf of two rounds of depth 1."""
    train = _emb_train_test(spark, sf)[0].withColumn("fit", F.lit(0))
    grown = boosting.fit_boosted(train, EMB64, 10, rounds=2, depth=1)
    return finish(boosting.split_table(spark, grown, EMB64).select("round", "class", "feature", "cut", "left", "right"))


@query("mlp_classifier")
def q_mlp_classifier(spark, sf):
    train, test = _emb_train_test(spark, sf)
    return models.mlp_classifier(train, test, EMB64, 10, layers=[["64", "tanh"], ["64", "tanh"], ["10", "softmax"]],
                                 dropouts=["0", "0.1", "0"], epochs=40, seed=1)


@query("rbf_svc")
def q_rbf_svc(spark, sf):
    train, test = _emb_train_test(spark, sf)
    return models.rbf_svc(train, test, EMB64, seed=1)


@query("train_slots")
def q_train_slots(spark, sf):
    from foldwise.plans.experiment import slot_scores
    e = emb_split(spark, sf)
    train, test = e.where("fold != 0"), e.where("fold = 0")
    a = slot_scores("knn_1", train, test, EMB64[:32], 10, {})
    b = slot_scores("nb_1", train, test, EMB64[32:], 10, {})
    return finish(a.withColumn("slot", F.lit(0)).unionByName(b.withColumn("slot", F.lit(1))))


# 2.6 / 2.7 / 2.11 ensemble and metrics --------------------------------------------------------
@query("one_hot")
def q_one_hot(spark, sf):
    return metrics.one_hot(order_labels(spark, sf), "DX", 5)


@query("label_inverse")
def q_label_inverse(spark, sf):
    o = tb.table(spark, sf, "orders", ["o_orderkey", "o_orderpriority"]).withColumnRenamed("o_orderkey", "row_id")
    enc = ensemble.fit_label_index(o, "o_orderpriority")
    idx = enc.transform(o).select("row_id", F.col("o_orderpriority_idx").cast("int").alias("idx"))
    back = ensemble.label_inverse(idx, "idx", enc, "label")
    return back.select("row_id", F.col("idx").cast("int").alias("idx"), "label")


@query("soft_vote")
def q_soft_vote(spark, sf):
    o = order_labels(spark, sf).select("row_id")
    s = (o.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(2))))
         .withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(4))))
         .withColumn("p", F.floor(md5_uniform(5, F.col("slot"), F.col("row_id"), F.col("class")) * 4) / 4.0))
    return finish(ensemble.soft_vote(s, 3, 5))


@query("confusion_matrix")
def q_confusion_matrix(spark, sf):
    return metrics.confusion_matrix(md5_predictions(spark, sf), ["fold"])


@query("accuracy")
def q_accuracy(spark, sf):
    return finish(metrics.accuracy(md5_predictions(spark, sf), ["fold"]))


@query("auc_micro")
def q_auc_micro(spark, sf):
    return finish(metrics.auc_micro(metrics.flat_pairs(md5_predictions(spark, sf), 5, ["fold"]), ["fold"]))


@query("auc_micro_soft")
def q_auc_micro_soft(spark, sf):
    """Ungrouped, with soft scores: four values of a draw, one of them on a threshold."""
    x = order_labels(spark, sf).select("row_id", "DX", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("class"))
    y = (F.col("DX") == F.col("class")).cast("double")
    p = F.floor(md5_uniform(9, F.col("row_id"), F.col("class")) * 3 + y) / 3.0
    return finish(metrics.auc_micro(x.select(y.alias("y"), p.alias("p"))))


@query("class_rates")
def q_class_rates(spark, sf):
    cm = metrics.confusion_matrix(md5_predictions(spark, sf), ["fold"])
    return finish(metrics.class_rates(cm, ["fold"]))


@query("fold_average")
def q_fold_average(spark, sf):
    m = metrics.fold_metrics(md5_predictions(spark, sf), 5)
    return finish(metrics.fold_average(m))


@query("boxplot_stats")
def q_boxplot_stats(spark, sf):
    m = _metric_runs(spark, sf, repetitions=(1,)).where(F.col("metric").isin("accuracy", "auc"))
    return finish(metrics.boxplot_stats(m, ["config", "metric"]))


@query("metric_scatter")
def q_metric_scatter(spark, sf):
    m = _metric_runs(spark, sf, repetitions=(1,))
    return finish(metrics.metric_scatter(metrics.fold_average(m, ["config"]), [f"noise_{lv}" for lv in NOISE_LEVELS]))


@query("order_ig_top3")
def q_order_ig_top3(spark, sf):
    """Flagship slice: orders LEFT JOIN lines and customers -> label codes -> cleaning rules
    -> information gain of the buyer view -> top 3."""
    buyer = cleaned_views(spark, sf)["buyer"]
    r = selectors.top_n(selectors.info_gain(buyer, ds.features_of(buyer)), 3)
    return finish(r.select("rank", "feature", "score"))


# orchestration (rows-only checks) ------------------------------------------------------------
@query("cross_validate")
def q_cross_validate(spark, sf):
    from foldwise.plans.experiment import load_configs, run_experiment
    cfg = load_configs()["EMB_KNN_NB"]
    m = run_experiment("EMB_KNN_NB", cfg, {"emb_a": tb.embeddings_wide(spark, sf, 32, 0),
                                           "emb_b": tb.embeddings_wide(spark, sf, 32, 32)}, seed=1)[0]
    return finish(m)


@query("experiment_run")
def q_experiment_run(spark, sf):
    from foldwise.plans.experiment import load_configs, run_all
    cfgs = load_configs()
    views = materialized_views(spark, sf)
    return run_all({k: cfgs[k] for k in ("ORDERS_NB_IG", "ORDERS_FULL_NB")}, views, seed=1)


def _docs(spark, sf) -> dict[str, DataFrame]:
    return {"docs": write_and_read(tb.documents_toxic(spark, sf), "documents_toxic")}


@query("experiment_all_slots")
def q_experiment_all_slots(spark, sf):
    """Five slots of five families behind five selectors, voting together."""
    from foldwise.plans.experiment import load_configs, run_all
    return run_all({"DOCS_ALL_SLOTS": load_configs()["DOCS_ALL_SLOTS"]}, _docs(spark, sf), seed=1)


@query("experiment_hold_out")
def q_experiment_hold_out(spark, sf):
    from foldwise.plans.experiment import load_configs, run_all
    return run_all({"DOCS_HOLD_OUT": load_configs()["DOCS_HOLD_OUT"]}, _docs(spark, sf), seed=1)


@query("pca_axes")
def q_pca_axes(spark, sf):
    """All axes: their variances add up to the number of features, and they do not correlate."""
    out, _ = projection.pca_project(tb.embeddings_wide(spark, sf), EMB64, 64)
    total = sum((F.var_pop(f"pc{i}") for i in range(64)), F.lit(0.0))
    largest = F.greatest(*[F.abs(F.covar_pop(f"pc{i}", f"pc{i + 1}")) for i in range(63)])
    return finish(out.agg(F.count(F.lit(1)).alias("n_rows"), total.alias("total_variance"), largest.alias("largest_covariance")))


@query("lda_axes")
def q_lda_axes(spark, sf):
    """The discriminant axes do not correlate within classes."""
    out, _ = projection.lda_project(tb.embeddings_wide(spark, sf), EMB64, 9)
    by = out.groupBy("DX").agg(F.count(F.lit(1)).alias("n"), *[F.covar_pop("ld0", f"ld{i}").alias(f"c{i}") for i in range(1, 9)],
                               *[F.var_pop(f"ld{i}").alias(f"v{i}") for i in range(9)])
    pooled = F.greatest(*[F.abs(F.sum(F.col(f"c{i}") * F.col("n"))) / F.sqrt(F.sum(F.col("v0") * F.col("n")) * F.sum(F.col(f"v{i}") * F.col("n")))
                          for i in range(1, 9)])
    return finish(by.agg(F.sum("n").cast("bigint").alias("n_rows"), pooled.alias("largest_correlation")))


@query("repeat_experiments")
def q_repeat_experiments(spark, sf):
    from foldwise.plans.experiment import load_configs, repeat
    cfgs = {"EMB_KNN_NB": load_configs()["EMB_KNN_NB"]}
    data = {"emb_a": write_and_read(tb.embeddings_wide(spark, sf, 32, 0), "emb_a"),
            "emb_b": write_and_read(tb.embeddings_wide(spark, sf, 32, 32), "emb_b")}
    return finish(repeat(cfgs, data))
