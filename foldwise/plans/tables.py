"""The driver tables seen through the experiment data model.

entity rows  = orders (row_id = o_orderkey), label DX = o_orderpriority coded 0..4
enrichments  = per-order line aggregates (LEFT join on the order key) and customers with
               dirty text columns (LEFT join on the customer key)
catalog      = (Feature, Grouping) for three modalities: order, customer, lines
vectors      = embeddings (64 dims, 10 classes), used long (row_id, DX, feature, value)
imbalanced   = documents joined to labels.toxic, with text-derived counts
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.operators.joins import label_encode, left_join_enrich
from foldwise.sources.catalog import driver_catalog, feature_catalog, union_catalogs

CONF_DIR = os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "conf")

# Order priorities in label-code order 0..4.
PRIORITY_LABELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
# Customer market segments in label-code order 0..4.
SEGMENT_LABELS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

# The two feature catalogs (Feature, Grouping); o_totalprice is listed in both.
CATALOG_ORDER_SIDE = [
    ("o_totalprice", "Order"), ("o_orderstatus", "Order"), ("order_year", "Order"),
    ("acctbal_txt", "Customer Account"), ("acctbal", "Customer Account"),
    ("nation_code", "Customer Profile"), ("segment_txt", "Customer Profile"),
]
CATALOG_LINE_SIDE = [
    ("n_lines", "Line Items"), ("sum_qty", "Line Items"), ("avg_disc", "Line Items"),
    ("avg_tax", "Line Items"), ("max_linenumber", "Line Items"), ("o_totalprice", "Order"),
]
MODALITIES = {
    "order": ["Order"],
    "customer": ["Customer Account", "Customer Profile"],
    "lines": ["Line Items"],
}
VIEWS = {"full": ["order", "customer", "lines"], "buyer": ["order", "customer"], "basket": ["lines", "order"]}


def table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    return driver_catalog(sf_dir).read(spark, name, columns)


def orders_src(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                           "o_orderdate", "o_orderpriority"])


def customer_raw(spark, sf_dir) -> DataFrame:
    """Customers with text columns as a loosely typed export would hold them: censored values
    ('>9000'), sentinel codes (-4), the token 'None', and real NULLs."""
    c = table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    k = F.col("c_custkey")
    return c.select(
        "c_custkey", "c_name",
        F.when(k % 17 == 0, F.lit("None")).when(F.col("c_acctbal") > 9000, F.lit(">9000"))
         .when(F.col("c_acctbal") < 0, F.lit("-4"))
         .otherwise(F.floor("c_acctbal").cast("string")).alias("acctbal_txt"),
        F.when(k % 11 == 0, F.lit(-4)).otherwise(F.col("c_nationkey")).cast("int").alias("nation_code"),
        F.when(k % 19 == 0, F.lit(-4.0)).when(k % 23 == 0, F.lit(None))
         .otherwise(F.col("c_acctbal")).cast("double").alias("acctbal"),
        F.when(k % 13 == 0, F.lit(None)).when(k % 29 == 0, F.lit("None"))
         .otherwise(F.col("c_mktsegment")).alias("segment_txt"),
        "c_mktsegment",
    )


def line_agg(spark, sf_dir) -> DataFrame:
    """Per-order line aggregates (map-side partial aggregation, one shuffle on the order key)."""
    li = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"])
    return li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("l_quantity").alias("sum_qty"),
        F.avg(F.col("l_discount") + 0.0).alias("avg_disc"),
        F.avg(F.col("l_tax") + 0.0).alias("avg_tax"),
        F.max("l_linenumber").alias("max_linenumber"),
    )


def order_table(spark, sf_dir) -> DataFrame:
    """Entity rows LEFT-joined to their enrichments, label coded; keeps ``row_id``."""
    o = orders_src(spark, sf_dir).withColumnsRenamed({"o_orderkey": "row_id"})
    o = o.withColumn("order_year", F.year("o_orderdate"))
    wide = left_join_enrich(o, [
        (line_agg(spark, sf_dir), {"row_id": "l_orderkey"}),
        (customer_raw(spark, sf_dir).drop("c_mktsegment"), {"o_custkey": "c_custkey"}),
    ])
    return wide.withColumn("DX", label_encode("o_orderpriority", PRIORITY_LABELS)).drop("o_orderpriority")


def catalogs(spark) -> tuple[DataFrame, DataFrame]:
    return feature_catalog(spark, CATALOG_ORDER_SIDE), feature_catalog(spark, CATALOG_LINE_SIDE)


def full_catalog(spark) -> DataFrame:
    return union_catalogs(*catalogs(spark))


def rule_groups() -> dict:
    from foldwise.operators.rules import load_rules
    return load_rules(os.path.join(CONF_DIR, "order_rules.yml"))


def preclean_rules() -> dict:
    from foldwise.operators.rules import load_rules
    return load_rules(os.path.join(CONF_DIR, "customer_preclean.yml"))


def customer_dataset(spark, sf_dir) -> DataFrame:
    """Customer rows for the cleaning queries: row_id = c_custkey, DX = segment code."""
    c = customer_raw(spark, sf_dir)
    return (c.withColumnRenamed("c_custkey", "row_id")
            .withColumn("DX", label_encode("c_mktsegment", SEGMENT_LABELS)).drop("c_mktsegment"))


def embeddings_long(spark, sf_dir, dims: int | None = None) -> DataFrame:
    """(row_id, DX, feature, value): one row per vector component, feature = 'e00'..'e63'."""
    e = table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    out = e.select(F.col("vec_id").alias("row_id"), F.col("label").alias("DX"),
                   F.posexplode("embedding").alias("pos", "v"))
    if dims is not None:
        out = out.filter(F.col("pos") < dims)
    return out.select("row_id", "DX", F.format_string("e%02d", "pos").alias("feature"),
                      F.col("v").cast("double").alias("value"))


def embeddings_wide(spark, sf_dir, dims: int = 64, start: int = 0) -> DataFrame:
    """(row_id, e{start}..e{start+dims-1}, DX) as double columns."""
    e = table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    return e.select(F.col("vec_id").alias("row_id"),
                    *[F.col("embedding")[i].cast("double").alias(f"e{i:02d}") for i in range(start, start + dims)],
                    F.col("label").alias("DX"))


def documents_toxic(spark, sf_dir) -> DataFrame:
    """Labelled documents with whole-text counts: (row_id, n_chars, n_spaces, n_newlines, DX)."""
    d = table(spark, sf_dir, "documents", ["doc_id", "text", "n_chars"])
    lab = table(spark, sf_dir, "labels", ["doc_id", "toxic"])
    j = d.join(lab, "doc_id", "inner")
    t = F.col("text")
    return j.select(
        F.col("doc_id").alias("row_id"),
        F.col("n_chars").cast("double").alias("n_chars"),
        (F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))).cast("double").alias("n_spaces"),
        (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).cast("double").alias("n_newlines"),
        F.col("toxic").cast("int").alias("DX"),
    )
