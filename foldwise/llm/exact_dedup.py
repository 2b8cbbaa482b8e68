"""Exact deduplication by content sort (operator 2), DataFrame functions only.

Rows are range-partitioned by the first characters of their normalised text and a hash of it,
with splitters that Spark samples; each partition is sorted down to the whole text (on disk
where memory is short), so equal texts become neighbours, and the window that follows compares
neighbouring texts in full. It needs no further exchange.

A text with more copies than half a partition's fair share of rows is hot. Its rows get a
salt, so that the splitters deal them over several partitions; the parts of a hot text are
then brought together by one row per part. There are fewer than 2 x partitions hot texts, and
fewer than 4 x partitions parts, which bounds the tables that are broadcast.

Defined results: a null text equals an empty one; a null doc_id is smaller than any other;
rows that agree in text and doc_id are copies of which one stays; other columns ride along
untouched, whatever their names; an empty table gives an empty result; texts of any length
are compared whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width, written

_ROW, _TEXT, _ID, _SALT, _HEAD = "__row", "__text", "__id", "__salt", "__head"
#: Characters of a text that its splitters see; texts that agree in them are dealt by a hash.
HEAD_CHARS = 32


def _hot_texts(rows: DataFrame, parts: int) -> DataFrame:
    """(hash, salts) of texts with more copies than half a partition's share of rows."""
    share = max(1, -(-rows.count() // (2 * parts)))
    counts = rows.groupBy(F.xxhash64(_TEXT).alias("__h")).agg(F.count("*").alias("__n"))
    return counts.where(F.col("__n") > share).select("__h", F.ceil(F.col("__n") / F.lit(share)).cast("int").alias("__salts"))


def _decide(df: DataFrame, id_col: str, text_col: str, normalise, keep: str, whole_rows: bool) -> DataFrame:
    parts = shuffle_width(df.sparkSession)
    text: Column = F.coalesce(df[text_col].cast("string"), F.lit(""))
    carried = [F.struct(*[df[c] for c in df.columns]).alias(_ROW)] if whole_rows else []
    if whole_rows and normalise is None:  # the compared text is the carried one: shuffle it once
        others = [df[c] for c in df.columns if c != text_col]
        carried = [F.struct(df[text_col].isNull().alias("null_text"), *others).alias(_ROW)]
    rows = df.select(*carried, (normalise(text) if normalise else text).alias(_TEXT), df[id_col].cast("long").alias(_ID))
    hot = F.broadcast(_hot_texts(rows, parts))  # fewer than 2 x partitions rows
    # with the input partition, so that copies with one id (or none) are dealt out, too
    salt = F.coalesce(F.pmod(F.xxhash64(_ID, F.spark_partition_id()), F.col("__salts")), F.lit(0)).cast("int")
    rows = (rows.join(hot, F.xxhash64(_TEXT) == F.col("__h"), "left")
            .withColumn(_SALT, salt).withColumn("__hot", F.col("__h").isNotNull()).drop("__h", "__salts"))
    # short keys: splitters are drawn from samples that the driver holds
    rows = rows.withColumn(_HEAD, F.substring(F.col(_TEXT), 1, HEAD_CHARS)).withColumn("__hash", F.xxhash64(_TEXT))
    rows = rows.repartitionByRange(_HEAD, "__hash", _SALT)
    first = F.col(_ID).desc_nulls_last() if keep == "largest" else F.col(_ID).asc_nulls_last()
    same = Window.partitionBy(_HEAD, "__hash", _SALT, _TEXT).orderBy(first)
    every = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = (rows.withColumn("__nth", F.row_number().over(same)).withColumn("__keep", F.first(_ID).over(every))
            .withColumn("__size", F.count(F.lit(1)).over(every)).withColumn("__sha", F.sha2(_TEXT, 256))
            .drop(_HEAD, "__hash"))
    if not (whole_rows and normalise is None):
        rows = rows.drop(_TEXT)
    rows = written(rows, "copies")
    # the parts of a hot text meet: one row for each, fewer than 4 x partitions
    lead = F.struct(F.col("__keep").isNotNull().alias("known"),
                    (F.col("__keep") if keep == "largest" else F.bitwise_not("__keep")).alias("order"), F.col(_SALT).alias("part"))
    parts_of = (rows.where("__hot and __nth = 1").groupBy(F.col("__sha").alias("__hot_sha"))
                .agg(F.max(F.struct(lead.alias("lead"), F.col("__keep").alias("keep"))).alias("__best"),
                     F.sum("__size").alias("__whole")))
    rows = rows.join(F.broadcast(parts_of), F.col("__hot") & (F.col("__sha") == F.col("__hot_sha")), "left")
    is_lead = F.coalesce(F.col("__best.lead.part") == F.col(_SALT), F.lit(True))
    return (rows.withColumn("__stays", (F.col("__nth") == 1) & is_lead)
            .withColumn("__keep", F.when(F.col("__best").isNotNull(), F.col("__best.keep")).otherwise(F.col("__keep")))
            .withColumn("__size", F.coalesce("__whole", "__size")))


def group_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None,
                 keep: str = "largest") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row.

    `normalise` maps the text column to the compared one (default: no change); `keep` names
    the doc_id that stays, "largest" or "smallest".
    """
    return _decide(df, id_col, text_col, normalise, keep, False).select(
        F.col(_ID).alias("doc_id"), F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"),
        F.col("__stays").alias("kept"), F.col("__sha").alias("text_sha256"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None,
                keep: str = "largest") -> DataFrame:
    """The rows that stay, with their own columns; texts and other columns move once."""
    rows = _decide(df, id_col, text_col, normalise, keep, True).where("__stays")
    if normalise is not None:
        return rows.select(*[F.col(_ROW)[c].alias(c) for c in df.columns])
    text = F.when(~F.col(_ROW)["null_text"], F.col(_TEXT)).cast(df.schema[text_col].dataType)
    return rows.select(*[text.alias(c) if c == text_col else F.col(_ROW)[c].alias(c) for c in df.columns])
