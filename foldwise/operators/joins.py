"""Keyed enrichment joins and row alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_columns(df: DataFrame, *cols: str) -> DataFrame:
    """Drop columns; a missing name is a no-op."""
    return df.drop(*cols)


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def left_join_enrich(base: DataFrame, enrichments: list[tuple[DataFrame, list[str] | dict[str, str]]]) -> DataFrame:
    """Chain LEFT equi-joins onto ``base``.

    Each enrichment is (table, keys). ``keys`` is a list of shared column names (USING join,
    the key appears once) or a {base_col: table_col} map (the table's key column is dropped).
    Unmatched rows get NULLs; duplicate right keys multiply rows, as in SQL. The physical
    strategy (broadcast vs sort-merge, skew splits) is left to AQE, which sees real sizes.
    """
    out = base
    for table, keys in enrichments:
        if isinstance(keys, dict):
            cond = [out[b] == table[t] for b, t in keys.items()]
            out = out.join(table, cond, "left").drop(*[table[t] for t in keys.values()])
        else:
            out = out.join(table, on=list(keys), how="left")
    return out


def label_encode(col: Column | str, labels: list[str]) -> Column:
    """labels[i] -> i, anything else -> NULL (a CASE chain)."""
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for i, lab in enumerate(labels):
        expr = F.when(c == lab, F.lit(i)) if expr is None else expr.when(c == lab, F.lit(i))
    return expr


def align_by_row(frames: list[DataFrame], key: str = "row_id", label: str = "DX") -> DataFrame:
    """Column-wise concatenation of datasets that describe the same rows: an inner join on the
    key, with the label taken from the first frame only (the positional concat, made keyed)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f.drop(label), on=key, how="inner")
    return out
