"""Long layout: one row per (row, feature). Turns per-feature loops into one groupBy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(df: DataFrame, features: list[str], key: str = "row_id", label: str | None = "DX",
            value_type: str = "double") -> DataFrame:
    ids = [key] + ([label] if label else [])
    casted = df.select(*ids, *[F.col(f"`{f}`").cast(value_type).alias(f) for f in features])
    return casted.unpivot(ids, features, "feature", "value")


def feature_positions(features: list[str]):
    """Column expression mapping a feature name to its 0-based position in ``features``."""
    return (F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature")) - 1).cast("int")
