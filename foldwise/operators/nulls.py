"""One policy for rows whose features are NULL, shared by every operator that needs them all.

"error" (the default everywhere) fails when such a row is read, naming the operator; "drop"
leaves the rows out. Nothing is left out unless the caller says so. The check is an
expression on the first feature, so it costs no job of its own and cannot be pruned away
while any feature is used.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POLICIES = ("error", "drop")


def complete_features(df: DataFrame, features: list[str], what: str, nulls: str = "error") -> DataFrame:
    """``df`` with complete features, by policy. Column order is kept."""
    if nulls not in POLICIES:
        raise ValueError(f"nulls must be one of {POLICIES}, got {nulls!r}")
    if not features:
        return df
    if nulls == "drop":
        return df.dropna(subset=list(features))
    missing = reduce(or_, [F.col(f"`{f}`").isNull() for f in features])
    message = F.lit(f"{what}: a row has a NULL feature; impute it, or pass nulls='drop'")
    first = features[0]
    checked = F.when(missing, F.raise_error(message).cast(df.schema[first].dataType)).otherwise(F.col(f"`{first}`"))
    return df.select(*[checked.alias(c) if c == first else F.col(f"`{c}`") for c in df.columns])
