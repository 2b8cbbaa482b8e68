"""Portable pseudo-random draws: md5 of a seed and key parts.

md5 is computed the same way by Spark and by ANSI engines, so every draw here can be
reproduced in SQL: ``u32 = int(first 8 hex digits of md5(seed|k1|k2...))`` and
``u = u32 / 2^32`` in [0, 1).
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _key(seed, *parts) -> Column:
    cols = [seed if isinstance(seed, Column) else F.lit(str(seed))]
    for p in parts:
        cols.append(p if isinstance(p, Column) else F.lit(str(p)))
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def md5_u32(seed, *parts) -> Column:
    """Unsigned 32-bit integer from the first 8 hex digits of md5(seed|parts)."""
    return F.conv(F.substring(F.md5(_key(seed, *parts)), 1, 8), 16, 10).cast("bigint")


def md5_uniform(seed, *parts) -> Column:
    """Uniform double in [0, 1) from md5(seed|parts)."""
    return md5_u32(seed, *parts) / F.lit(TWO_32)


def md5_hex(seed, *parts) -> Column:
    """The hex digits whose first 8 :func:`md5_u32` reads; they compare as text like the draws they stand for."""
    return F.md5(_key(seed, *parts))


def hex_of(share: float) -> str:
    """The least first 8 digits of a draw of at least ``share``: md5_uniform(...) < share where md5_hex(...) < hex_of(share)."""
    least = math.ceil(Fraction(share) * 2 ** 32)
    return f"{least:08x}" if least < 2 ** 32 else "g"  # all digits are below it


def sql_u32(seed, *parts: str) -> str:
    """The same draw as DuckDB SQL text (used by oracle queries and tests)."""
    inner = " || '|' || ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"CAST(('0x' || substr(md5({inner}), 1, 8)) AS BIGINT)"
