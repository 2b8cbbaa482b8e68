"""ANSI-safe re-statements of the lenient (non-ANSI) cast and arithmetic rules.

The cleaning rules were written for Spark's lenient mode, where an uncastable string, a
division by zero, or a string compared with a number yields NULL or a string comparison
instead of an error. Spark 4 runs with ANSI on; these helpers write the lenient behaviour
explicitly with ``try_cast``/``try_divide`` so that ANSI can stay on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)

TYPE_NAMES = {
    "float": T.FloatType(), "double": T.DoubleType(), "integer": T.IntegerType(),
    "int": T.IntegerType(), "long": T.LongType(), "bigint": T.LongType(),
    "string": T.StringType(), "short": T.ShortType(), "byte": T.ByteType(),
}


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC)


def lenient_double(e: Column, dt: T.DataType) -> Column:
    """Value as double; strings that do not parse become NULL."""
    if isinstance(dt, T.DoubleType):
        return e
    if isinstance(dt, T.StringType):
        return e.try_cast("double")
    return e.cast("double")


def lenient_cast(e: Column, src: T.DataType, target: str | T.DataType) -> tuple[Column, T.DataType]:
    """Cast with lenient semantics; returns (expression, result type).

    string -> integral goes through double and truncates toward zero ('0.56' -> 0), which is
    what the lenient string-to-int parse does for decimal text; uncastable text -> NULL.
    """
    dt = TYPE_NAMES[target.lower()] if isinstance(target, str) else target
    if isinstance(dt, T.StringType):
        return e.cast("string"), dt
    if isinstance(src, T.StringType) and isinstance(dt, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return e.try_cast("double").try_cast(dt), dt
    if isinstance(src, T.StringType):
        return e.try_cast(dt), dt
    return e.try_cast(dt), dt


def null_tokens_expr(e: Column, dt: T.DataType, tokens) -> Column:
    """value IN tokens -> NULL, compared as strings (an int -4 matches '-4', a double -4.0
    does not, since it reads '-4.0')."""
    probe = e if isinstance(dt, T.StringType) else e.cast("string")
    return F.when(probe.isin([str(t) for t in tokens]), F.lit(None).cast(dt)).otherwise(e)


def regex_replace_expr(e: Column, dt: T.DataType, pattern: str, replacement: str) -> Column:
    """Substring regex replace; non-string input is read as its string form."""
    src = e if isinstance(dt, T.StringType) else e.cast("string")
    return F.regexp_replace(src, F.lit(pattern), F.lit(replacement))


def safe_ratio(num: Column, num_dt: T.DataType, den: Column, den_dt: T.DataType) -> Column:
    """num / den as double; division by zero or NULL -> NULL."""
    return F.try_divide(lenient_double(num, num_dt), lenient_double(den, den_dt))
