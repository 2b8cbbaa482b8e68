"""Column-level helpers (JVM-side expressions only)."""

from foldwise.functions.lenient import (lenient_cast, lenient_double, null_tokens_expr,
                                        regex_replace_expr, safe_ratio)
from foldwise.functions.hashing import md5_uniform, md5_u32

__all__ = ["lenient_cast", "lenient_double", "null_tokens_expr", "regex_replace_expr",
           "safe_ratio", "md5_uniform", "md5_u32"]
