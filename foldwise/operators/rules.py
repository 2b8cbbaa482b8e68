"""Declarative cleaning rules compiled to one projection per dataset.

A rule file maps feature -> {drop, nullVals, nullHandling, replaceVals, fieldType,
normalizeOtherFt}. Rules run in file order and, per feature, in the order drop -> null tokens
-> null handling -> replace -> cast -> ratio. A step whose key is absent, or whose column is
missing, is skipped. Column names resolve case-insensitively, and a step that rewrites a column
renames it to the rule's spelling.

Instead of one Spark job per imputed feature, the program is *fitted*: all column means of a
stage are computed by one aggregate (a stage ends where a ``remove`` filter changes the rows
that later means must see), then the whole program is applied as a single ``select`` with the
means as literals. The fitted means are a bounded, one-row result (one number per imputed
feature) — the same thing ``pyspark.ml.feature.Imputer`` keeps.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field
from functools import reduce
from typing import Callable

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.functions.lenient import (lenient_cast, lenient_double, null_tokens_expr,
                                        regex_replace_expr, safe_ratio)

Builder = Callable[[dict], Column]


def load_rules(path_or_text: str) -> dict:
    """Read a YAML rule file (group -> feature -> rule) keeping file order."""
    if "\n" in path_or_text or ":" in path_or_text and not path_or_text.endswith((".yml", ".yaml")):
        return yaml.safe_load(path_or_text)
    with open(path_or_text) as fh:
        return yaml.safe_load(fh)


@dataclass
class _Col:
    name: str
    build: Builder
    dtype: T.DataType
    deps: frozenset = field(default_factory=frozenset)


def _is_true(v) -> bool:
    return v is True or (isinstance(v, str) and v == "true")


class RuleProgram:
    """Compile ``rules`` against ``df``; ``result()`` returns the cleaned DataFrame.

    null_key: when True a replacement whose pattern is the word 'null' fills NULLs with the
    replacement; when False 'null' is an ordinary regex (the second rule dialect).
    """

    def __init__(self, df: DataFrame, rules: dict, null_key: bool = True):
        self.df = df
        self.rules = rules or {}
        self.null_key = null_key
        self.cols: list[_Col] = [
            _Col(f.name, (lambda m, n=f.name: F.col(f"`{n}`")), f.dataType) for f in df.schema.fields
        ]
        self.filters: list[Builder] = []
        self.means: dict[int, tuple] = {}
        self.pending: dict[int, tuple[Builder, T.DataType]] = {}
        self.aggregate_jobs = 0
        self._ids = itertools.count()
        self._compile()

    # -- helpers ---------------------------------------------------------------------------
    def _find(self, name: str) -> _Col | None:
        hits = [c for c in self.cols if c.name.lower() == name.lower()]
        return hits[0] if len(hits) == 1 else None

    def _flush(self) -> None:
        """Compute every pending mean with one aggregate over the rows as filtered so far."""
        if not self.pending:
            return
        aggs = []
        for pid, (build, dt) in self.pending.items():
            mean = F.avg(lenient_double(build(self.means), dt))
            aggs += [mean.alias(f"m{pid}"), mean.cast("string").alias(f"s{pid}")]
        row = self._filtered().agg(*aggs).collect()[0]
        self.aggregate_jobs += 1
        for pid in self.pending:
            self.means[pid] = (row[f"m{pid}"], row[f"s{pid}"])
        self.pending = {}

    def _filtered(self) -> DataFrame:
        if not self.filters:
            return self.df
        return self.df.where(reduce(lambda a, b: a & b, [f(self.means) for f in self.filters]))

    # -- compilation -----------------------------------------------------------------------
    def _compile(self) -> None:
        for feature, rule in self.rules.items():
            rule = rule or {}
            col = self._find(feature)
            if _is_true(rule.get("drop")):
                if col is not None:
                    self.cols.remove(col)
                continue
            if col is None:
                continue
            self._feature(feature, rule, col)

    def _feature(self, feature: str, rule: dict, col: _Col) -> None:
        touched = False
        if "nullVals" in rule and rule["nullVals"] is not None:
            prev, dt, tokens = col.build, col.dtype, list(rule["nullVals"])
            col.build = lambda m, prev=prev, dt=dt: null_tokens_expr(prev(m), dt, tokens)
            touched = True
        handling = rule.get("nullHandling")
        if handling == "remove":
            self._flush()  # means registered so far are taken before this filter
            b = col.build
            self.filters.append(lambda m, b=b: b(m).isNotNull())
        elif handling == "mean_imputation":
            if col.deps & set(self.pending):
                self._flush()
            pid = next(self._ids)
            prev, dt = col.build, col.dtype
            self.pending[pid] = (prev, dt)
            if isinstance(dt, T.StringType):
                col.build = lambda m, prev=prev, pid=pid: (
                    prev(m) if m[pid][1] is None else F.coalesce(prev(m), F.lit(m[pid][1])))
                col.dtype = T.StringType()
            elif isinstance(dt, (T.NumericType,)):
                col.build = lambda m, prev=prev, pid=pid: (
                    prev(m) if m[pid][0] is None
                    else F.coalesce(prev(m).cast("double"), F.lit(float(m[pid][0]))))
                col.dtype = T.DoubleType()
            col.deps = col.deps | {pid}
            touched = True
        if rule.get("replaceVals"):
            for pat, repl in rule["replaceVals"]:
                prev, dt = col.build, col.dtype
                if self.null_key and pat == "null":
                    if isinstance(dt, T.StringType):
                        col.build = lambda m, prev=prev, r=str(repl): F.coalesce(prev(m), F.lit(r))
                    else:
                        col.build = lambda m, prev=prev, r=str(repl): F.coalesce(prev(m).cast("string"), F.lit(r))
                else:
                    col.build = lambda m, prev=prev, dt=dt, p=str(pat), r=str(repl): regex_replace_expr(prev(m), dt, p, r)
                col.dtype = T.StringType()
            touched = True
        if rule.get("fieldType"):
            prev, dt = col.build, col.dtype
            _, new_dt = lenient_cast(F.lit(None), dt, rule["fieldType"])
            col.build = lambda m, prev=prev, dt=dt, t=rule["fieldType"]: lenient_cast(prev(m), dt, t)[0]
            col.dtype = new_dt
            touched = True
        other_name = rule.get("normalizeOtherFt")
        if other_name:
            other = self._find(other_name)
            if other is not None:
                prev, dt = col.build, col.dtype
                ob, odt = other.build, other.dtype
                col.build = lambda m, prev=prev, dt=dt, ob=ob, odt=odt: safe_ratio(prev(m), dt, ob(m), odt)
                col.dtype = T.DoubleType()
                col.deps = col.deps | other.deps
                touched = True
        if touched:
            col.name = feature

    # -- output ----------------------------------------------------------------------------
    def exprs(self, exclude=()) -> list[Column]:
        """The fitted program as named column expressions over the input DataFrame."""
        self._flush()
        return [c.build(self.means).alias(c.name) for c in self.cols if c.name not in exclude]

    def named_exprs(self, exclude=()) -> list[tuple[str, Column]]:
        """(output name, expression) pairs, unaliased, for composing into other projections."""
        self._flush()
        return [(c.name, c.build(self.means)) for c in self.cols if c.name not in exclude]

    @property
    def has_filters(self) -> bool:
        return bool(self.filters)

    def row_filter(self) -> Column | None:
        self._flush()
        if not self.filters:
            return None
        return reduce(lambda a, b: a & b, [f(self.means) for f in self.filters])

    def result(self) -> DataFrame:
        exprs = self.exprs()
        return self._filtered().select(*exprs)


def fit_together(base: DataFrame, programs: list["RuleProgram"]) -> None:
    """Compute the pending means of several programs in ONE aggregate over ``base``.

    Valid when every program reads columns of ``base`` by name and none filters rows (e.g.
    the modality programs of one wide table): one scan instead of one per program.
    """
    if any(p.has_filters for p in programs):
        for p in programs:
            p._flush()
        return
    aggs, owners = [], []
    for i, p in enumerate(programs):
        for pid, (build, dt) in p.pending.items():
            mean = F.avg(lenient_double(build(p.means), dt))
            aggs += [mean.alias(f"m{i}_{pid}"), mean.cast("string").alias(f"s{i}_{pid}")]
            owners.append((i, pid))
    if not aggs:
        return
    row = base.agg(*aggs).collect()[0]
    for i, pid in owners:
        programs[i].means[pid] = (row[f"m{i}_{pid}"], row[f"s{i}_{pid}"])
    for p in programs:
        p.pending = {}
        p.aggregate_jobs += 1


def clean(df: DataFrame, rules: dict, null_key: bool = True) -> DataFrame:
    """Apply one rule set (feature -> rule) to ``df``."""
    return RuleProgram(df, rules, null_key=null_key).result()


def clean_groups(datasets: dict[str, DataFrame], rule_groups: dict, group_of: dict[str, str] | None = None,
                 null_key: bool = True) -> dict[str, DataFrame]:
    """Apply each group's rules to its dataset (dataset name -> rule group name)."""
    group_of = group_of or {k: k for k in datasets}
    return {name: clean(df, rule_groups.get(group_of[name], {}), null_key) for name, df in datasets.items()}


def null_report(df: DataFrame, key_cols=("row_id", "DX")) -> DataFrame:
    """Residual NULL count per column, in one aggregate: (feature, n_rows, n_null)."""
    feats = [c for c in df.columns if c not in key_cols]
    wide = df.agg(F.count(F.lit(1)).alias("__n"),
                  *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in feats])
    return (wide.unpivot(["__n"], feats, "feature", "n_null")
            .select("feature", F.col("__n").alias("n_rows"), F.col("n_null").cast("bigint").alias("n_null")))
