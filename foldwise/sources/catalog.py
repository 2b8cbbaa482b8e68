"""Alias catalog: name -> (path, format, optional explicit schema).

Reading through the catalog keeps scans lazy, so Catalyst prunes columns and pushes filters
into the file scan. Explicit schemas replace the inference pass of a CSV read.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass
class Entry:
    path: str
    fmt: str = "parquet"
    schema: T.StructType | str | None = None
    options: dict | None = None


class Catalog:
    def __init__(self, entries: dict[str, Entry | str], root: str = ""):
        self.root = root
        self.entries = {k: (v if isinstance(v, Entry) else Entry(v)) for k, v in entries.items()}

    @classmethod
    def for_tables(cls, root: str, names, fmt: str = "parquet") -> "Catalog":
        return cls({n: Entry(f"{n}.{fmt}", fmt) for n in names}, root)

    def path(self, alias: str) -> str:
        e = self.entries[alias]
        return e.path if os.path.isabs(e.path) or not self.root else os.path.join(self.root, e.path)

    def read(self, spark: SparkSession, alias: str, columns: list[str] | None = None) -> DataFrame:
        e = self.entries[alias]
        reader = spark.read.format(e.fmt)
        if e.fmt == "csv":
            reader = reader.option("header", "true")
            if e.schema is None:
                reader = reader.option("inferSchema", "true")
        for k, v in (e.options or {}).items():
            reader = reader.option(k, v)
        if e.schema is not None:
            reader = reader.schema(e.schema)
        df = reader.load(self.path(alias))
        return df.select(*columns) if columns else df


DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split()


def driver_catalog(sf_dir: str) -> Catalog:
    return Catalog.for_tables(sf_dir, DRIVER_TABLES)


CATALOG_SCHEMA = T.StructType([T.StructField("Feature", T.StringType()),
                               T.StructField("Grouping", T.StringType())])


def feature_catalog(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """A (Feature, Grouping) catalog. Catalogs are metadata: one row per feature."""
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def union_catalogs(*cats: DataFrame) -> DataFrame:
    """Union by position, duplicates kept."""
    out = cats[0]
    for c in cats[1:]:
        out = out.union(c)
    return out
