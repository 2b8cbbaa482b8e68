"""Table sinks. Outputs go to a shared folder (the cluster's checkpoint folder by default)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from foldwise.session import scratch_path


def write_table(df: DataFrame, path: str, partition_by=(), fmt: str = "parquet",
                mode: str = "overwrite") -> str:
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", "true")
    w.save(path)
    return path


def write_and_read(df: DataFrame, name: str, partition_by=(), fmt: str = "parquet",
                   path: str | None = None) -> DataFrame:
    """Write ``df`` and return the written table; also cuts the lineage at this point."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    write_table(df, path, partition_by, fmt)
    return spark.read.format(fmt).load(path)
