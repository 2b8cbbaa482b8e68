"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.session import scratch_path

#: Text bytes that a task holds in working arrays at once (one longer text goes alone).
CHUNK_BYTES = 1 << 20


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): only these two columns reach the scan; a null text is an empty one."""
    return df.select(df[id_col].cast("long").alias("doc_id"),
                     F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of the decimal text of a key, modulo m (null key: 0)."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % F.lit(m), F.lit(0))


def is_held_out(col: Column, m: int, r: int) -> Column:
    return crc_mod(col, m) == F.lit(r)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def chunks(batches: Iterator[pa.RecordBatch], cap: int = CHUNK_BYTES) -> Iterator[tuple[pa.Array, list[str]]]:
    """Cut Arrow batches of (doc_id, text, ...) into runs of at most `cap` text bytes."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > cap:
                yield batch.column(0).slice(start, i - start), batch.column(1).slice(start, i - start).to_pylist()
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.column(0).slice(start), batch.column(1).slice(start).to_pylist()
