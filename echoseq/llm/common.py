"""Shared plumbing: tables, and Arrow batches cut by bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch

__all__ = ["STEP_BYTES", "Scratch", "documents", "ids_of", "read", "text_steps"]

#: Bytes of text that one vectorised step handles; a longer document is a step of its own.
STEP_BYTES = 1 << 21


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(df: DataFrame) -> DataFrame:
    """The two columns the operators work on; other columns, whatever their names, are left behind."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_steps(batch: pa.RecordBatch, column: str = "text", step: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets) for runs of rows of about `step` bytes; null reads as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    n = len(col)
    if not n:
        return
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + step, "right")) - 1)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def ids_of(batch: pa.RecordBatch, lo: int, hi: int, column: str = "doc_id") -> pa.Array:
    return batch.column(batch.schema.get_field_index(column)).slice(lo, hi - lo)
