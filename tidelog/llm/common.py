"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidelog.session import checkpoint_root, cut_lineage, ship

__all__ = ["checkpoint_root", "cut_by", "cut_lineage", "documents", "pages", "remove", "ship", "sliced", "texts_of"]

#: Text bytes that a worker turns into Python objects at once.
SLICE_BYTES = 4 << 20


def sliced(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that column holds about ``limit`` bytes in each (one row at least)."""
    for batch in batches:
        yield from cut_by(batch, np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)), limit)


def cut_by(batch: pa.RecordBatch, sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a record batch into slices whose rows' sizes add up to ``limit`` at most (one row at least)."""
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as Python strings; null becomes the empty string."""
    return [t or "" for t in batch.column(column).to_pylist()]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/pages.parquet")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate results."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
