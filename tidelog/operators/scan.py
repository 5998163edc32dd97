"""Point reads, prefix and range scans, pages and client-paced iteration.

Every predicate on the key stands below resolution, so that it reaches the Parquet
scan (equality, prefix and range are pushed down), and every page is a top-k, not a
full sort.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidelog.model import check_key, is_user_key
from tidelog.operators.resolve import snapshot


def get(mutations: DataFrame, key: str) -> DataFrame:
    """key and value, or no row if the key is absent or deleted."""
    return snapshot(mutations.filter(F.col("key") == check_key(key))).select("key", "value")


def multi_get(mutations: DataFrame, keys: DataFrame) -> DataFrame:
    """key, found and value for every distinct key of keys (column key).

    The requested keys semi-join the log first; Spark broadcasts them where they are small.
    """
    wanted = keys.select("key").distinct()
    hits = snapshot(mutations.join(wanted, "key", "left_semi")).select("key", "value", F.lit(True).alias("hit"))
    return wanted.join(hits, "key", "left").select("key", F.col("hit").isNotNull().alias("found"), "value")


def prefix_scan(mutations: DataFrame, prefix: str) -> DataFrame:
    """key and value of the live keys that start with prefix, unordered."""
    return snapshot(mutations.filter(F.col("key").startswith(prefix) & is_user_key(F.col("key")))).select("key", "value")


def range_scan(mutations: DataFrame, low: str, high: str) -> DataFrame:
    """key and value of the live keys from low to high, both inclusive, unordered."""
    return snapshot(mutations.filter(F.col("key").between(low, high) & is_user_key(F.col("key")))).select("key", "value")


def _check_page(page: int, size: int) -> None:
    if page < 1 or size < 1:
        raise ValueError("page and size start at 1")


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of rows by key; empty past the end."""
    _check_page(number, size)
    return rows.orderBy("key").offset((number - 1) * size).limit(size)


def page_info(rows: DataFrame, number: int, size: int) -> DataFrame:
    """total, total_pages, and the first and last row number of the page (null past the end)."""
    _check_page(number, size)
    start = (number - 1) * size
    total = F.col("total")
    inside = total > start
    return rows.agg(F.count("*").alias("total")).select(
        "total",
        F.expr(f"(total + {size - 1}) div {size}").alias("total_pages"),
        F.when(inside, F.lit(start + 1)).cast("long").alias("first_row"),
        F.when(inside, F.least(total, F.lit(start + size))).cast("long").alias("last_row"),
    )


def after(rows: DataFrame, key: str | None, number: int = 1) -> DataFrame:
    """The next rows by key behind key (from the first on if it is null): a keyset step, whose cost does not grow with what was read."""
    return (rows if key is None else rows.filter(F.col("key") > key)).orderBy("key").limit(number)


class Cursor:
    """A client-paced pass over rows in key order, one partition at a time on the client."""

    def __init__(self, rows: DataFrame):
        self._rows: Iterator[Row] | None = rows.orderBy("key").toLocalIterator(prefetchPartitions=True)

    def next(self) -> tuple[str, str] | None:
        """The next (key, value), or None at the end or after stop()."""
        row = next(self._rows, None) if self._rows is not None else None
        return None if row is None else (row["key"], row["value"])

    def stop(self) -> None:
        self._rows = None


def prefix_iterate(mutations: DataFrame, prefix: str) -> Cursor:
    return Cursor(prefix_scan(mutations, prefix))


def range_iterate(mutations: DataFrame, low: str, high: str) -> Cursor:
    return Cursor(range_scan(mutations, low, high))
