"""Writes: mutations, and their assignment to flush batches."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.model import MUTATION, check_key
from tidelog.operators.ordering import with_row_index
from tidelog.operators.resolve import newest


def put(key: str, value: str, ts: int, seq: int) -> tuple:
    return check_key(key), value, ts, seq, False


def delete(key: str, ts: int, seq: int) -> tuple:
    return check_key(key), None, ts, seq, True


def batch(spark: SparkSession, mutations: Iterable[tuple]) -> DataFrame:
    """The mutations made by ``put`` and ``delete`` as a DataFrame."""
    return spark.createDataFrame(list(mutations), MUTATION)


def flush_batches(mutations: DataFrame, size: int) -> DataFrame:
    """mutations with flush_id: consecutive ones in write order, ``size`` at a time."""
    if size < 1:
        raise ValueError("size starts at 1")
    rows = with_row_index(mutations, "ts", "seq")
    return rows.withColumn("flush_id", F.expr(f"row_index div {size}")).drop("row_index")


def flushed(batches: DataFrame) -> DataFrame:
    """The newest mutation of every key in each batch; what a flush of that batch writes."""
    last = F.max(F.struct("ts", "seq", "tombstone", "value")).alias("last")
    return batches.groupBy("flush_id", "key").agg(last).select("flush_id", "key", "last.*")


def sorted_run(mutations: DataFrame) -> DataFrame:
    """One run: the newest mutation of every key in key order, tombstones included."""
    return newest(mutations).orderBy("key")


def is_full(mutations: DataFrame, most: int) -> DataFrame:
    """One row: keys, and whether they are ``most`` at least."""
    return mutations.agg(F.countDistinct("key").alias("keys")).select("keys", (F.col("keys") >= most).alias("full"))
