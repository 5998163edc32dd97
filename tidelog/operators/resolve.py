"""Version resolution: last writer wins, with tombstones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("ts", "seq")


def newest(mutations: DataFrame) -> DataFrame:
    """The newest mutation of every key, tombstones included: key, ts, seq, tombstone, value.

    A maximum of structs has partial sums, so a hot key costs one row per task in
    the shuffle, and no key is sorted.
    """
    last = F.max(F.struct(*ORDER, "tombstone", "value")).alias("last")
    return mutations.groupBy("key").agg(last).select("key", "last.*")


def live() -> Column:
    return ~F.col("tombstone")


def snapshot(mutations: DataFrame) -> DataFrame:
    """key, value, ts, seq of every key that is not deleted. Tombstones go after resolution, never before."""
    return newest(mutations).filter(live()).select("key", "value", *ORDER)


def snapshot_by_window(mutations: DataFrame) -> DataFrame:
    """The same by ranking each key's versions; needs all versions of a key in one task."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(*[F.col(c).desc() for c in ORDER]))
    return mutations.withColumn("_rank", rank).filter((F.col("_rank") == 1) & live()).select("key", "value", *ORDER)


def as_of(mutations: DataFrame, ts) -> DataFrame:
    """The snapshot as it was at ts, inclusive."""
    return snapshot(mutations.filter(F.col("ts") <= ts))


def deleted(mutations: DataFrame) -> DataFrame:
    """Keys whose newest mutation is a tombstone, with its order."""
    return newest(mutations).filter("tombstone").select("key", *ORDER)


def version_counts(mutations: DataFrame) -> DataFrame:
    """key, versions and tombstones of every key ever written."""
    return mutations.groupBy("key").agg(F.count("*").alias("versions"), F.count_if("tombstone").alias("tombstones"))


def merge(*runs: DataFrame) -> DataFrame:
    """All rows of all runs; order and duplicates are left to resolution."""
    return reduce(DataFrame.unionByName, runs)


def merged_in_order(*runs: DataFrame) -> DataFrame:
    """All rows of all runs by key, older versions of a key first."""
    return merge(*runs).orderBy("key", *ORDER)
