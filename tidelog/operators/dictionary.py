"""Key dictionaries: a bijection between keys and ids from 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.ordering import with_row_index


def build(mutations: DataFrame, known: DataFrame | None = None, new_only: bool = False) -> DataFrame:
    """id and key: new keys in the order of their first mutation, behind those of ``known`` (or without them)."""
    first = mutations.groupBy("key").agg(F.min(F.struct("ts", "seq")).alias("first")).select("key", "first.*")
    start = 1
    if known is not None:
        first = first.join(known.select("key"), "key", "left_anti")
        start += known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("n")).first()["n"]
    new = with_row_index(first, "ts", "seq", "key").select((F.col("row_index") + start).alias("id"), "key")
    return new if known is None or new_only else known.select("id", "key").unionByName(new)


def encode(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """rows with key replaced by key_id."""
    return rows.join(dictionary.select(F.col("id").alias("key_id"), "key"), "key").drop("key")


def decode(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """rows with key_id replaced by key."""
    return rows.join(dictionary.select(F.col("id").alias("key_id"), "key"), "key_id").drop("key_id")
