"""The data model: an append-only log of mutations of keys.

A mutation is (key, value, ts, seq, tombstone).  Mutations of a key are ordered by
(ts, seq); the newest wins, and a tombstone that is newest deletes the key.  Keys
compare by their UTF-8 bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys with this prefix belong to the engine; users can neither read nor write them.
RESERVED_PREFIX = "__sys__"

MUTATION = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("value", T.StringType(), True),
        T.StructField("ts", T.LongType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("tombstone", T.BooleanType(), False),
    ]
)


def check_key(key: str) -> str:
    """The key itself; raises for one that is empty or reserved."""
    if not key or key.startswith(RESERVED_PREFIX):
        raise ValueError(f"{key!r} is not a user's key")
    return key


def is_user_key(key: Column) -> Column:
    return ~key.startswith(RESERVED_PREFIX)


def user_key(user_id: Column) -> Column:
    """u and the id, with zeros up to six digits; longer ids stay whole (lpad alone would cut them)."""
    digits = user_id.cast("string")
    return F.concat(F.lit("u"), F.lpad(digits, F.greatest(F.lit(6), F.length(digits)), F.lit("0")))


def mutations_from_events(events: DataFrame, fine: bool = False) -> DataFrame:
    """events as mutations: a key per user (per user and event type if fine), errors as tombstones."""
    key = user_key(F.col("user_id"))
    if fine:
        key = F.concat(key, F.lit(":"), F.col("event_type"))
    gone = F.col("event_type") == "error"
    value = F.when(~gone, F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")))
    return events.select(key.alias("key"), value.alias("value"), "ts", F.col("event_id").alias("seq"), gone.alias("tombstone"))


#: The same in DuckDB SQL.
EVENTS_SQL = """SELECT 'u' || lpad(user_id::VARCHAR, greatest(6, length(user_id::VARCHAR))::INT, '0') AS key, CASE WHEN event_type <> 'error' THEN event_type || ':' || event_id END AS value,
       ts, event_id AS seq, event_type = 'error' AS tombstone FROM events"""
FINE_SQL = EVENTS_SQL.replace("'0') AS key", "'0') || ':' || event_type AS key")
