"""The write-ahead log: segments, checksums, replay, truncation, fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.integrity import intact, with_crc
from tidelog.operators.ordering import with_row_index

FULL, FIRST, MIDDLE, LAST = 0, 1, 2, 3


def segmented(mutations: DataFrame, size: int) -> DataFrame:
    """mutations in write order with segment_id (``size`` records each), position in it, and crc."""
    rows = with_row_index(mutations, "ts", "seq")
    rows = rows.withColumn("segment_id", F.expr(f"row_index div {size}")).withColumn("position", F.expr(f"row_index % {size}")).drop("row_index")
    return with_crc(rows)


def append(log: DataFrame, path: str) -> None:
    """Appends segmented records to the log at path, a folder per segment."""
    log.write.mode("append").partitionBy("segment_id").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def replay(log: DataFrame, low_watermark: int = 0) -> DataFrame:
    """Mutations of the segments from low_watermark on whose checksum holds. Order is kept by ts and seq."""
    return intact(log.filter(F.col("segment_id") >= low_watermark)).drop("segment_id", "position", "crc")


def low_watermark(flushed: DataFrame) -> DataFrame:
    """One row: the first segment that is still needed once all of flushed (with segment_id) is in runs."""
    return flushed.agg((F.max("segment_id") + 1).alias("low_watermark"))


def truncate(spark: SparkSession, path: str, low: int) -> int:
    """Deletes the segments below low; returns how many there were."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    folder = hadoop(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    dropped = 0
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("segment_id=") and int(name.partition("=")[2]) < low:
            fs.delete(status.getPath(), True)
            dropped += 1
    return dropped


def fragments(mutations: DataFrame, size: int) -> DataFrame:
    """key, ts, seq, tombstone, part (from 0), kind and data: values cut into slices of ``size`` characters.

    A value of one slice (or none) is FULL; of several, the outer ones are FIRST and LAST.
    """
    value = F.coalesce("value", F.lit(""))
    n = F.greatest(F.ceil(F.length(value) / F.lit(size)).cast("int"), F.lit(1))
    parts = mutations.select("key", "ts", "seq", "tombstone", value.alias("value"), n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    kind = F.when(F.col("n") == 1, FULL).when(F.col("part") == 0, FIRST).when(F.col("part") == F.col("n") - 1, LAST).otherwise(MIDDLE)
    return parts.select("key", "ts", "seq", "tombstone", "part", kind.alias("kind"), F.substring("value", F.col("part") * size + 1, F.lit(size)).alias("data"))


def reassembled(parts: DataFrame) -> DataFrame:
    """key, ts, seq, tombstone and value of the records all of whose fragments are there."""
    grouped = parts.groupBy("key", "ts", "seq", "tombstone").agg(F.array_sort(F.collect_list(F.struct("part", "kind", "data"))).alias("parts"))
    last = F.element_at("parts", -1)
    whole = (last["part"] == F.size("parts") - 1) & last["kind"].isin(FULL, LAST)
    return grouped.filter(whole).select("key", "ts", "seq", "tombstone", F.array_join(F.transform("parts", lambda p: p["data"]), "").alias("value"))
