"""A key dictionary in Parquet, to which new keys are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.operators import dictionary

SCHEMA = "id long, key string"


class DictionaryStore:
    """Ids of keys below a folder that all executors share. An id, once given, stays with its key; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        """id and key of all keys; no row before the first update."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def update(self, mutations: DataFrame) -> DataFrame:
        """Appends the keys of mutations that have no id yet, in the order of their first mutation; returns the whole dictionary."""
        known = self.read()
        dictionary.build(mutations, known, new_only=True).write.mode("append").parquet(self.path)
        return self.read()

    def encode(self, rows: DataFrame) -> DataFrame:
        """rows with key replaced by key_id."""
        return dictionary.encode(rows, self.read())

    def decode(self, rows: DataFrame) -> DataFrame:
        """rows with key_id replaced by key."""
        return dictionary.decode(rows, self.read())
