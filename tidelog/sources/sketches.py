"""Named sketches: serialized bytes under (kind, name) in a Parquet log of versions."""

from __future__ import annotations

import json
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

KINDS = ("bloom", "cms", "hll", "simhash", "merkle")
SCHEMA = "kind string, name string, params string, payload binary, ts long, tombstone boolean"


class SketchStore:
    """The newest version of a name counts; a deleted name is absent until it is saved again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, kind: str, name: str, params: dict, payload: bytes | None) -> None:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}")
        row = (kind, name, json.dumps(params, sort_keys=True), payload, time.time_ns(), payload is None)
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def save(self, kind: str, name: str, payload: bytes, replace: bool = True, **params) -> None:
        if not replace and self.load(kind, name) is not None:
            raise ValueError(f"{kind} {name!r} is there already")
        self._append(kind, name, params, payload)

    def delete(self, kind: str, name: str) -> None:
        self._append(kind, name, {}, None)

    def load(self, kind: str, name: str) -> tuple[bytes, dict] | None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return None
        rows = self.spark.read.schema(SCHEMA).parquet(self.path).filter((F.col("kind") == kind) & (F.col("name") == name))
        row = rows.orderBy(F.col("ts").desc()).first()
        return None if row is None or row["tombstone"] else (bytes(row["payload"]), json.loads(row["params"]))

    def write_file(self, kind: str, name: str, path: str) -> None:
        """The newest bytes of a sketch as a file of their own."""
        held = self.load(kind, name)
        if held is None:
            raise KeyError(f"no {kind} {name!r}")
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        out = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(hadoop, True)
        try:
            out.write(held[0])
        finally:
            out.close()

    def read_file(self, kind: str, name: str, path: str) -> None:
        """Saves a file's bytes under a name."""
        self.save(kind, name, bytes(self.spark.read.format("binaryFile").load(path).first()["content"]))
