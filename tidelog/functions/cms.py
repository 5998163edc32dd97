"""Count-Min sketches as rows of counters; sums of rows merge sketches of the same parameters."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.hashing import modulo, seeded_md5

SEED_WIDTH = 32


@dataclass(frozen=True)
class CountMin:
    """k rows of m counters."""

    m: int
    k: int
    seed: int = 0

    @staticmethod
    def sized(epsilon: float, delta: float, seed: int = 0) -> CountMin:
        if not 0 < epsilon < 1 or not 0 < delta < 1:
            raise ValueError("epsilon and delta are between 0 and 1")
        return CountMin(math.ceil(math.e / epsilon), math.ceil(math.log(math.e / delta)), seed)

    def _hashed(self, rows: DataFrame) -> DataFrame:
        lines = F.explode(F.sequence(F.lit(0), F.lit(self.k - 1))).alias("line")
        cell = modulo(seeded_md5(F.col("element"), F.col("line") + self.seed, SEED_WIDTH), self.m)
        return rows.select("*", lines).withColumn("cell", cell)

    def add(self, rows: DataFrame) -> DataFrame:
        """line, cell and count: the counters of rows (column element). Equal elements are counted before they are hashed."""
        counted = rows.filter("element is not null").groupBy("element").agg(F.count("*").alias("n"))
        return self._hashed(counted).groupBy("line", "cell").agg(F.sum("n").alias("count"))

    def estimate(self, probes: DataFrame, cells: DataFrame) -> DataFrame:
        """element and estimate (never below the true count) for every distinct element of probes."""
        hashed = self._hashed(probes.select("element").distinct())
        return hashed.join(cells, ["line", "cell"], "left").groupBy("element").agg(F.min(F.coalesce("count", F.lit(0))).alias("estimate"))

    def dump(self, cells: DataFrame) -> bytes:
        """The sketch as bytes: k, m, the counters by line, the number of seeds, the seeds of 32 bytes."""
        counts = [0] * (self.k * self.m)
        for row in cells.toLocalIterator():
            counts[row["line"] * self.m + row["cell"]] = min(row["count"], 0xFFFFFFFF)
        seeds = b"".join(struct.pack(">I28x", s) for s in range(self.seed, self.seed + self.k))
        return struct.pack(f">II{len(counts)}II", self.k, self.m, *counts, self.k) + seeds

    @staticmethod
    def load(spark: SparkSession, data: bytes) -> tuple[CountMin, DataFrame]:
        k, m = struct.unpack_from(">II", data)
        counts = struct.unpack_from(f">{k * m}I", data, 8)
        (seed,) = struct.unpack_from(">I", data, 12 + 4 * k * m)
        rows = [(at // m, at % m, n) for at, n in enumerate(counts) if n]
        return CountMin(m, k, seed), spark.createDataFrame(rows, "line int, cell long, count long")


def merge(*sketches: tuple[CountMin, DataFrame]) -> tuple[CountMin, DataFrame]:
    """The sketch of all elements; the parameters must be the same."""
    if len({s for s, _ in sketches}) != 1:
        raise ValueError("sketches with different parameters can't be merged")
    cells = sketches[0][1].select("line", "cell", "count")
    for _, more in sketches[1:]:
        cells = cells.unionAll(more.select("line", "cell", "count"))
    return sketches[0][0], cells.groupBy("line", "cell").agg(F.sum("count").alias("count"))
