"""Bloom filters as rows of set bits; a union of rows merges filters of the same parameters."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.hashing import bit, modulo, seeded_md5

#: Bits of a filter that may be broadcast (16 MB).
PACKED_BITS = 1 << 27


@dataclass(frozen=True)
class Bloom:
    """m bits and k hashes; seeds count up from ``seed``, which is given, so that filters can be merged and made again."""

    m: int
    k: int
    seed: int = 0

    @staticmethod
    def sized(expected: int, fp: float, seed: int = 0) -> Bloom:
        if expected < 1 or not 0 < fp < 1:
            raise ValueError("expected starts at 1, and fp is between 0 and 1")
        m = math.ceil(expected * abs(math.log(fp)) / math.log(2) ** 2)
        return Bloom(m, math.ceil(m / expected * math.log(2)), seed)

    def _hashed(self, rows: DataFrame) -> DataFrame:
        seeds = F.explode(F.sequence(F.lit(self.seed), F.lit(self.seed + self.k - 1))).alias("seed")
        return rows.select("element", seeds).select("element", modulo(seeded_md5(F.col("element"), F.col("seed")), self.m).alias("bit"))

    def add(self, rows: DataFrame) -> DataFrame:
        """The bits that rows (column element) set; m rows at most. Equal elements are hashed once."""
        return self._hashed(rows.select("element").filter("element is not null").distinct()).select("bit").distinct()

    def packed(self, bits: DataFrame) -> DataFrame:
        """One row: words, the filter as an array of 64-bit numbers, lowest bits first."""
        held = bits.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(bit(F.col("bit") % 64)).alias("value"))
        every = bits.sparkSession.range(self.m // 64 + 1).withColumnRenamed("id", "word").join(held, "word", "left")
        listed = F.array_sort(F.collect_list(F.struct("word", F.coalesce("value", F.lit(0).cast("long")).alias("value"))))
        return every.agg(F.transform(listed, lambda w: w["value"]).alias("words"))

    def check(self, probes: DataFrame, bits: DataFrame) -> DataFrame:
        """element and maybe (false: surely absent) for every distinct element of probes.

        A filter of PACKED_BITS at most is broadcast as one row of packed bits and tested where the probes are;
        a larger one meets the probes' bits in a join.
        """
        elements = probes.select("element").distinct()
        if self.m <= PACKED_BITS:
            # A join on a constant with the only row of the other side.
            held = elements.withColumn("one", F.lit(1)).join(F.broadcast(self.packed(bits).withColumn("one", F.lit(1))), "one")
            places = F.transform(F.sequence(F.lit(self.seed), F.lit(self.seed + self.k - 1)), lambda seed: modulo(seeded_md5(F.col("element"), seed), self.m))
            isset = lambda at: F.getbit(F.get("words", F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1
            return held.select("element", F.forall(places, isset).alias("maybe"))
        hits = self._hashed(elements).join(bits.select("bit", F.lit(1).alias("set")), "bit", "left")
        return hits.groupBy("element").agg((F.count("set") == F.count("*")).alias("maybe"))

    def dump(self, bits: DataFrame) -> bytes:
        """The filter as bytes: m, a byte per bit, k, the seeds (integers big-endian, 32 bits)."""
        data = bytearray(self.m)
        for row in bits.select("bit").toLocalIterator():
            data[row["bit"]] = 1
        return struct.pack(">I", self.m) + bytes(data) + struct.pack(f">I{self.k}I", self.k, *range(self.seed, self.seed + self.k))

    @staticmethod
    def load(spark: SparkSession, data: bytes) -> tuple[Bloom, DataFrame]:
        (m,) = struct.unpack_from(">I", data)
        k, *seeds = struct.unpack_from(f">I{(len(data) - 8 - m) // 4}I", data, 4 + m)
        if seeds != list(range(seeds[0], seeds[0] + k)):
            raise ValueError("seeds do not count up")
        return Bloom(m, k, seeds[0]), spark.createDataFrame([(at,) for at, bit in enumerate(data[4 : 4 + m]) if bit], "bit long")


def merge(*filters: tuple[Bloom, DataFrame]) -> tuple[Bloom, DataFrame]:
    """The filter of all elements; the parameters must be the same."""
    if len({f for f, _ in filters}) != 1:
        raise ValueError("filters with different parameters can't be merged")
    bits = filters[0][1].select("bit")
    for _, more in filters[1:]:
        bits = bits.unionAll(more.select("bit"))
    return filters[0][0], bits.distinct()
