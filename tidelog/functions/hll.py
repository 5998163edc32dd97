"""HyperLogLog as rows of registers; maxima of rows merge sketches of the same precision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.hashing import trailing_zeros, word32


def check_precision(p: int) -> int:
    if not 4 <= p <= 16:
        raise ValueError("the precision is from 4 to 16")
    return p


def registers(rows: DataFrame, p: int, compat: bool = False) -> DataFrame:
    """register and rank of rows (column element): 2**p rows at most.

    The register is the hash's first p bits, the rank counts the trailing zeros of the
    others, plus one.  ``compat`` adds p to each rank, as sketches do that shift the first bits out.
    """
    check_precision(p)
    digest = F.md5(F.encode("element", "UTF-8"))
    rows = rows.filter("element is not null").select(word32(digest, 0).alias("high"), word32(digest, 1).alias("low"))
    rest = F.col("high").bitwiseAND((1 << (32 - p)) - 1)
    zeros = F.when(F.col("low") != 0, trailing_zeros(F.col("low"))).when(rest != 0, 32 + trailing_zeros(rest)).otherwise(64 - p)
    rank = (zeros + 1 + (p if compat else 0)).cast("int")
    return rows.select(F.shiftright("high", 32 - p).alias("register"), rank.alias("rank")).groupBy("register").agg(F.max("rank").alias("rank"))


def merge(*sketches: DataFrame) -> DataFrame:
    both = sketches[0]
    for more in sketches[1:]:
        both = both.unionByName(more)
    return both.groupBy("register").agg(F.max("rank").alias("rank"))


def estimate(regs: DataFrame, p: int) -> DataFrame:
    """One row: the estimated number of distinct elements."""
    m = float(1 << check_precision(p))
    two32 = float(1 << 32)
    alpha = 0.7213 / (1.0 + 1.079 / m)
    sums = regs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rank").cast("double"))), F.lit(0.0)).alias("s"))
    empty = F.lit(m) - F.col("n")
    raw = sums.select("n", (F.lit(alpha * m * m) / (F.col("s") + empty)).alias("raw"))
    value = (
        F.when((F.col("raw") <= 2.5 * m) & (empty > 0), F.lit(m) * F.log(F.lit(m) / empty))
        .when((F.col("raw") > two32 / 30) & (F.col("raw") < two32), -two32 * F.log(F.lit(1.0) - F.col("raw") / two32))
        .otherwise(F.col("raw"))
    )
    return raw.select(value.alias("estimate"))


def dump(regs: DataFrame, p: int) -> bytes:
    """p, then a byte per register."""
    data = bytearray(1 << p)
    for row in regs.toLocalIterator():
        data[row["register"]] = row["rank"]
    return bytes([p]) + bytes(data)


def load(spark: SparkSession, data: bytes) -> tuple[int, DataFrame]:
    return data[0], spark.createDataFrame([(at, rank) for at, rank in enumerate(data[1:]) if rank], "register long, rank int")
