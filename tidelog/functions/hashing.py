"""Hash expressions that other engines can repeat: MD5 and what is made of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seed_bytes(seed: Column, width: int = 4) -> Column:
    """A seed as 4 big-endian bytes, filled up with zero bytes behind."""
    return F.unhex(F.rpad(F.lpad(F.hex(seed.cast("long")), 8, "0"), 2 * width, "0"))


def seeded_md5(element: Column, seed: Column, width: int = 4) -> Column:
    """MD5, as hexadecimal digits, of the element's UTF-8 bytes and the seed's behind them."""
    return F.md5(F.concat(F.encode(element, "UTF-8"), seed_bytes(seed, width)))


def word32(digest: Column, at: int) -> Column:
    """The at-th (from 0) big-endian 32-bit word of a hexadecimal digest, as a long."""
    return F.conv(F.substring(digest, 8 * at + 1, 8), 16, 10).cast("long")


def modulo(digest: Column, m: int) -> Column:
    """The digest's first 64 bits, unsigned, modulo m (below 2**31), in 64-bit arithmetic."""
    return (word32(digest, 0) % m * ((1 << 32) % m) + word32(digest, 1)) % m


def trailing_zeros(x: Column) -> Column:
    """Trailing zero bits of a positive long."""
    return F.bit_count(x.bitwiseAND(-x) - 1)


def bit(at: Column) -> Column:
    """The long that has only bit ``at`` (0 to 63) set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))
