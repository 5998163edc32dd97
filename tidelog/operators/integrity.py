"""Integrity: record checksums and hash trees over blocks of a run."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.ordering import with_row_index
from tidelog.session import cut_lineage

#: What a level with an odd number of nodes (other than one) is filled up with: 16 zero bytes.
ZERO_NODE = "0" * 32
#: Nodes that are folded together, ten levels at a time.
FAN_OUT = 1024
#: Bits of a row's place in its part of a stored run.
PART_BITS = 33


def payload(key: str = "key", value: str = "value", tombstone: str = "tombstone") -> Column:
    """The bytes of a record that checksums cover."""
    text = F.concat(F.col(key), F.lit("="), F.coalesce(F.col(value), F.lit("")), F.lit("|"), F.when(F.col(tombstone), "1").otherwise("0"))
    return F.encode(text, "UTF-8")


def with_crc(mutations: DataFrame) -> DataFrame:
    """mutations with crc, the CRC-32 of each record."""
    return mutations.withColumn("crc", F.crc32(payload()))


def intact(records: DataFrame) -> DataFrame:
    """Records whose checksum holds."""
    return records.filter(F.col("crc") == F.crc32(payload()))


def _block_hash() -> Column:
    """The hash of a group's records (columns place and record): the MD5 of their payloads in turn."""
    records = F.array_sort(F.collect_list(F.struct("place", "record")))
    return F.md5(F.encode(F.array_join(F.transform(records, lambda r: r["record"]), "\n"), "UTF-8"))


def leaves(run: DataFrame, block: int) -> DataFrame:
    """idx and hash of each block of ``block`` records in key order: the MD5 of their payloads in turn."""
    rows = with_row_index(run.select("key", F.decode(payload(), "UTF-8").alias("record")), "key", name="place")
    return rows.groupBy(F.expr(f"place div {block}").alias("idx")).agg(_block_hash().alias("hash"))


def stored_leaves(run: DataFrame, block: int, *by: str) -> DataFrame:
    """part, block and hash of the blocks of a stored run, whose rows have their places in it (column place: the part's number above PART_BITS bits, then a count from 0)."""
    inside = F.col("place").bitwiseAND((1 << PART_BITS) - 1)
    rows = run.select(*by, "place", F.decode(payload(), "UTF-8").alias("record"))
    return rows.groupBy(*by, F.shiftright("place", PART_BITS).alias("part"), F.floor(inside / block).alias("block")).agg(_block_hash().alias("hash"))


def _halved(nodes: Column, pad: bool) -> Column:
    """The parents of an array of nodes; an odd last one is paired with the zero node (if not pad, a single one is its own parent)."""
    left, right = F.filter(nodes, lambda _, k: k % 2 == 0), F.filter(nodes, lambda _, k: k % 2 == 1)
    parents = F.zip_with(left, right, lambda a, b: F.md5(F.unhex(F.concat(a, F.coalesce(b, F.lit(ZERO_NODE))))))
    return parents if pad else F.when(F.size(nodes) > 1, parents).otherwise(nodes)


def folded(lists: DataFrame, levels: int, pad: bool = True) -> DataFrame:
    """lists (column n0: nodes in order) with the next levels above as n1, n2 and so on."""
    for k in range(levels):
        lists = lists.withColumn(f"n{k + 1}", _halved(F.col(f"n{k}"), pad))
    return lists


def depth(n: int) -> int:
    """Levels above n leaves, up to a single node."""
    return max(n - 1, 0).bit_length()


def _steps(nodes: DataFrame) -> Iterator[tuple[int, DataFrame]]:
    """(level of n0, groups of up to FAN_OUT nodes with all levels that they make) from the leaves up; each step shuffles the nodes once."""
    n, level = nodes.count(), 0
    while n:
        up = min(depth(n), FAN_OUT.bit_length() - 1)
        listed = F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"])
        groups = nodes.groupBy(F.expr(f"idx div {FAN_OUT}").alias("idx")).agg(listed.alias("n0"))
        lists = cut_lineage(folded(groups, up))
        yield level, lists
        if depth(n) <= up:
            return
        nodes, n, level = lists.select("idx", F.get(f"n{up}", F.lit(0)).alias("hash")), -(-n // (1 << up)), level + up


def tree(run: DataFrame, block: int) -> DataFrame:
    """level (0 for the leaves), idx and hash of every node; a single leaf is the root."""
    out = None
    for level, lists in _steps(cut_lineage(leaves(run, block))):
        names = [c for c in lists.columns if c != "idx"]
        for k in range(0 if level == 0 else 1, len(names)):
            nodes = lists.select(F.col("idx").alias("_g"), F.posexplode(f"n{k}").alias("_k", "hash"))
            nodes = nodes.select(F.lit(level + k).alias("level"), (F.col("_g") * (FAN_OUT >> k) + F.col("_k")).alias("idx"), "hash")
            out = nodes if out is None else out.unionByName(nodes)
    return leaves(run, block).select(F.lit(0).alias("level"), "idx", "hash") if out is None else out


def root_of(nodes: DataFrame) -> DataFrame:
    """One row: the root over leaves (idx from 0 without gaps, and hash); no row if there is none."""
    last = None
    for _, lists in _steps(nodes):
        last = lists
    if last is None:
        return nodes.select(F.col("hash").alias("root"))
    return last.select(F.get(last.columns[-1], F.lit(0)).alias("root"))


def root(run: DataFrame, block: int) -> DataFrame:
    """One row: the root's hash (no row for an empty run)."""
    return root_of(cut_lineage(leaves(run, block)))


def roots(nodes: DataFrame, by: str, most: int) -> DataFrame:
    """by, n and root of each group's leaves (part, block, hash), of which a group has ``most`` at most."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("part", "block", "hash"))), lambda x: x["hash"])
    lists = nodes.groupBy(by).agg(listed.alias("n0"))
    return folded(lists, depth(most), pad=False).select(by, F.size("n0").cast("long").alias("n"), F.get(f"n{depth(most)}", F.lit(0)).alias("root"))


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """idx of the leaves in which two sets of leaves (idx, hash) differ."""
    both = left.select("idx", F.col("hash").alias("a")).join(right.select("idx", F.col("hash").alias("b")), "idx", "full")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("idx")
