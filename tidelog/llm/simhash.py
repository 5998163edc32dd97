"""Near duplicates by SimHash and BK-trees.

A fingerprint has bit i set if more than half of the text's word shingles have it
set in their 64-bit hash.  Fingerprints within ``RADIUS`` differing bits are linked,
and linked ones form classes.

Distinct fingerprints are dealt into shards: of ``RADIUS`` + 1 groups of bits, two
fingerprints within the radius agree on one at least, so they meet in a shard of that
group's value.  A group has as many bits as leave about ``SHARD`` fingerprints to a shard.
Each shard gets a BK-tree, in which a child hangs below its parent by their Hamming
distance; every member follows only the edges whose distance is within the radius of
its own.  A shard yields one link per member at most (to the smallest member that it
reaches), never its pairs.  Classes come from joining these links by minimum propagation.

A broadcast would bring the trees, and with them the fingerprints of all documents, to the
driver first, so each shard's tree is built in the task to which its rows are dealt.  A
shard of more than ``BLOCK`` fingerprints is cut into blocks, each pair of which has a tree.

Edge cases: a text without words (null, empty, white space) has fingerprint zero,
which is linked like any other.  Equal fingerprints are one node, so copies cost
nothing more.  A null doc_id takes part; the class id is the smallest id that is
not null, or null if there is none.  Very long texts are fingerprinted whole; bits are
added up for a piece of them at a time.  Extra columns, whatever their names, are ignored
by ``near_duplicates`` and kept by ``one_per_class``.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import cut_lineage, sliced, texts_of

SEED, SHINGLE, RADIUS = 42, 3, 2
#: Fingerprints that a shard holds on average, if bits were even (fewer than twice as many).
SHARD = 1000
#: Distinct fingerprints of one shard that a task takes at most; larger shards are searched in pairs of blocks.
BLOCK = 20_000
#: Pairs of a query and a tree's node that are looked at together.
FRONTIER = 4_000_000
#: Bytes of a long text whose shingles are held at once.
PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _words(data: bytes) -> list[bytes]:
    return data.translate(_LOWER).split()  # bytes split at ASCII white space alone


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    grams = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype=np.uint64)


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of ``size`` words (of the whole sequence if there are fewer), repeats included."""
    words = _words(text.encode("utf-8", "surrogatepass"))
    return _hashes(words, min(size, len(words))) if words else np.zeros(0, dtype=np.uint64)


def _unpacked(hashes: np.ndarray) -> np.ndarray:
    """The 64 bits of each hash, lowest first."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def long_simhash(text: str, size: int = SHINGLE, piece: int = PIECE) -> int:
    """The fingerprint of one text, whose bits are added up for a piece of it at a time."""
    data = text.encode("utf-8", "surrogatepass")
    ones, n, last, at = np.zeros(64, dtype=np.int64), 0, [], 0
    while at < len(data):
        space = _SPACE.search(data, min(at + piece, len(data)))
        stop = space.start() if space else len(data)
        words = last + _words(data[at:stop])
        at = stop
        if len(words) >= size:
            hashes = _hashes(words, size)
            ones += _unpacked(hashes).sum(axis=0, dtype=np.int64)
            n += len(hashes)
        last = words[1 - size :]
    if not n:
        return int(shingle_hashes(text, size)[0]) if last else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def simhashes(texts: list[str]) -> np.ndarray:
    """The fingerprint of each text."""
    long = {k: long_simhash(t) for k, t in enumerate(texts) if len(t) > PIECE}
    hashes = [shingle_hashes("" if k in long else t) for k, t in enumerate(texts)]
    sizes = np.array([len(h) for h in hashes])
    out = np.zeros(len(texts), dtype=np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        bits = _unpacked(np.concatenate([hashes[k] for k in some]))
        ones = np.add.reduceat(bits, np.cumsum([0, *sizes[some]])[:-1], axis=0, dtype=np.int32)
        packed = np.packbits(2 * ones > sizes[some][:, None], axis=1, bitorder="little")
        out[some] = np.ascontiguousarray(packed).view("<u8").ravel()
    for k, print_ in long.items():
        out[k] = print_
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text) and fp (the fingerprint as a signed long), one row per row of docs."""

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 2 << 20):
            fp = simhashes(texts_of(batch)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(fp, pa.int64())], names=["doc_id", "text_key", "fp"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(hashed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, fp long")


def shard_masks(n: int, radius: int = RADIUS) -> list[int]:
    """Bit masks, one per choice of groups that must agree, so that a shard of n even fingerprints holds SHARD on average."""
    bits = max(0.0, math.log2(max(n, 1) / SHARD))
    if bits < 1:
        return [0]
    groups = radius + 1
    while groups < 16 and (groups - radius) * (64 // groups) < bits:
        groups += 1
    width = min(64 // groups, int(bits / (groups - radius)) or 1)
    parts = [((1 << width) - 1) << (64 * k // groups) for k in range(groups)]
    return [sum(chosen) for chosen in combinations(parts, groups - radius)]


class BKForest:
    """A BK-tree for each shard; rows of a shard are together, the first is the root."""

    def __init__(self, fp: np.ndarray, shard: np.ndarray):
        self.fp = fp
        starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        self.size = np.diff(np.r_[starts, len(fp)])
        self.root = np.repeat(starts, self.size)
        edges = []
        item = np.flatnonzero(np.arange(len(fp)) != self.root)
        at = self.root[item]
        while len(item):
            # The first item to come to a node at some distance becomes its child there; the others go on from it.
            edge = at * 65 + np.bitwise_count(fp[item] ^ fp[at])
            kinds, first, which = np.unique(edge, return_index=True, return_inverse=True)
            child = item[first]
            edges.append((kinds, child))
            on = child[which] != item
            item, at = item[on], child[which][on]
        keys = np.concatenate([e[0] for e in edges]) if edges else np.zeros(0, dtype=np.int64)
        kids = np.concatenate([e[1] for e in edges]) if edges else np.zeros(0, dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.kids = keys[order], kids[order]

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries, nodes of the same shard within the radius), a tree level at a time."""
        query, node = queries, self.root[queries]
        while len(query):
            d = np.bitwise_count(self.fp[query] ^ self.fp[node]).astype(np.int64)
            near = d <= radius
            yield query[near], node[near]
            lo = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), side="right")
            n = hi - lo
            child = np.arange(n.sum()) + np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n)
            query, node = np.repeat(query, n), self.kids[child]


def local_classes(fp: np.ndarray, shard: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each row the index of the first row of its shard that links within the radius lead to."""
    forest = BKForest(fp, shard)
    label = np.arange(len(fp))
    many = np.repeat(forest.size, forest.size)
    queries = np.flatnonzero(many > 1)
    work = np.cumsum(many[queries])
    start = 0
    while start < len(queries):
        stop = max(start + 1, int(np.searchsorted(work, (work[start - 1] if start else 0) + FRONTIER, side="right")))
        for a, b in forest.within(queries[start:stop], radius):
            while True:
                x, y = label[a], label[b]
                open_ = x != y
                if not open_.any():
                    break
                a, b, x, y = a[open_], b[open_], x[open_], y[open_]
                np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
                while (label[label] != label).any():
                    label = label[label]
        start = stop
    return label


def links(distinct: DataFrame, radius: int = RADIUS, masks: list[int] | None = None, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all pairs within the radius.

    A shard of more than ``block`` is cut into blocks by hash, and every two of its blocks
    make a shard of their own, so that no task takes more than two blocks of one shard.
    """
    masks = masks or shard_masks(distinct.count(), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for k, m in enumerate(signed)])
    dealt = distinct.select("fp", F.explode(keys).alias("key")).select("key.choice", "key.part", "fp")
    large = dealt.groupBy("choice", "part").count().filter(F.col("count") > block).select("choice", "part", F.expr(f"(count + {block - 1}) div {block}").cast("int").alias("blocks"))
    dealt = dealt.join(cut_lineage(large), ["choice", "part"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(own, k).alias("low"), F.greatest(own, k).alias("high")))
    whole = F.array(F.struct(F.lit(0).alias("low"), F.lit(0).alias("high")))
    dealt = dealt.select("choice", "part", "fp", F.explode(F.when(F.col("blocks").isNull(), whole).otherwise(pairs)).alias("pair"))
    # One number for each choice and pair of blocks: choices are few.
    pair = F.xxhash64("choice", "pair.low", "pair.high")
    dealt = dealt.select(pair.alias("choice"), "part", "fp").repartition("choice", "part").sortWithinPartitions("choice", "part", "fp")

    def linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []

        def flush(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            choice, part, fp = rows
            shard = np.cumsum(np.r_[False, (choice[1:] != choice[:-1]) | (part[1:] != part[:-1])])
            label = local_classes(fp.view(np.uint64), shard, radius)
            own = np.flatnonzero(label != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[own], pa.int64()), pa.array(fp[label[own]], pa.int64())], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                kept.append(tuple(batch.column(c).to_numpy() for c in ("choice", "part", "fp")))
            if sum(len(k[0]) for k in kept) >= 200_000:
                rows = tuple(np.concatenate(c) for c in zip(*kept, strict=True))
                # The last shard may go on in the next batch.
                last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
                end = int(last[-1]) + 1 if len(last) else 0
                if end:
                    yield flush(tuple(c[:end] for c in rows))
                kept = [tuple(c[end:] for c in rows)]
        if kept and sum(len(k[0]) for k in kept):
            yield flush(tuple(np.concatenate(c) for c in zip(*kept, strict=True)))

    return dealt.mapInArrow(linked, "a long, b long").distinct()


def classes(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): root is the smallest node that it is connected to.

    Each round links every neighbour that is larger than a node, and then every
    neighbour that is smaller, with the smallest one around that node, until nothing changes.
    """
    edges = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(df: DataFrame):
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    before = state(edges)
    while before[0]:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        # Large star: (v, m) for neighbours v > u.
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # Small star: all neighbours of u are smaller now, as edges run from the larger node.
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(least, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = cut_lineage(small.select("e.a", "e.b").filter("a <> b").distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def _classed(docs: DataFrame, radius: int, name: str) -> DataFrame:
    """doc_id, text_key, fp and name for every row of docs: component_id, or root, a fingerprint of its class that is never null."""
    fps = cut_lineage(fingerprints(docs))
    firsts = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    members = classes(links(firsts.select("fp"), radius))
    roots = members.select("root").distinct().select(F.col("root").alias("node"), "root")
    grouped = members.unionByName(roots).join(firsts, F.col("node") == F.col("fp")).select("fp", "root", "first")
    smallest = grouped.groupBy("root").agg(F.min("first").alias("smallest"))
    linked = grouped.join(smallest, "root").select("fp", "root", "smallest")
    of = {"component_id": F.coalesce("smallest", "first"), "root": F.coalesce("root", "fp")}[name]
    # Written out, so that adaptive execution can split the partition of a hot fingerprint in the last join.
    by_fp = cut_lineage(firsts.join(linked, "fp", "left").select("fp", of.alias(name)))
    return fps.join(by_fp, "fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs."""
    return _classed(docs, radius, "component_id").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_class(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of docs, with its columns, for each class: that of the smallest doc_id.

    Rows without a doc_id come after all others; of rows equal in doc_id the text's hash decides.
    """
    # A key without nulls, by which the rows are dealt once for both steps; equal texts are in one class, so no two classes share a key.
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.col("doc_id").isNull().alias("_none")]
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("least")
    ids = _classed(docs, radius, "root").groupBy("root").agg(least).select("least.doc_id", "least.text_key").select(*key, F.col("text_key").alias("_text"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), *key, F.xxhash64("text").alias("_text"))
    kept = rows.join(ids, ["_id", "_none", "_text"], "left_semi").dropDuplicates(["_id", "_none", "_text"])
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
