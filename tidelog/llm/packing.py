"""Best-fit packing by minimum bin slack.

Documents become token ids (each ends with id 0); longer ones than a sequence
are cut into pieces.  Only piece lengths decide the packing, so it is planned on
the histogram of lengths, which has at most ``SEQUENCE`` entries whatever the
input's size.  Each round takes the longest length left, finds the fullest
feasible combination with it by subset-sum dynamic programming on a bitset, and
removes that combination as often as the counts allow.  A round exhausts a length
for its use in that combination, so the number of rounds is bounded by the sequence
length too, not by the rows.

Pieces get their places by rank: the n-th piece of a length takes the n-th place
that the plan has for that length.  Ranks come from a count per task and length,
so that no length, however common, is gathered in one task.

Edge cases: a null or empty text is the single id 0.  ``doc_id`` may be null or
repeat; every row is packed by itself.  A very long text is encoded whole (by the
library's own code from LONG_TEXT characters on, with the same ids) and cut into as many
pieces as it needs.  Extra columns, whatever their names, are ignored.  An empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import cut_lineage, sliced, texts_of

SEQUENCE = 2048
TOKENIZER = "byte_bpe_50k"
END_ID = 0
#: The tokenizer's only special token; a text that holds it is encoded by the slower library, which maps it to its own id.
SPECIAL = "<|endoftext|>"
#: Longer runs without a break are left to the slower library too, as the faster one's pattern matching recurses.
LONG_TEXT = 1 << 20


@cache
def _encoders(name: str):
    """(fast, exact): the same vocabulary in tiktoken and in tokenizers."""
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return fast, Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))


def token_ids(text: str, tokenizer: str = TOKENIZER) -> list[int]:
    """The ids that the tokenizers library gives for text without adding special tokens."""
    fast, exact = _encoders(tokenizer)
    if SPECIAL in text or len(text) > LONG_TEXT:
        return exact.encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


def cuts(n: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of each piece of n ids; only the first may be shorter than size where n exceeds it."""
    first = (n - 1) % size + 1
    return [(0, first), *((start, size) for start in range(first, n, size))]


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, size: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task and nth (of its length in that task), written to the checkpoint folder."""

    def tokenized(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, counts = TaskContext.get().partitionId(), Counter()
        for batch in sliced(batches, "text"):
            rows: list[tuple] = []
            at: list[int] = []
            for k, text in enumerate(texts_of(batch)):
                ids = np.array([*token_ids(text, tokenizer), END_ID], dtype="<u4")
                for piece, (start, length) in enumerate(cuts(len(ids), size)):
                    at.append(k)
                    rows.append((piece, start, length, zlib.crc32(ids[start : start + length].tobytes()), task, counts[length]))
                    counts[length] += 1
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), *columns], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return cut_lineage(docs.select("doc_id", "text").mapInArrow(tokenized, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long"))


def fullest(counts: dict[int, int], size: int) -> list[int]:
    """The combination of available lengths that holds the longest one and leaves least slack.

    Lengths enter from long to short until some sum leaves no slack, so that of equally
    full combinations one without short lengths is taken; those fill what long ones can't.
    """
    order = sorted(counts, reverse=True)
    room = size - order[0]
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in order:
        for _ in range(min(counts[length] - (length == order[0]), room // length)):
            grown = (reach | reach << length) & full
            if grown == reach:
                break
            steps.append((length, reach))
            reach = grown
        if reach >> room:
            break
    left, chosen = reach.bit_length() - 1, [order[0]]
    for length, before in reversed(steps):
        # A sum that was reached without this step needs no copy from it.
        if not before >> left & 1:
            chosen.append(length)
            left -= length
    return chosen


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number, first sequence, offset): places for the pieces of each length, by rank."""
    counts = {length: n for length, n in histogram.items() if n}
    if any(not 0 < length <= size for length in counts):
        raise ValueError("a length is outside the sequence")
    used, places, sequence = Counter(), [], 0
    while counts:
        chosen = fullest(counts, size)
        use = Counter(chosen)
        times = min(counts[length] // n for length, n in use.items())
        offset = 0
        for length in chosen:
            places.append((length, used[length], times, sequence, offset))
            used[length] += times
            offset += length
        for length, n in use.items():
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
        sequence += times
    return places


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, size: int = SEQUENCE) -> DataFrame:
    """Packs every row of docs: doc_id, piece, start, length, ids_crc32, sequence_id and offset, one row per piece."""
    cut = pieces(docs, tokenizer, size)
    per_task = cut.groupBy("task", "length").count()
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    per_task = cut_lineage(per_task.withColumn("before", F.coalesce(F.sum("count").over(earlier), F.lit(0))))
    # At most `size` rows reach the driver.
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places = np.array(sorted(plan(histogram, size)), dtype=np.int64).reshape(-1, 5)
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(places)

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        # Places are sorted by length and first rank: one key finds a piece's place.
        width = int((table[:, 1] + table[:, 2]).max()) + 1 if len(table) else 1
        starts = table[:, 0] * width + table[:, 1]
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            row = table[np.searchsorted(starts, batch.column("length").to_numpy() * width + rank, side="right") - 1]
            columns = [*batch.columns[:5], pa.array(row[:, 3] + rank - row[:, 1], pa.int64()), pa.array(row[:, 4], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = cut.join(per_task.select("task", "length", "before"), ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(placed, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
