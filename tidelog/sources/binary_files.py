"""Sources for the binary files of a single-process store: its runs, its log and its key dictionary.

Files are read with Spark's ``binaryFile`` source, one task per few files, and decoded
in Arrow batches to the mutation schema, so that an old store can be read, scanned
and compacted like any other log.  Records whose checksum fails are left out.

Layouts (integers little-endian, CRC-32 over all that follows it in the record):

* run record: crc u32, ts 16 bytes (nanoseconds in the first 8), tombstone u8 (1: deleted),
  key size u64, value size u64, key, value; compressed: crc, ts, tombstone, key id uvarint and, unless
  deleted, value size uvarint and value.
* run in one file: six u64 offsets (data, index, summary, filter, metadata, end), then these
  sections; in several files: ``*-Data.db`` holds the records, filled up with zeros.
* log record: as a run record, but with a kind u8 (0 full, 1 first, 2 middle, 3 last) behind the tombstone, which
  is 0 for deleted; no record reaches over a block, a block without room for a header
  ends in zeros, and the first block of a segment starts with ``WAL`` and its number, u32.
* dictionary: id uvarint, key size uvarint, key.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.session import cut_lineage, ship

# The layouts of headers.
_RUN = struct.Struct("<I8s8xBQQ")
_LOG = struct.Struct("<I8s8xBBQQ")
_PREFIX = struct.Struct("<I16sB")
_OFFSETS = struct.Struct("<6Q")
_SEGMENT_HEADER = 7
_FULL, _FIRST, _MIDDLE, _LAST = range(4)

RECORD = "path string, position long, ts long, tombstone boolean, key binary, key_id long, value binary"
#: What a segment yields: whole records, and pieces of records that reach over its borders (open: the record goes on in the next segment; late: it began in an earlier one).
PIECE = "segment long, position long, open boolean, late boolean, ts long, tombstone boolean, key binary, value binary"
#: Rows that a worker turns to Arrow at once.
SLICE = 5000


def _uvarint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        at += 1
        if data[at - 1] < 128:
            return value, at
        shift += 7


def run_records(data: bytes, single: bool, compressed: bool) -> Iterator[tuple]:
    """(position, ts, tombstone, key, key id, value) of the intact records of a run's file; key or key id is None."""
    at, end = 0, len(data)
    if single:
        at, end = _OFFSETS.unpack_from(data)[:2]
    first = at
    try:
        while at < end:
            if not compressed:
                crc, ts, gone, key_size, value_size = _RUN.unpack_from(data, at)
                key_at = at + _RUN.size
                stop = key_at + key_size + value_size
                key_id, key, value = None, data[key_at : key_at + key_size], data[key_at + key_size : stop]
            else:
                crc, stamp, gone = _PREFIX.unpack_from(data, at)
                ts, key = stamp[:8], None
                key_id, stop = _uvarint(data, at + _PREFIX.size)
                value = b""
                if not gone:
                    size, stop = _uvarint(data, stop)
                    value, stop = data[stop : stop + size], stop + size
            if not crc or stop > end:
                return
            if zlib.crc32(data[at + 4 : stop]) == crc:
                yield at - first, int.from_bytes(ts, "little"), bool(gone), key, key_id, value
            at = stop
    except (struct.error, IndexError):
        return  # the file ends within a record


def log_fragments(data: bytes, block: int) -> Iterator[tuple]:
    """(position, kind, ts, tombstone, key, value) of the intact fragments of a log segment."""
    for start in range(0, len(data), block):
        part = data[start : start + block]
        at = _SEGMENT_HEADER if start == 0 else 0
        while len(part) - at >= _LOG.size:
            crc, ts, live, kind, key_size, value_size = _LOG.unpack_from(part, at)
            key_at = at + _LOG.size
            stop = key_at + key_size + value_size
            if not crc or stop > len(part):
                break
            if zlib.crc32(part[at + 4 : stop]) == crc:
                yield start + at, kind, int.from_bytes(ts, "little"), not live, part[key_at : key_at + key_size], part[key_at + key_size : stop]
            at = stop


def log_pieces(data: bytes, block: int) -> Iterator[tuple]:
    """(position, open, late, ts, tombstone, key, value) of a segment's records and of the pieces of those that reach over its borders.

    The fragments of a record follow one another without a gap: each later one starts the very next block,
    with the same time stamp and tombstone.  What breaks off is left out.
    """
    last_block = (len(data) - 1) // block
    # What goes on: (position, late, ts, tombstone, keys, values, block of the last fragment).
    held: list | None = None
    for position, kind, ts, gone, key, value in log_fragments(data, block):
        at = position // block
        starts = position == at * block + (0 if at else _SEGMENT_HEADER)
        if kind in (_MIDDLE, _LAST):
            if held and starts and at == held[6] + 1 and (ts, gone) == (held[2], held[3]):
                held[4].append(key)
                held[5].append(value)
                held[6] = at
            else:
                # A record that began in an earlier segment goes on in the first block.
                held = [position, True, ts, gone, [key], [value], at] if starts and not at else None
            if held and kind == _LAST:
                yield held[0], False, held[1], ts, gone, b"".join(held[4]), b"".join(held[5])
                held = None
        elif kind == _FIRST:
            held = [position, False, ts, gone, [key], [value], at]
        else:
            held = None
            if kind == _FULL:
                yield position, False, False, ts, gone, key, value
    if held and held[6] == last_block:
        yield held[0], True, held[1], held[2], held[3], b"".join(held[4]), b"".join(held[5])


def dictionary_entries(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(data) and data[at]:
        number, at = _uvarint(data, at)
        size, at = _uvarint(data, at)
        yield number, data[at : at + size]
        at += size


def _decoded(files: DataFrame, decode, schema: str) -> DataFrame:
    """One row per item that decode(path, content) yields."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for found in batched(decode(path, content), SLICE):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names)

    ship(files.sparkSession)
    return files.select("path", "content").mapInArrow(rows, schema)


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """id and key of a dictionary file."""
    entries = _decoded(spark.read.format("binaryFile").load(path), lambda _, data: dictionary_entries(data), "id long, raw binary")
    return entries.select("id", F.decode("raw", "UTF-8").alias("key"))


def _mutations(rows: DataFrame) -> DataFrame:
    """Raw records as mutations; seq is the place in the file."""
    value = F.when(~F.col("tombstone"), F.decode("value", "UTF-8"))
    return rows.select("key", value.alias("value"), "ts", F.col("position").alias("seq"), "tombstone")


def read_runs(spark: SparkSession, folder: str, single: bool = True, dictionary: DataFrame | None = None) -> DataFrame:
    """The mutations of all runs below folder; those of compressed runs need the key dictionary (id, key)."""
    compressed = dictionary is not None

    def decode(path: str, data: bytes) -> Iterator[tuple]:
        for position, ts, gone, key, key_id, value in run_records(data, single, compressed):
            yield path, position, ts, gone, key, key_id, value

    rows = _decoded(_files(spark, folder, "*.db" if single else "*-Data.db"), decode, RECORD)
    if not compressed:
        return _mutations(rows.withColumn("key", F.decode("key", "UTF-8")))
    return _mutations(rows.drop("key").join(dictionary.select(F.col("id").alias("key_id"), "key"), "key_id"))


def read_log(spark: SparkSession, folder: str, block: int) -> DataFrame:
    """The mutations of a log's segments, put together from their fragments; records with a fragment missing are left out.

    Records are put together where their segment is read.  Only pieces that reach over the borders of
    segments meet others: one that is open goes on in the next segment's late one, if its time stamp is the same.
    """

    def decode(path: str, data: bytes) -> Iterator[tuple]:
        segment = int.from_bytes(data[3:_SEGMENT_HEADER], "little") if data[:3] == b"WAL" else 0
        for piece in log_pieces(data, block):
            yield segment, *piece

    pieces = _decoded(_files(spark, folder, "*.log"), decode, PIECE)
    whole = pieces.filter("not open and not late")
    edges = cut_lineage(pieces.filter("open or late"))
    # The numbers of segments alone show which pieces belong together: a chain begins where a piece is not late, or doesn't go on from the segment before.
    order = Window.orderBy("segment", "position")
    before = lambda name: F.lag(name).over(order)
    goes_on = F.col("late") & before("open") & (before("segment") == F.col("segment") - 1) & (before("ts") == F.col("ts")) & (before("tombstone") == F.col("tombstone"))
    links = edges.select("segment", "position", "late", "open", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1).alias("begins"))
    chains = links.select("segment", "position", F.sum("begins").over(order).alias("chain"))
    held = edges.join(chains, ["segment", "position"])
    grouped = held.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("segment", "position", "open", "late", "ts", "tombstone", "key", "value"))).alias("parts"))
    first, last = F.element_at("parts", 1), F.element_at("parts", -1)
    joined = lambda name: F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p[name])), ""))
    cut = grouped.filter(~first["late"] & ~last["open"]).select(first["segment"].alias("segment"), first["position"].alias("position"), first["ts"].alias("ts"), first["tombstone"].alias("tombstone"), joined("key").alias("key"), joined("value").alias("value"))
    rows = whole.select(*cut.columns).unionByName(cut).withColumn("key", F.decode("key", "UTF-8"))
    return _mutations(rows.withColumn("position", F.shiftleft("segment", 32) + F.col("position")))
