"""Media columns: content-defined chunking with a shared chunk store.

A payload (the UTF-8 text, padded with zero bytes) is kept as 8-bit PCM samples
in a WAV container.  A rolling gear hash cuts the container into chunks.  Chunk
digests are deduplicated by Spark joins: of all media that hold a chunk, the
first (by media hash and position) owns and stores it, the others only list it.
A medium is rebuilt from its ordered chunk list, checked against its SHA-256
and decoded again.

Edge cases: a null or empty text is a payload of 64 zero bytes.  Equal texts
share one medium, so repeated rows and large groups of copies cost one rebuild.
``doc_id`` may be null or repeat; rows are never joined by it.  Very long texts are
handled whole, one at a time, with a chunk of it in each row where chunks are
exchanged.  Extra columns are ignored.  An empty table gives an empty result.

A chunk that a third of all media hold is a hot digest: owners are counted with
partial sums and written out before media join them, so that adaptive execution
can split the digest's partition.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import cut_by, cut_lineage, sliced, texts_of

PAD = 64
SAMPLE_RATE = 8000
#: Chunk sizes in bytes: least, mask bits (a cut every 2**bits bytes on average) and most.
MIN_CHUNK, MASK_BITS, MAX_CHUNK = 1024, 12, 16384
#: A 32-bit gear hash forgets bytes that are older than this.
GEAR_WINDOW = 32
#: Bytes whose hashes or steps are held at once.
BLOCK = 1 << 20
#: Media that one task remembers so as to send equal ones only once.
SEEN_MEDIA = 200_000
REBUILT = "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
COLUMNS = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks"]
_WAV = struct.Struct("<4sI4s4sIHHIIHH4sI")


def gear_table(key: bytes = b"gear") -> np.ndarray:
    """256 32-bit values, made from a rule: a keyed digest of each byte."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([b]), key=key, digest_size=4).digest(), "little") for b in range(256)], dtype=np.uint32)


GEAR = gear_table()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte, h = 2h + GEAR[byte] mod 2**32, by doubling the window covered."""
    h = GEAR[data]
    span = 1
    while span < GEAR_WINDOW:
        shifted = np.zeros_like(h)
        shifted[span:] = h[:-span] << np.uint32(span)
        h = h + shifted
        span *= 2
    return h


def cut_candidates(data: np.ndarray) -> np.ndarray:
    """The sorted positions whose hash allows a cut; hashes are made of BLOCK bytes at a time."""
    mask, found = np.uint32(((1 << MASK_BITS) - 1) << (32 - MASK_BITS)), [np.zeros(0, dtype=np.int64)]
    for at in range(0, len(data), BLOCK):
        begin = max(0, at - GEAR_WINDOW + 1)
        hashes = gear_hashes(data[begin : at + BLOCK])[at - begin :]
        found.append(np.flatnonzero((hashes & mask) == 0) + at)
    return np.concatenate(found)


def cut_points(candidates: np.ndarray, start: int, end: int) -> list[int]:
    """Ends of the chunks of data[start:end]; candidates are the sorted positions whose hash allows a cut.

    A chunk has at least MIN_CHUNK bytes (the last may be shorter), so the hash at a
    cut depends on bytes of that chunk alone, and equal contents get equal cuts.
    """
    cuts = []
    while end - start > MIN_CHUNK:
        k = int(np.searchsorted(candidates, start + MIN_CHUNK - 1))
        found = int(candidates[k]) + 1 if k < len(candidates) else end
        start = min(found, start + MAX_CHUNK, end)
        cuts.append(start)
    if not cuts or cuts[-1] < end:
        cuts.append(end)
    return cuts


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(PAD - len(raw) % PAD if len(raw) % PAD or not raw else 0)


def encode_media(payload: bytes) -> bytes:
    """The payload as a mono WAV file of unsigned 8-bit samples."""
    n = len(payload)
    return _WAV.pack(b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", n) + payload


def decode_media(media: bytes) -> bytes:
    fields = _WAV.unpack_from(media)
    if fields[0] != b"RIFF" or fields[11] != b"data" or fields[12] != len(media) - _WAV.size:
        raise ValueError("not a WAV file of this form")
    return media[_WAV.size :]


def chunked(medias: list[bytes]) -> list[list[bytes]]:
    """The chunks of each medium."""
    joined = np.frombuffer(b"".join(medias), dtype=np.uint8)
    candidates = cut_candidates(joined)
    out, start = [], 0
    for media in medias:
        last, chunks = start, []
        for cut in cut_points(candidates, start, start + len(media)):
            chunks.append(media[last - start : cut - start])
            last = cut
        out.append(chunks)
        start += len(media)
    return out


def features_of(payload: bytes) -> str:
    """Statistics of the samples: count, mean, extremes and mean absolute step."""
    x = np.frombuffer(payload, dtype=np.uint8)
    steps = sum(int(np.abs(np.diff(x[at : at + BLOCK + 1].astype(np.int16))).sum(dtype=np.int64)) for at in range(0, len(x), BLOCK))
    return f"samples={len(x)};mean={int(x.sum(dtype=np.int64)) / len(x):.4f};min={int(x.min())};max={int(x.max())};step={steps / max(1, len(x) - 1):.4f}"


def _listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "media", "n_bytes", "digests"]
    for batch in sliced(batches, "text"):
        payloads = [payload_of(t) for t in texts_of(batch)]
        medias = [encode_media(p) for _, p in payloads]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([hashlib.sha256(m).digest() for m in medias], pa.binary()),
                pa.array([n for n, _ in payloads], pa.int64()),
                pa.array([[hashlib.sha256(c).digest() for c in chunks] for chunks in chunked(medias)], pa.list_(pa.binary())),
            ],
            names=names,
        )


def _stored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack, seen = zstandard.ZstdCompressor(level=6).compress, set()
    for batch in sliced(batches, "text"):
        keys, medias = [], []
        for text in dict.fromkeys(texts_of(batch)):
            media = encode_media(payload_of(text)[1])
            key = hashlib.sha256(media).digest()
            if key not in seen:
                if len(seen) < SEEN_MEDIA:
                    seen.add(key)
                keys.append(key)
                medias.append(media)
        if keys:
            packed = [[pack(c) for c in chunks] for chunks in chunked(medias)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(packed, pa.list_(pa.binary()))], names=["media", "chunks"])


def _row_bytes(column: pa.ListArray, field: str | None = None) -> np.ndarray:
    """The bytes of each row of a column of lists (of binaries, or of structs with such a field)."""
    held = pc.list_flatten(column)
    lengths = pc.fill_null(pc.binary_length(held.field(field) if field else held), 0)
    return np.bincount(pc.list_parent_indices(column).to_numpy(), weights=lengths.to_numpy(), minlength=len(column))


def _rebuilt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in cut_by(whole, _row_bytes(whole.column("own")) + _row_bytes(whole.column("fetched"), "data")):
            yield _rebuilt_batch(batch)


def _rebuilt_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    unpack = zstandard.ZstdDecompressor().decompress
    rows = []
    for key, own, fetched in zip(*(batch.column(c).to_pylist() for c in ("media", "own", "fetched")), strict=True):
        for chunk in fetched or ():
            own[chunk["seq"]] = chunk["data"]
        media = b"".join(map(unpack, own))
        if hashlib.sha256(media).digest() != key:
            raise ValueError(f"medium {key.hex()} was not rebuilt from its chunks")
        payload = decode_media(media)
        rows.append((key, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media), key.hex(), features_of(payload)))
    names = ["media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def chunk_lists(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, media (SHA-256 of the stored form), n_bytes and the ordered chunk digests."""
    lists = docs.select("doc_id", "text").mapInArrow(_listed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, media binary, n_bytes long, digests array<binary>")
    return cut_lineage(lists)


def placements(lists: DataFrame) -> DataFrame:
    """Where each listed chunk of each distinct medium is stored: digest, media, seq, owner (of media and seq), held (by how many)."""
    listed = lists.groupBy("media").agg(F.first("digests").alias("digests"))
    refs = listed.select("media", F.posexplode("digests").alias("seq", "digest"))
    owners = refs.groupBy("digest").agg(F.count("*").alias("held"), F.min(F.struct("media", "seq")).alias("owner")).filter("held > 1")
    return refs.join(cut_lineage(owners), "digest")


def stored_media(docs: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(media with the chunks they own, null where another medium owns one; the chunks that are listed elsewhere, by digest)."""
    wide = docs.select("text").mapInArrow(_stored, "media binary, chunks array<binary>").groupBy("media").agg(F.first("chunks").alias("chunks"))
    is_own = F.col("owner") == F.struct("media", "seq")
    by_media = places.groupBy("media").agg(
        F.collect_list(F.when(~is_own, F.col("seq"))).alias("foreign"),
        F.collect_list(F.when(is_own, F.struct("seq", "digest"))).alias("lent"),
    )
    held = wide.join(by_media, "media", "left")
    # The runs of chunks between foreign ones, with a null in each foreign one's place.
    at = F.sort_array("foreign")
    runs = F.zip_with(
        F.concat(F.array(F.lit(-1)), at),
        F.concat(at, F.array(F.size("chunks"))),
        lambda a, b: F.concat(F.when(a < 0, F.array().cast("array<binary>")).otherwise(F.array(F.lit(None).cast("binary"))), F.slice("chunks", a + 2, b - a - 1)),
    )
    own = F.flatten(runs)
    media = held.select("media", F.when(F.size("foreign") > 0, own).otherwise(F.col("chunks")).alias("own"))
    shared = held.select("chunks", F.explode("lent").alias("lent")).select(F.col("lent.digest").alias("digest"), F.element_at("chunks", F.col("lent.seq") + 1).alias("data"))
    return media, shared


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores every text of docs as chunked media, rebuilds each medium and computes its columns.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature and n_chunks, one row per row of docs.
    """
    lists = chunk_lists(docs)
    places = cut_lineage(placements(lists))
    media, shared = stored_media(docs, places)
    foreign = places.filter(F.col("owner") != F.struct("media", "seq")).select("digest", "media", "seq")
    fetched = foreign.join(shared, "digest").groupBy("media").agg(F.collect_list(F.struct("seq", "data")).alias("fetched"))
    rebuilt = media.join(fetched, "media", "left").mapInArrow(_rebuilt, REBUILT)
    rows = lists.select("doc_id", "media", "n_bytes", F.size("digests").alias("n_chunks"))
    return rows.join(rebuilt, "media").select(*COLUMNS)


CHUNKS, LISTS = "chunks", "lists"


def write_store(docs: DataFrame, path: str) -> None:
    """Stores every text of docs below path: a table of distinct chunks (digest, data) and the ordered chunk list of each row (doc_id, media, n_bytes, digests)."""
    lists = chunk_lists(docs)
    lists.write.parquet(f"{path}/{LISTS}")
    media, _ = stored_media(docs, cut_lineage(placements(lists)))
    digests = lists.groupBy("media").agg(F.first("digests").alias("digests"))
    owned = media.join(digests, "media").select(F.explode(F.arrays_zip("digests", "own")).alias("c")).select(F.col("c.digests").alias("digest"), F.col("c.own").alias("data")).filter("data is not null")
    owned.write.parquet(f"{path}/{CHUNKS}")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The columns of ``media_columns`` for every row stored below path, with each medium put together from its chunk list and checked."""
    lists, chunks = spark.read.parquet(f"{path}/{LISTS}"), spark.read.parquet(f"{path}/{CHUNKS}")
    listed = lists.groupBy("media").agg(F.first("digests").alias("digests"))
    refs = listed.select("media", F.posexplode("digests").alias("seq", "digest"))
    fetched = refs.join(chunks, "digest").groupBy("media").agg(F.collect_list(F.struct("seq", "data")).alias("fetched"))
    own = F.array_repeat(F.lit(None).cast("binary"), F.size("fetched")).alias("own")
    rebuilt = fetched.select("media", own, "fetched").mapInArrow(_rebuilt, REBUILT)
    rows = lists.select("doc_id", "media", "n_bytes", F.size("digests").alias("n_chunks"))
    return rows.join(rebuilt, "media").select(*COLUMNS)


def bytes_sql() -> str:
    """The lengths and the payload's hash of ``media_columns`` in DuckDB SQL."""
    return f"""
WITH raw AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
sizes AS (SELECT doc_id, raw, octet_length(raw)::BIGINT AS n FROM raw),
padded AS (SELECT *, CASE WHEN n = 0 THEN {PAD} ELSE (n + {PAD - 1}) // {PAD} * {PAD} END AS size FROM sizes)
SELECT doc_id, n AS n_bytes, size AS payload_bytes, sha256(raw || unhex(repeat('00', (size - n)::INT))) AS payload_sha256, size + {_WAV.size} AS media_bytes FROM padded"""
