"""SentencePiece encoding and decoding by suffix arrays.

The distinct segments of a batch (runs of word-start marks with the characters up to the
next mark; no piece reaches over such a border) are joined to one text, and a suffix array
of that text is built by doubling.  Binary search finds the range of suffixes that start with each
piece, which gives all its occurrences: the edges of a graph over text positions.  The edges are sorted
by position and relaxed: the last piece of the encoding of a prefix is the longest edge
into its end that merging keeps apart from the last piece of the prefix before it.

For a merge-trained vocabulary (BPE) that rule picks the very pieces that merging would:
an encoding is the only path whose neighbouring pieces are never merged
across.  ``Vocabulary.apart`` decides that for a pair from the order in which the
merges inside both pieces happened.  Runs of several word-start marks break the order
(their pieces have scores out of turn) and go through the merges themselves, from a heap.

Edge cases: a null or empty text has no ids.  Characters that are no piece become
their UTF-8 bytes.  The word-start mark itself can't be told from a space, so that a
text with one decodes to a space.  Very long texts are encoded whole, in parts that end
at the borders of segments; only a single segment (a stretch without space or line end)
is always held at once, with the arrays made of it.  ``doc_id`` may be null or repeat;
extra columns, whatever their names, are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from tidelog.llm.common import sliced, texts_of

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Characters of segments that a worker remembers, pairs that it has decided one by one, and slots of its table of those decided in arrays (a power of 2).
CACHED_CHARACTERS, CACHED_PAIRS, PAIR_BITS = 8 << 20, 1 << 20, 20
#: Characters of a text that are cut into segments at once, and of an array of distinct segments.
PART = 1 << 20
#: So few segments (the longest ones of a batch) are relaxed one by one.
FEW = 16
#: A zero character stands for itself, as it marks borders in arrays; no piece holds one.
_SEGMENT = re.compile(f"[\n\0]|{MARK}+[^{MARK}\n\0]*|[^{MARK}\n\0]+")
_RUN = re.compile(f"{MARK}{MARK}")
_START = re.compile("\n|(?<! ) ")


class Vocabulary:
    """A BPE SentencePiece model. Pieces have a rank: single characters first, then merges in their order."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(k) for k in range(n)]
        special = [model.is_control(k) or model.is_unknown(k) or model.is_unused(k) for k in range(n)]
        self.byte_ids = {int(names[k][3:5], 16): k for k in range(n) if model.is_byte(k)}
        plain = [k for k in range(n) if not special[k] and not model.is_byte(k)]
        self.scores = {names[k]: model.get_score(k) for k in plain}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.scores):
            raise ValueError("a piece reaches over the border of a segment")
        single = [k for k in plain if len(names[k]) == 1]
        several = sorted((k for k in plain if len(names[k]) > 1), key=lambda k: (-model.get_score(k), k))
        self.base = len(single)
        self.ids = np.array([*single, *several, 0], dtype=np.int32)  # the last rank stands for a character that is no piece
        self.unknown = len(self.ids) - 1
        self.names = [names[k] for k in self.ids[:-1]]
        self.rank = {p: r for r, p in enumerate(self.names)}
        self.id_of = dict(zip(self.names, self.ids.tolist(), strict=False))
        self.bytes_of = [b"" if special[k] else names[k].replace(MARK, " ").encode() for k in range(n)]
        for value, k in self.byte_ids.items():
            self.bytes_of[k] = bytes([value])
        self._find_merges()
        self.lengths = np.array([len(p) for p in self.names], dtype=np.int64)
        self.codes = np.zeros((len(self.names), self.lengths.max()), dtype=np.uint32)
        for r, p in enumerate(self.names):
            self.codes[r, : len(p)] = list(map(ord, p))
        self.pair_keys = np.full(1 << PAIR_BITS, -1, dtype=np.int64)
        self.pair_apart = np.zeros(1 << PAIR_BITS, dtype=bool)
        self.pairs: dict[tuple[int, int], bool] = {}
        # Tables over all code points, made once: the rank of single characters, and room for a batch's alphabet.
        self.single = np.full(0x110000 + 1, self.unknown, dtype=np.int64)
        self.single[self.codes[: self.base, 0]] = np.arange(self.base)
        self.seen = np.zeros(0x110000 + 1, dtype=bool)
        self.dense = np.zeros(0x110000 + 1, dtype=np.uint64)
        self.byte_table = np.array([self.byte_ids[k] for k in range(256)], dtype=np.int32)

    def _find_merges(self) -> None:
        """For every piece the two that it is merged from; pieces that merging never makes have none."""
        n = len(self.ids)
        self.left, self.right = self.parts = list(range(n)), list(range(n))
        self.merge_of: dict[tuple[int, int], int] = {}
        self.made = np.zeros(n, dtype=bool)
        self.made[: self.base] = self.made[self.unknown] = True
        for r in range(self.base, n - 1):
            name = self.names[r]
            for cut in range(len(name) - 1, 0, -1):
                a, b = self.rank.get(name[:cut], n), self.rank.get(name[cut:], n)
                if a < r and b < r and self.made[a] and self.made[b] and self._apart_one(a, b):
                    self.left[r], self.right[r], self.merge_of[a, b], self.made[r] = a, b, r, True
                    break
        pairs = sorted((a * n + b, r) for (a, b), r in self.merge_of.items())
        self.merge_keys, self.merge_ranks = np.array(pairs, dtype=np.int64).reshape(-1, 2).T.copy()
        self.left, self.right = np.array(self.left), np.array(self.right)

    def apart_pair(self, a: int, b: int) -> bool:
        """What ``apart`` has, for one pair."""
        out = self.pairs.get((a, b))
        if out is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            out = self.pairs[a, b] = self.unknown in (a, b) or self._apart_one(a, b)
        return out

    def _apart_one(self, a: int, b: int) -> bool:
        left, right = self.parts
        over_a = over_b = len(self.ids)
        while True:
            merge = self.merge_of.get((a, b))
            if merge is not None and merge < over_a and merge <= over_b:
                return False
            if max(a, b) < self.base:
                return True
            # Undo the later merge: of equal ones the right one came later.
            if a > b:
                over_a, a = a, right[a]
            else:
                over_b, b = b, left[b]

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge joins the neighbours a and b (or parts of them) at any time."""
        n = len(self.ids)
        out, each = np.ones(len(a), dtype=bool), np.arange(len(a))
        fixed = (a == self.unknown) | (b == self.unknown)
        each, a, b = each[~fixed], a[~fixed], b[~fixed]
        over_a, over_b = np.full(len(a), n), np.full(len(a), n)
        while len(each):
            key = a * n + b
            at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
            merge = np.where(self.merge_keys[at] == key, self.merge_ranks[at], n)
            joined = (merge < over_a) & (merge <= over_b)
            out[each[joined]] = False
            on = ~joined & (np.maximum(a, b) >= self.base)
            each, a, b, over_a, over_b = each[on], a[on], b[on], over_a[on], over_b[on]
            first = a > b
            over_a, over_b = np.where(first, a, over_a), np.where(first, over_b, b)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same through a table of pairs decided before."""
        key = a * np.int64(len(self.ids)) + b
        slot = (key * np.int64(0x9E3779B97F4A7C1) >> np.int64(63 - PAIR_BITS)) & np.int64((1 << PAIR_BITS) - 1)
        new = np.flatnonzero(self.pair_keys[slot] != key)
        out = self.pair_apart[slot]
        if len(new):
            keys, back = np.unique(key[new], return_inverse=True)
            decided = self._apart(keys // len(self.ids), keys % len(self.ids))
            out[new] = decided[back]
            self.pair_keys[slot[new]], self.pair_apart[slot[new]] = key[new], out[new]
        return out

    def merged(self, segment: str) -> list[int]:
        """Ids by merging the best-scored neighbours, the leftmost first, until none is left."""
        n, most = len(segment), int(self.lengths.max())
        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int]] = []

        def offer(at: int) -> None:
            if at >= 0 and after[at] < n and (both := size[at] + size[after[at]]) <= most:
                score = self.scores.get(segment[at : at + both])
                if score is not None:
                    heapq.heappush(heap, (-score, at, both))

        for at in range(n):
            offer(at)
        while heap:
            _, at, both = heapq.heappop(heap)
            gone = after[at]
            # What was offered may have been merged otherwise since.
            if not size[at] or gone >= n or size[at] + size[gone] != both:
                continue
            size[at], size[gone], after[at] = both, 0, after[gone]
            if after[at] < n:
                before[after[at]] = at
            offer(before[at])
            offer(at)
        parts = (segment[at : at + k] for at, k in enumerate(size) if k)
        return [k for p in parts for k in ([self.id_of[p]] if p in self.id_of else [self.byte_ids[x] for x in p.encode("utf-8", "surrogatepass")])]


@cache
def vocabulary(model: str = MODEL) -> Vocabulary:
    return Vocabulary(public_tokenizers.path(model))


class SuffixArray:
    """Suffixes of dense codes (0 only at borders), sorted by their first ``depth`` codes at least."""

    def __init__(self, codes: np.ndarray, bits: int, depth: int):
        self.bits, self.wide = bits, 63 // bits
        n = len(codes)
        key = np.zeros(n, dtype=np.uint64)
        for k in range(self.wide):
            key <<= np.uint64(bits)
            key[: max(n - k, 0)] |= codes[k:]
        self.levels = []
        covered = self.wide
        while True:
            order = np.argsort(key, kind="stable").astype(np.int32)
            ordered = key[order]
            fresh = np.r_[True, ordered[1:] != ordered[:-1]]
            starts = np.flatnonzero(fresh)
            self.levels.append(ordered[starts])
            if covered >= depth:
                break
            rank = np.empty(n, dtype=np.uint64)
            rank[order] = np.cumsum(fresh) - 1
            key = rank << np.uint64(32)
            key[: max(n - covered, 0)] |= rank[covered:]
            covered *= 2
        self.order, self.starts = order, np.r_[starts, n]

    def _ranks(self, words: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranges among the distinct keys of a level that start with each word (equally long rows of codes)."""
        length, keys = words.shape[1], self.levels[level]
        if level == 0:
            low = np.zeros(len(words), dtype=np.uint64)
            for k in range(length):
                low = low << np.uint64(self.bits) | words[:, k]
            spare = np.uint64(self.bits * (self.wide - length))
            low <<= spare
            return np.searchsorted(keys, low), np.searchsorted(keys, low | (np.uint64(1) << spare) - np.uint64(1), side="right")
        half = self.wide << (level - 1)
        lo, hi = self._ranks(words[:, :half], level - 1)
        found, lo, hi = lo < hi, lo.astype(np.uint64) << np.uint64(32), hi.astype(np.uint64) << np.uint64(32)
        if length > half:
            lo2, hi2 = self._ranks(words[:, half:], level - 1)
            lo, hi = lo | lo2.astype(np.uint64), lo | hi2.astype(np.uint64)
        a, b = np.searchsorted(keys, lo), np.searchsorted(keys, hi)
        return a, np.where(found, b, a)

    def ranges(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) in ``order`` of the suffixes that start with each word."""
        lo, hi = self._ranks(words, len(self.levels) - 1)
        return self.starts[lo], self.starts[np.maximum(hi, lo)]


def edges(voc: Vocabulary, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end * 32 + 32 - length, piece) of every occurrence in codes of a piece of several characters, sorted by position."""
    seen, dense = voc.seen, voc.dense
    seen[codes] = True
    alphabet = np.flatnonzero(seen)
    dense[alphabet] = np.arange(len(alphabet))
    depth = int(voc.lengths.max())
    array = SuffixArray(dense[codes], max(1, int(len(alphabet)).bit_length()), depth)
    keys, pieces = [], []
    possible = seen[voc.codes].all(axis=1)  # short pieces are filled up with zeros, as borders are
    seen[alphabet] = False
    for length in range(2, depth + 1):
        ranks = np.flatnonzero((voc.lengths == length) & possible & voc.made[:-1])
        if len(ranks):
            first, end = array.ranges(dense[voc.codes[ranks, :length]])
            n = end - first
            at = array.order[np.arange(n.sum()) + np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n)]
            keys.append((at.astype(np.int64) + length) * 32 + 32 - length)
            pieces.append(np.repeat(ranks, n).astype(np.int32))
    if not keys:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
    key = np.concatenate(keys)
    order = np.argsort(key)
    return key[order], np.concatenate(pieces)[order]


def _relax_one(voc: Vocabulary, codes: np.ndarray, begin: int, done: int, size: int, graph: tuple, state: tuple) -> None:
    """Goes on with the one segment at begin from position ``done`` to its end."""
    (first, length, piece), (last, back) = graph, state
    for start in range(done, size, PART):
        # Edges, and the states that they come from, are plain lists for a part of the segment at a time.
        stop, low = min(size, start + PART), max(0, start - int(voc.lengths.max()))
        bounds = first[begin + start + 1 : begin + stop + 2].tolist()
        base = bounds[0]
        lengths, pieces = length[base : bounds[-1]].tolist(), piece[base : bounds[-1]].tolist()
        single = voc.single[codes[begin + start : begin + stop]].tolist()
        states, came = last[begin + low : begin + stop + 1].tolist(), []
        for at in range(start + 1, stop + 1):
            k = at - start - 1
            for e in range(bounds[k] - base, bounds[k + 1] - base):
                before = states[at - lengths[e] - low]
                if before < 0 or voc.apart_pair(before, pieces[e]):
                    states[at - low] = pieces[e]
                    came.append(begin + at - lengths[e])
                    break
            else:
                states[at - low] = single[k]
                came.append(begin + at - 1)
        last[begin + start + 1 : begin + stop + 1] = states[start + 1 - low :]
        back[begin + start + 1 : begin + stop + 1] = came


def encode_segments(voc: Vocabulary, segments: list[str]) -> list[bytes]:
    """The ids of each segment, as little-endian 32-bit integers."""
    if not segments:
        return []
    # A border, code 0, follows each segment.
    codes = np.frombuffer(("\0".join(segments) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size = np.array(list(map(len, segments)))
    ends = np.cumsum(size + 1) - 1
    begins = ends - size
    key, piece = edges(voc, codes)
    into = key >> 5
    length = 32 - (key & 31)
    first = np.searchsorted(into, np.arange(len(codes) + 2))
    last = np.full(len(codes) + 1, -1, dtype=np.int64)
    back = np.zeros(len(codes) + 1, dtype=np.int64)
    live, offset = np.arange(len(segments)), 0
    while len(live := live[size[live] > offset]) > FEW:
        offset += 1
        at = begins[live] + offset
        edge, stop = first[at], first[at + 1]
        while True:
            on = edge < stop
            if not on.any():
                break
            tried, e = at[on], edge[on]
            start = tried - length[e]
            before, own = last[start], piece[e].astype(np.int64)
            fits = before < 0
            inner = np.flatnonzero(~fits)
            fits[inner] = voc.apart(before[inner], own[inner])
            last[tried[fits]], back[tried[fits]] = own[fits], start[fits]
            edge[on] += 1
            keep = np.ones(len(at), dtype=bool)
            keep[np.flatnonzero(on)[fits]] = False
            keep &= edge < stop
            at, edge, stop = at[keep], edge[keep], stop[keep]
        at = begins[live] + offset
        at = at[last[at] < 0]
        last[at], back[at] = voc.single[codes[at - 1]], at - 1
    for k in live.tolist():
        _relax_one(voc, codes, int(begins[k]), offset, int(size[k]), (first, length, piece), (last, back))
    token_end = np.zeros(len(codes) + 1, dtype=bool)
    at, floor = ends.copy(), begins
    while len(at) > FEW:
        on = at > floor
        at, floor = at[on], floor[on]
        token_end[at] = True
        at = back[at]
    for one, least in zip(at.tolist(), floor.tolist(), strict=True):
        while one > least:
            token_end[one] = True
            one = int(back[one])
    places = np.flatnonzero(token_end)
    tokens = last[places]
    ids = voc.ids[tokens]
    # Characters that are no piece become the ids of their UTF-8 bytes.
    unknown = np.flatnonzero(tokens == voc.unknown)
    chars = codes[places[unknown] - 1]
    spelled = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
    count = np.ones(len(places), dtype=np.int64)
    count[unknown] = spelled
    out_at = np.cumsum(count) - count
    out = np.repeat(ids, count).astype("<i4")
    for k in range(4):
        on = np.flatnonzero(spelled > k)
        rest = chars[on] >> (6 * (spelled[on] - 1 - k)).astype(np.uint32)
        value = rest & 63 | 0x80 if k else rest | np.array([0, 0xC0, 0xE0, 0xF0], dtype=np.uint32)[spelled[on] - 1]
        out[out_at[unknown[on]] + k] = voc.byte_table[value]
    bound = np.r_[out_at, len(out)][np.searchsorted(places, np.r_[begins, ends[-1:]], side="right")] * 4
    raw = out.tobytes()
    return [raw[a:b] for a, b in zip(bound.tolist(), bound[1:].tolist(), strict=False)]


def text_parts(text: str, size: int = PART) -> Iterator[str]:
    """text in parts of about size characters that end where segments do: behind a line end, or before a run of spaces."""
    start = 0
    while len(text) - start > size:
        near = text[start : start + size]
        space = near.rfind(" ")
        stop = start + max(near.rfind("\n") + 1, len(near[:space].rstrip(" ")) if space > 0 else 0)
        if stop == start:
            found = _START.search(text, start + size)
            stop = found.start() if found else len(text)
        yield text[start:stop]
        start = stop
    yield text[start:]


class Encoder:
    """Encodes texts, remembering segments that it has met."""

    def __init__(self, model: str = MODEL):
        self.voc = vocabulary(model)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, bytes] = {"\0": np.array([self.voc.byte_ids[0]], dtype="<i4").tobytes()}
        self.held = 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Texts are taken together as far as they make up one part, and longer ones in several."""
        out: list[list[bytes]] = [[] for _ in texts]
        taken: list[tuple[int, list[str]]] = []
        room = PART
        for k, text in enumerate(texts):
            for n, part in enumerate(text_parts(text) if text else ()):
                taken.append((k, _SEGMENT.findall(("" if n else MARK) + part.replace(" ", MARK))))
                room -= len(part)
                if room <= 0:
                    self._encode_taken(taken, out)
                    taken, room = [], PART
        self._encode_taken(taken, out)
        return [np.frombuffer(b"".join(ids), dtype="<i4") for ids in out]

    def _encode_taken(self, taken: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        if self.held > CACHED_CHARACTERS:
            self._forget()
        new = list({s for _, segments in taken for s in segments if s not in self.known})
        self.held += sum(map(len, new))
        plain = [s for s in new if not _RUN.search(s)]
        self.known.update(zip(plain, encode_segments(self.voc, plain), strict=True))
        for s in new:
            if s not in self.known:
                self.known[s] = np.array(self.voc.merged(s), dtype="<i4").tobytes()
        for k, segments in taken:
            out[k].append(b"".join(map(self.known.__getitem__, segments)))

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.voc.bytes_of.__getitem__, ids.tolist()))
        return (raw[1:] if raw.startswith(b" ") else raw).decode("utf-8", "replace")


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and ids (array<int>) for every row of docs."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in sliced(batches, "text"):
            ids = encoder.encode(texts_of(batch))
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            values = pa.array(np.concatenate(ids).astype(np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), values)], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text for every row of (doc_id, ids); null ids give an empty text."""

    def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in batches:
            ids = [np.array(x or [], dtype=np.int32) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(encoder.decode, ids), pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(texts, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trips(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of little-endian 32-bit ids), decoded_sha256 and round_trip for every row of docs."""
    names = ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in sliced(batches, "text"):
            texts = texts_of(batch)
            out = []
            for text, ids in zip(texts, encoder.encode(texts), strict=True):
                again = encoder.decode(ids)
                out.append((len(ids), zlib.crc32(ids.tobytes()), hashlib.sha256(again.encode()).hexdigest(), again == text))
            types = [pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
