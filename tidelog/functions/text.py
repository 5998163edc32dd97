"""Words of a text, and similarity fingerprints made of them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.hashing import bit, word32
from tidelog.session import ship

# The stop words.
STOP_WORDS = [
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any",
    "are", "as", "at", "be", "because", "been", "before", "being", "below", "between", "both", "but",
    "by", "could", "did", "do", "does", "doing", "down", "during", "each", "few", "for", "from",
    "further", "had", "has", "have", "having", "he", "her", "here", "hers", "him", "his", "how",
    "i", "if", "in", "into", "is", "it", "its", "it's", "just", "me", "more", "most", "my", "myself",
    "no", "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other", "our", "ours",
    "ourselves", "out", "over", "own", "same", "she", "should", "so", "some", "such", "than", "that",
    "the", "their", "theirs", "them", "themselves", "then", "there", "these", "they", "this", "those",
    "through", "to", "too", "under", "until", "up", "very", "was", "we", "were", "what", "when",
    "where", "which", "while", "who", "whom", "why", "with", "would", "you", "your", "yours",
    "yourself", "yourselves",
]
BITS = 64


def cleaned(text: Column) -> Column:
    """A text's lower-cased letters and white space, all else taken out."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\s]", "")


def clean_words(text: Column) -> Column:
    """The words of a text as an array: lower-cased letters between white space, all else taken out."""
    return F.filter(F.split(cleaned(text), r"\s+"), lambda w: w != "")


def without_stop_words(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS))


def word_weights(docs: DataFrame) -> DataFrame:
    """doc_id, word and weight (its number in the text), stop words left out."""
    words = docs.select("doc_id", F.explode(without_stop_words(clean_words(F.col("text")))).alias("word"))
    return words.groupBy("doc_id", "word").agg(F.count("*").alias("weight"))


def digest_digits(digest: Column) -> Column:
    """The last 64 binary digits of an MD5 (hexadecimal), whose bytes are written without leading zeros."""
    words = [word32(digest, k) for k in range(4)]
    digits = F.concat(*[F.bin(F.shiftright(w, shift).bitwiseAND(F.lit(255))) for w in words for shift in (24, 16, 8, 0)])
    return F.substring(F.lpad(digits, 128, "0"), 65, 64)


#: Words that a worker remembers the bits of, and words whose 64 bits it holds apart at once.
CACHED_WORDS, PIECE = 1_000_000, 1 << 17
_DIGITS = [f"{b:b}" for b in range(256)]


def word_bits(word: str) -> int:
    """What ``digest_digits`` has for a word's MD5, as a number."""
    return int("".join(map(_DIGITS.__getitem__, hashlib.md5(word.encode()).digest()))[-BITS:], 2)


def _summed(bits: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each row (the words up to its end) the fingerprint of its words' bits."""
    starts = np.r_[0, ends[:-1]]
    ones = np.zeros((len(ends), BITS), dtype=np.int64)
    for at in range(0, len(bits), PIECE):
        part = np.unpackbits(bits[at : at + PIECE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        # Rows that have words in this piece; those without any share a start with the next one.
        rows = np.flatnonzero((starts < at + len(part)) & (ends > at) & (ends > starts))
        ones[rows] += np.add.reduceat(part, np.maximum(starts[rows] - at, 0), axis=0, dtype=np.int32)
    over = 2 * ones > (ends - starts)[:, None]
    return np.packbits(over, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


def _fingerprinted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int | None] = dict.fromkeys(("", *STOP_WORDS))
    for batch in batches:
        # A cleaned text has no white space beyond ASCII.
        words = pc.ascii_split_whitespace(batch.column("cleaned"))
        ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(), dtype=np.int64)
        coded = pc.list_flatten(words).dictionary_encode()
        if len(known) > CACHED_WORDS:
            known = dict.fromkeys(("", *STOP_WORDS))
        distinct = coded.dictionary.to_pylist()
        for w in distinct:
            if w not in known:
                known[w] = word_bits(w)
        held = [known[w] for w in distinct]
        at = coded.indices.to_numpy()
        counted = np.array([x is not None for x in held], dtype=bool)[at] if held else np.zeros(0, dtype=bool)
        bits = np.array([x or 0 for x in held], dtype=np.uint64)[at[counted]]
        ends = np.r_[0, np.cumsum(counted)][ends]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_summed(bits, ends), pa.int64())], names=["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row of docs; 0 for a text without words.

    A bit is set if more than half of the text's words, repeats included and stop words left out, have it.
    A row's words are folded where the row is, so nothing is shuffled and rows may share an id or have none.
    """
    ship(docs.sparkSession)
    rows = docs.select("doc_id", cleaned(F.col("text")).alias("cleaned"))
    return rows.mapInArrow(_fingerprinted, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint long")


def distance(a: Column, b: Column) -> Column:
    """Differing bits."""
    return F.bit_count(a.bitwiseXOR(b))


def neighbours(fingerprint: Column, radius: int) -> Column:
    """All 64-bit numbers within radius (0 to 2) of a fingerprint."""
    out = F.array(fingerprint)
    if radius > 0:
        out = F.concat(out, F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: fingerprint.bitwiseXOR(bit(i))))
    if radius > 1:
        pairs = F.transform(F.sequence(F.lit(1), F.lit(BITS - 1)), lambda i: F.transform(F.sequence(F.lit(0), i - 1), lambda j: fingerprint.bitwiseXOR(bit(i)).bitwiseXOR(bit(j))))
        out = F.concat(out, F.flatten(pairs))
    return out


def near_pairs(prints: DataFrame, radius: int) -> DataFrame:
    """a, b and distance for pairs of different fingerprints a < b within radius (4 at most); documents with equal ones are one node.

    Two such fingerprints have a number between them, half the radius from each.  Each one is dealt to all
    numbers that near it, so that no number, however crowded its surroundings, brings together more
    fingerprints than it has neighbours itself, and only pairs within the radius are made.
    """
    if not 0 <= radius <= 4:
        raise ValueError("the radius is from 0 to 4")
    distinct = prints.select("fingerprint").distinct()
    left = distinct.select(F.col("fingerprint").alias("a"), F.explode(neighbours(F.col("fingerprint"), (radius + 1) // 2)).alias("between"))
    right = distinct.select(F.col("fingerprint").alias("b"), F.explode(neighbours(F.col("fingerprint"), radius // 2)).alias("between"))
    pairs = left.join(right, "between").filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.withColumn("distance", distance(F.col("a"), F.col("b"))).filter(F.col("distance") <= radius)


def quoted(text: Column) -> Column:
    """text in quotes, inner ones escaped, if it holds a space, tab or quote."""
    return F.when(text.rlike('[ \\t"]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(text)


_PIECE = re.compile(r'''(?P<blank>[ \t]+)|"(?P<quoted>(?:[^"\\]|\\.)*+)"|\\(?P<escaped>.?)|(?P<plain>[^"\\ \t]+)|(?P<open>")''', re.DOTALL)


def tokenize(line: str, compat: bool = True) -> list[str]:
    """The arguments of a command line: quotes group, a backslash takes the next character as it is, spaces and tabs part.

    An unclosed quote is an error.  ``compat`` drops empty quoted arguments.
    """
    words: list[list[str]] = [[]]
    for piece in _PIECE.finditer(line):
        kind = piece.lastgroup
        if kind == "open":
            raise ValueError("a quote is not closed")
        if kind == "blank":
            words.append([])
        else:
            words[-1].append(re.sub(r"\\(.)", r"\1", piece["quoted"], flags=re.DOTALL) if kind == "quoted" else piece[kind])
    return ["".join(parts) for parts in words if any(parts) or parts and not compat]
