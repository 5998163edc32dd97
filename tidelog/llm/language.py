"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is lower-cased and cut into words of letters; every 2-, 3- and 4-byte
window of a word (one border at each side counted) is hashed to a bucket.  The mean
of the buckets' embeddings goes through a linear softmax.  Both are trained by
stochastic gradient descent in numpy on a bounded sample; a part of that sample
sets the temperature of the scores and when a text is rejected: below a score as the
answers there are wrong as often as right, or no language has a majority; and if far
fewer of its windows were met in training than of any text in that part, as in noise or
in a language that was not learned.

Since everything before the softmax is linear, prediction adds up one row of
class scores per window, in integers, so that equal texts get equal results.

Edge cases: a null text, or one without a letter, is ``und`` with score 0 and is
rejected.  Without any labelled text to learn from, all are ``und``.  A row whose
doc_id is null is never learned from and counts as held out.  Extra columns are
ignored by ``predict`` and kept by ``identified``, whatever their names.  Repeated rows are
judged one by one.  Very long texts are judged whole; class scores are held for a piece of
them at a time.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import sliced, texts_of

UND = "und"
SIZES = (2, 3, 4)
BUCKET_BITS = 15
DIMENSIONS = 16
#: Bound of the training sample: documents of a language, and the sizes in bytes of the snippets taken from each.
SAMPLE_PER_LANGUAGE = 1000
#: Languages that are learned: the most frequent ones, of equally frequent ones the first by name.
LANGUAGES = 1000
SNIPPETS = (24, 90, 400)
#: Examples drawn in training, those of each language equally often.
DRAWN, BATCH, RATE = 48_000, 128, 0.5
#: One document in this many of the sample calibrates.
CALIBRATE_EVERY = 5
#: The least score at which a text can be kept: below it no language has a majority.
MAJORITY = 0.5
#: Class scores are added up as integers of this scale, for so many bytes of text at a time.
SCALE, PIECE = 1 << 12, 1 << 18
#: A text of fewer windows is judged by its score alone. How much less familiar than any text of calibration one may be.
FEW_WINDOWS, SLACK = 20, 3
_SPACE = 32
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else _SPACE for b in range(256))


def normal_bytes(text: str) -> bytes:
    """Lower-cased UTF-8 whose ASCII characters other than letters are spaces, with a space at each end."""
    return b" " + text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS) + b" "


def buckets(data: np.ndarray) -> list[np.ndarray]:
    """For each window size, the bucket of the window at each byte, or 1 << BUCKET_BITS where there is none."""
    space = data == _SPACE
    wide = data.astype(np.uint32)
    none, out, key = np.int32(1 << BUCKET_BITS), [], wide
    inner = np.zeros(len(data), dtype=bool)
    for n in range(2, max(SIZES) + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        key = key[:m] | wide[n - 1 :] << np.uint32(8 * (n - 1))
        if n > 2:
            inner = inner[:m] | space[n - 2 : n - 2 + m]
        else:
            inner = (space[:-1] & space[1:])[:m]
        if n in SIZES:
            index = ((key + np.uint32(n)) * np.uint32(2654435761) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)
            out.append(np.where(inner[:m], none, index))
        if n == 2:
            inner = np.zeros(m, dtype=bool)
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # class scores of each bucket, as integers; the last row is zero
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = MAJORITY
    #: Which buckets training has met (never the last), and the least share of a text's windows that must be in such.
    known: np.ndarray | None = None
    familiar: float = 0.0

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """One row of class scores for each of the normal byte strings."""
        return self.read(texts)[0]

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class scores, windows, windows in buckets that training has met) of each of the normal byte strings."""
        known = np.zeros(len(self.table), dtype=bool) if self.known is None else self.known
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        starts = np.cumsum([0, *map(len, texts)])[:-1]
        sums, counts = np.zeros((len(texts), len(self.languages)), dtype=np.int64), np.zeros((len(texts), 2), dtype=np.int64)
        # Sums are of integers, so that they may be made of a piece of the bytes at a time, wherever texts begin.
        for at in range(0, len(data), PIECE):
            n = min(PIECE, len(data) - at)
            total, number = np.zeros((n, len(self.languages)), dtype=np.int32), np.zeros((n, 2), dtype=np.int32)
            for index in buckets(data[at : at + n + max(SIZES) - 1]):
                index = index[:n]
                total[: len(index)] += self.table[index]
                number[: len(index), 0] += index < 1 << BUCKET_BITS
                number[: len(index), 1] += known[index]
            first, end = np.searchsorted(starts, at, side="right") - 1, np.searchsorted(starts, at + n)
            bounds = np.maximum(starts[first:end] - at, 0)
            # Texts start and end with a space, so a window over the border of two has a space inside.
            sums[first:end] += np.add.reduceat(total, bounds, axis=0, dtype=np.int64)
            counts[first:end] += np.add.reduceat(number, bounds, axis=0, dtype=np.int64)
        return sums / (SCALE * np.maximum(counts[:, :1], 1)) + self.bias, counts[:, 0], counts[:, 1]

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The likeliest language of each text, its probability, and whether the text is rejected."""
        if not texts or not self.languages:
            return [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        logits, windows, met = self.read([normal_bytes(t) for t in texts])
        p = softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        score = p[np.arange(len(p)), best]
        return [self.languages[k] for k in best], score, (score < self.threshold) | (windows >= FEW_WINDOWS) & (met < self.familiar * windows)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _features(snippet: bytes) -> np.ndarray:
    index = np.concatenate([*buckets(np.frombuffer(snippet, dtype=np.uint8)), np.array([], dtype=np.int32)])
    return index[index < 1 << BUCKET_BITS]


def train(snippets: list[bytes], langs: list[str], calibrate: list[bool], seed: int = 7) -> Model:
    """Fits embeddings and softmax by SGD; the snippets marked in calibrate only set temperature and threshold."""
    languages = sorted(set(langs))
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS))
    weights, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    features = [_features(s) for s in snippets]
    target = np.array([languages.index(x) for x in langs])
    used = np.array([k for k, f in enumerate(features) if len(f) and not calibrate[k]], dtype=np.int64)
    share = 1 / np.bincount(target[used], minlength=len(languages)).clip(1)[target[used]]
    drawn = rng.choice(used, DRAWN, p=share / share.sum()) if len(used) else used
    for at in range(0, len(drawn), BATCH):
        rows, rate = drawn[at : at + BATCH], RATE * (1 - at / DRAWN)
        sizes = np.array([len(features[k]) for k in rows])
        flat = np.concatenate([features[k] for k in rows])
        mean = np.add.reduceat(embedding[flat], np.cumsum([0, *sizes])[:-1], axis=0) / sizes[:, None]
        error = softmax(mean @ weights + bias)
        error[np.arange(len(rows)), target[rows]] -= 1
        back = error @ weights.T / sizes[:, None]
        weights -= rate * mean.T @ error / len(rows) * 8
        bias -= rate * error.mean(axis=0)
        # Each example moves the buckets that it has; sums by bucket through sorting.
        order = np.argsort(flat, kind="stable")
        hit, first = np.unique(flat[order], return_index=True)
        embedding[hit] -= rate * np.add.reduceat(np.repeat(back, sizes, axis=0)[order], first, axis=0)
    table = np.zeros((embedding.shape[0] + 1, len(languages)), dtype=np.int32)
    table[:-1] = np.rint(embedding @ weights * SCALE)
    model = Model(languages, table, bias)
    held = [k for k, f in enumerate(features) if calibrate[k] and len(f)]
    if held:
        logits, right = model.logits([snippets[k] for k in held]), target[held]
        loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(held)), right] + 1e-12).mean()
        model.temperature = float(min(2.0 ** (np.arange(-4, 9) / 2), key=loss))
        p = softmax(logits / model.temperature)
        order = np.argsort(p.max(axis=1), kind="stable")
        wrong = np.cumsum(p.argmax(axis=1)[order] != right[order])
        # The longest run of lowest scores that holds as many wrong answers as right ones is rejected.
        run = np.flatnonzero(2 * wrong >= np.arange(1, len(order) + 1))
        if len(run) and run[-1] + 1 < len(order):
            model.threshold = max(MAJORITY, float(p.max(axis=1)[order[run[-1] + 1]]))
        # The share of windows that training has met, in the least familiar text of calibration, with SLACK times its distance from all.
        model.known = np.zeros(len(table), dtype=bool)
        for k in used:
            model.known[features[k]] = True
        shares = [float(model.known[features[k]].mean()) for k in held if len(features[k]) >= FEW_WINDOWS]
        model.familiar = max(0.0, 1 - (1 + SLACK) * (1 - min(shares))) if shares else 0.0
    return model


def held_out() -> Column:
    """Whether a row is kept from learning: crc32 of its id as text, mod 4, is 2 (or the id is null)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))


def _snippets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        out = []
        for key, lang, text in zip(batch.column("key").to_pylist(), batch.column("lang").to_pylist(), texts_of(batch), strict=True):
            data = normal_bytes(text)
            for n, size in enumerate(SNIPPETS):
                at = int.from_bytes(hashlib.blake2b(f"{key}:{n}".encode(), digest_size=8).digest(), "little") % max(1, len(data) - size)
                out.append((b" " + data[at : at + size].strip() + b" ", lang, key % CALIBRATE_EVERY == 0, key))
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.string(), pa.bool_(), pa.int64()), strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=["snippet", "lang", "calibrate", "key"])


def fit(docs: DataFrame, limit: int = SAMPLE_PER_LANGUAGE, languages: int = LANGUAGES) -> Model:
    """Trains on at most ``limit`` documents of each of the ``languages`` most frequent languages; their snippets alone reach the driver."""
    labelled = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id").alias("key"))
    numbers = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not numbers:
        return Model([], np.zeros((1, 0), dtype=np.int32), np.zeros(0))
    # A share of each language that holds about twice the limit, so that no task ranks more.
    share = F.element_at(F.create_map(*[x for lang, n in numbers.items() for x in (F.lit(lang), F.lit(min(1.0, 2 * limit / n)))]), F.col("lang"))
    sample = labelled.filter(F.pmod("key", F.lit(1_000_003)) < share * 1_000_003)
    first = sample.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("key", "text"))).filter(F.col("rank") <= limit)
    rows = first.select("key", "lang", "text").mapInArrow(_snippets, "snippet binary, lang string, calibrate boolean, key long").collect()
    rows.sort(key=lambda r: (r["key"], len(r["snippet"]), bytes(r["snippet"])))
    return train([bytes(r["snippet"]) for r in rows], [r["lang"] for r in rows], [r["calibrate"] for r in rows])


def _predicted(model: Model, docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep's columns of docs and lang_pred, score and rejected; the new ones replace columns of those names."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    added = ["lang_pred", "score", "rejected"]
    keep = [c for c in keep if c.lower() not in added]

    def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in sliced(batches, "_text", 2 << 20):
            langs, scores, rejected = model.judge(texts_of(batch, "_text"))
            lettered = batch.column("_lettered").to_numpy(zero_copy_only=False)
            langs = [x if ok else UND for x, ok in zip(langs, lettered, strict=True)]
            scores = np.where(lettered, scores, 0.0)
            rejected = ~lettered | rejected
            columns = [batch.column(c) for c in keep] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected.astype(bool), pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *added])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string, score double, rejected boolean"])
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(*keep, F.col("text").alias("_text"), lettered.alias("_lettered")).mapInArrow(judged, schema)


def predict(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every row of docs (a model is fitted on docs if none is given)."""
    model = model or fit(docs)
    rows = _predicted(model, docs.select("doc_id", "text"), ["doc_id"])
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of docs, with their columns, that the model does not reject."""
    model = model or fit(docs)
    columns = docs.columns
    return _predicted(model, docs, columns).filter(~F.col("rejected")).select(*columns)
