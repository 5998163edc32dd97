"""Quality rules: an isolation forest on rule statistics.

Base rules look at counts of words, symbols, repeated lines and repeated word
windows.  The forest judges rates of these statistics: random splits of the space
that the labelled rows span are kept as trees, each over a small sample of rows
labelled good, and a document that random splits part from these rows after few
steps is anomalous.  The score above which a document goes is calibrated on all
labelled rows.

Edge cases: a null, empty or blank text has no words and fails the base rules.
Repeated rows are judged one by one; a null doc_id takes part but has no label.
Without labels only the base rules decide.  Very long texts are measured whole, one
at a time.  Extra columns, whatever their names, are ignored.  An empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import cut_lineage, sliced, texts_of

# Fixed values of the base rules.
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
WINDOW, LEAST_WORDS, MOST_REPEATED_PERCENT = 5, 10, 20

TREES, SAMPLE, DEPTH = 200, 256, 10
#: Bound of the rows labelled good that the forest is fitted on, and the bins of scores in calibration.
FIT_ROWS, BINS = 4096, 2000
#: In calibration a good row that goes counts as this many bad ones that stay.
GOOD_WEIGHT = 4
FEATURES = ("symbol_rate", "mark_rate", "upper_share", "digit_share", "dup_line_share", "repeat_share", "distinct_share", "mean_word", "log_words")
_KIND = bytes(1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b in b"!?\"'()[]{}/\\^_`~@+=:;" else 0 for b in range(256))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in windows of ``window`` words that occur twice or more in the list."""
    grams = list(zip(*(words[k:] for k in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    counts, total, end = Counter(grams), 0, 0
    for at, gram in enumerate(grams):
        if counts[gram] > 1:
            total += at + window - max(end, at)
            end = at + window
    return total


def statistics(text: str) -> tuple[list[int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the forest's features."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at ASCII white space alone
    n = len(words)
    chars = len(text) - sum(map(data.count, range(9, 14))) - data.count(32)
    symbols = sum(map(data.count, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    kinds = data.translate(_KIND)
    per_word, per_char = 1 / max(n, 1), 1 / max(chars, 1)
    features = [symbols * per_word, kinds.count(3) * per_word, kinds.count(1) * per_char, kinds.count(2) * per_char, dup / max(len(lines), 1), repeats * per_word, len(set(words)) * per_word, chars * per_word, math.log1p(n)]
    return [n, chars, symbols, dup, repeats], features


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed and the list of features, written to the checkpoint folder."""
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "features"]

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            rows = [statistics(t) for t in texts_of(batch)]
            counts = [pa.array(c, pa.int64()) for c in zip(*(r[0] for r in rows), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(measured, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, features array<double>")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return cut_lineage(rows.withColumn("base_failed", failed))


class IsolationForest:
    """Trees of random splits in heap order: node k has children 2k + 1 and 2k + 2."""

    def __init__(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        nodes = (1 << (DEPTH + 1)) - 1
        self.feature = np.full((TREES, nodes), -1, dtype=np.int16)
        self.value = np.zeros((TREES, nodes))
        self.path = np.zeros((TREES, nodes))
        take = min(SAMPLE, len(rows))
        self.usual = self._mean_path(take)
        for tree in range(TREES):
            self._grow(tree, rng, rows[rng.choice(len(rows), take, replace=False)], low, high)

    @staticmethod
    def _mean_path(n: int) -> float:
        """The mean depth of an unsuccessful search in a random binary tree of n rows."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, tree: int, rng: np.random.Generator, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        todo = [(0, 0, rows, low, high)]
        while todo:
            node, depth, rows, low, high = todo.pop()
            wide = np.flatnonzero(high > low)
            if len(rows) < 2 or depth == DEPTH or not len(wide):
                self.path[tree, node] = depth + self._mean_path(len(rows))
                continue
            f = rng.choice(wide)
            # The node's own box is split, empty parts included: rows unlike those fitted on fall into these.
            v = rng.uniform(low[f], high[f])
            self.feature[tree, node], self.value[tree, node] = f, v
            left, right = high.copy(), low.copy()
            left[f] = right[f] = v
            below = rows[:, f] < v
            todo += [(2 * node + 1, depth + 1, rows[below], low, left), (2 * node + 2, depth + 1, rows[~below], right, high)]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1, larger where random splits part a row from the fitted ones sooner."""
        total, each = np.zeros(len(rows)), np.arange(len(rows))
        for tree in range(TREES):
            at = np.zeros(len(rows), dtype=np.int64)
            for _ in range(DEPTH):
                f = self.feature[tree, at]
                inner = f >= 0
                at = np.where(inner, 2 * at + 1 + (rows[each, np.maximum(f, 0)] >= self.value[tree, at]), at)
            total += self.path[tree, at]
        return 2.0 ** (-total / TREES / max(self.usual, 1e-9))


def _scored(rows: DataFrame, forest: IsolationForest) -> DataFrame:
    """rows with their column features replaced by score."""
    held = rows.sparkSession.sparkContext.broadcast(forest)
    keep = [c for c in rows.columns if c != "features"]

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(held.value.scores(x), pa.float64())], names=[*keep, "score"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(scored, f"{schema}, score double")


def threshold(bins: list[tuple[int, int, int]]) -> float:
    """The score above which rows go; bins has (bin, good rows, bad rows)."""
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for k, g, b in bins:
        good[k], bad[k] = g, b
    # Rows in bins from k on go. Of equally good places the middle one is taken.
    cost = GOOD_WEIGHT * np.r_[good[::-1].cumsum()[::-1], 0] / max(good.sum(), 1) + np.r_[0, bad.cumsum()] / max(bad.sum(), 1)
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    return float(best[len(best) // 2]) / BINS


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and score for every row of docs; labels has doc_id and quality (1 is good)."""
    rows = rule_statistics(docs)
    quality = labels.select("doc_id", "quality").filter("doc_id is not null and quality is not null")
    labelled = cut_lineage(rows.filter("n_words > 0").join(quality, "doc_id").select("doc_id", "quality", "features", "base_failed"))
    box = labelled.agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), *[g(F.col("features")[k]).alias(f"{g.__name__}{k}") for g in (F.min, F.max) for k in range(len(FEATURES))]).first()
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    if not box["good"]:
        return rows.select(*columns, (~F.col("base_failed")).alias("kept"), F.lit(None).cast("double").alias("score"))
    low, high = (np.array([box[f"{g}{k}"] for k in range(len(FEATURES))]) for g in ("min", "max"))
    share = min(1.0, 2 * FIT_ROWS / box["good"])
    good = labelled.filter((F.col("quality") == 1) & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003))
    fitted = good.select(F.xxhash64("doc_id").alias("key"), "features").orderBy("key", "features").limit(FIT_ROWS).collect()
    forest = IsolationForest(np.array([r["features"] for r in fitted]), low, high)
    bins = _scored(labelled.filter(~F.col("base_failed")), forest).groupBy(F.floor(F.col("score") * BINS).cast("int").alias("bin")).agg(F.sum((F.col("quality") == 1).cast("int")).alias("good"), F.sum((F.col("quality") != 1).cast("int")).alias("bad"))
    most = threshold([(r["bin"], r["good"], r["bad"]) for r in bins.collect()])
    return _scored(rows, forest).select(*columns, (~F.col("base_failed") & (F.col("score") < most)).alias("kept"), "score")


def statistics_sql() -> str:
    """doc_id, the base statistics and base_failed in DuckDB SQL, where doc_id is unique."""
    blank = "[^\\x20\\x09-\\x0D]"
    grams = " || ' ' || ".join(f"lead(word, {k}) OVER doc" if k else "word" for k in range(WINDOW))
    return f"""
WITH split AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{blank}+') AS words FROM documents),
words AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM split),
grams AS (SELECT doc_id, pos, {grams} AS gram FROM words WINDOW doc AS (PARTITION BY doc_id ORDER BY pos)),
told AS (SELECT doc_id, pos, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS twice FROM grams),
hit AS (SELECT doc_id, max(twice) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS hit FROM told),
repeats AS (SELECT doc_id, count(*) FILTER (hit) AS n FROM hit GROUP BY doc_id),
filled AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{blank}')) AS filled FROM split),
counts AS (
  SELECT s.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(filled) - len(list_distinct(filled)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM split s JOIN filled f ON s.doc_id = f.doc_id LEFT JOIN repeats r ON s.doc_id = r.doc_id)
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed FROM counts"""
