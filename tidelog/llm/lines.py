"""Line dedup by overlapping windows of consecutive lines, with DataFrame functions only.

Lines that hold more than white space are hashed in overlapping windows of three.  A
window that occurs more than once in the corpus stays where it occurs first (by
doc_id, then text hash, then line); of its later occurrences all lines from the
first to the last of the window go.  Positions covered by several windows are merged.

Windows are counted with partial sums.  Those that repeat, and later the positions that
go, are written out before they are joined back by hash: both sides of each join are then
dealt for it alone, and adaptive execution splits the partition of a window or document that
a third of all rows hold, so that it is not gathered in one task.

Edge cases: a null or empty text has no window and stays.  Texts with fewer than
three filled lines stay as they are.  Blank lines between the lines of a window go
with it, others stay.  Lines are compared without white space at their ends.  Rows
that are equal in doc_id and text count as one document and get the same result.  A
null doc_id comes first in the order.  Extra columns are kept, whatever their names.
Very long texts are handled whole, in time in proportion to their lines: each is split
a fixed number of times, however many of its lines go.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import cut_lineage

WINDOW = 3
_BLANKS = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, first, last, h1, h2): every window of filled lines with its 128-bit hash."""
    trimmed = F.transform(_lines(F.col("text")), lambda line, at: F.struct(at.alias("at"), F.btrim(line, F.lit(_BLANKS)).alias("line")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.filter(trimmed, lambda x: x["line"] != "").alias("filled")).filter(F.size("filled") >= window)
    starts = F.sequence(F.lit(0), F.size("filled") - window)

    def hashed(k: Column) -> Column:
        last = F.get("filled", k + (window - 1))["at"]
        joined = F.concat_ws("\n", *[F.get("filled", k + n)["line"] for n in range(window)])
        return F.struct(F.get("filled", k)["at"].alias("first"), last.alias("last"), F.xxhash64(joined).alias("h1"), F.xxhash64(F.lit(1), joined).alias("h2"))

    return rows.select("doc_id", "text_key", F.explode(F.transform(starts, hashed)).alias("w")).select("doc_id", "text_key", "w.*")


def covered(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, removed): the distinct line numbers, from 0, that later occurrences of windows cover."""
    found = windows(docs, window)
    place = F.struct("doc_id", "text_key", "first")
    repeated = found.groupBy("h1", "h2").agg(F.min(place).alias("kept"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = found.join(cut_lineage(repeated), ["h1", "h2"]).filter(~place.eqNullSafe(F.col("kept")))
    spans = F.transform(F.collect_set(F.struct("first", "last")), lambda s: F.sequence(s["first"], s["last"]))
    return later.groupBy("doc_id", "text_key").agg(F.array_distinct(F.flatten(spans)).alias("removed"))


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows and columns of docs with the repeated lines taken out of text, as a struct each: (row, n_lines, n_removed, text)."""
    gone = cut_lineage(covered(docs.select("doc_id", "text"), window)).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "removed")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64("text").alias("_row_key"))
    joined = rows.join(gone, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_row_key") == F.col("_key")), "left")
    text, lines = F.col("row.text"), _lines(F.col("row.text"))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(lines))
    # A generator's output is a column of its own: the split text, made once, and not once per line in the lambda below.
    split = joined.select("row", "removed", F.explode(F.array(F.when(F.col("removed").isNotNull(), lines))).alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed"))
    kept = F.array_join(F.transform(left, lambda k: F.get("lines", k)), "\n")
    return split.select("row", n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.when(F.col("removed").isNull(), text).otherwise(kept).alias("text"))


def report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that is left, for every row of docs."""
    return dedup_lines(docs.select("doc_id", "text"), window).select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", "text")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All rows and columns of docs with the text that is left (and n_chars, if there is one, counted anew)."""
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return dedup_lines(docs, window).select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def report_sql(source: str = "documents", window: int = WINDOW) -> str:
    """DuckDB SQL for ``report`` where doc_id is unique and not null."""
    blanks = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"
    joined = " || chr(10) || ".join(f"lead(line, {k}) OVER doc" if k else "line" for k in range(window))
    return f"""
WITH raw AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS raw FROM {source}),
filled AS (SELECT doc_id, pos, trim(raw, {blanks}) AS line FROM raw WHERE trim(raw, {blanks}) <> ''),
wins AS (SELECT doc_id, pos, lead(pos, {window - 1}) OVER doc AS fin, {joined} AS win FROM filled WINDOW doc AS (PARTITION BY doc_id ORDER BY pos)),
later AS (SELECT doc_id, pos, fin FROM (SELECT *, row_number() OVER (PARTITION BY md5(win) ORDER BY doc_id, pos) AS nth FROM wins WHERE fin IS NOT NULL) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, fin + 1)) AS pos FROM later),
told AS (
  SELECT raw.doc_id, count(*) AS n_lines, count(gone.pos) AS n_removed, string_agg(raw.raw, chr(10) ORDER BY raw.pos) FILTER (gone.pos IS NULL) AS text
  FROM raw LEFT JOIN gone ON raw.doc_id = gone.doc_id AND raw.pos = gone.pos GROUP BY raw.doc_id)
SELECT d.doc_id, coalesce(told.n_lines, 0)::BIGINT AS n_lines, coalesce(told.n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN coalesce(told.text, '') END AS text
FROM {source} d LEFT JOIN told ON d.doc_id = told.doc_id"""
