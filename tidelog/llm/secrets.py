"""Secret scans with an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its content.  A ledger holds
the findings of each (blob, rule version) that was scanned; a scan covers the pairs
that it lacks, and findings are joined back to all paths that hold the blob.  Copies
and old versions are thus scanned once, and a new rule version rescans everything.

Edge cases: a null text is an empty one.  A path may be null and rows may repeat;
each row gets its blob's findings.  Spans are in code points, end exclusive.
Of spans that overlap, redaction masks their union under the first one's kind.
Very long texts are scanned whole, one at a time, by patterns that read each
character a bounded number of times; redaction cuts a text once for all its spans.
Extra columns, whatever their names, are ignored by ``scan_documents`` and kept by
``redacted``.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import cut_lineage, sliced, texts_of

#: Changes whenever a rule below does.
RULE_VERSION = "3"
# The base rules (kind, pattern, group that counts, least length).
BASE_RULES = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?((?-i:[A-Za-z0-9+/_.=-]+))""", re.IGNORECASE | re.ASCII), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),
)
# A key runs to its END line, whatever stands between but another BEGIN or END; one without an END line, as far as headers, base64 and line ends (escaped ones too) go.
_TO_END = r"[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END (?:[A-Z]+ )*PRIVATE KEY-----"
_NO_END = r"(?:(?:\s|\\+[nr])*+(?:Proc-Type|DEK-Info):[^\r\n\\]*+)*+(?:[A-Za-z0-9+/=\s]|\\+[nr/\s])*+"
#: Rules beyond these: (kind, a string that a match holds, pattern, whose group is the span if it has one).
MORE_RULES = (
    ("pem", "PRIVATE KEY-----", re.compile(rf"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:{_TO_END}|{_NO_END})")),
    # A token starts at the first place for it in a run of its characters, so that each run is read once.
    ("jwt", "eyJ", re.compile(r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?\b(?=eyJ))([A-Za-z0-9_-]{11,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)")),
    ("login", "://", re.compile(r"(?<=://)[^\s/?#:@]*+:[^\s/?#@]{4,}+(?=@)")),
)
KINDS = [*(r[0] for r in BASE_RULES), *(r[0] for r in MORE_RULES)]
#: Addresses (of 32 bytes) that may be broadcast.
BROADCAST_BLOBS = 500_000
_KEYWORDS = ("pass", "secret", "token", "api")
LEDGER_SCHEMA = "blob binary, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, masks string"


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of every span, by start and then kind."""
    found = []
    lowered = text.lower()
    for number, (kind, pattern, group, least) in enumerate(BASE_RULES):
        if kind == "assign" and not any(k in lowered for k in _KEYWORDS) or kind == "access" and "AKIA" not in text:
            continue
        found += [(m.start(), number, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    for number, (_, part, pattern) in enumerate(MORE_RULES, len(BASE_RULES)):
        if part in text:
            found += [(start, number, end) for start, end in (m.span(pattern.groups) for m in pattern.finditer(text))]
    return sorted(found)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Each run of overlapping spans as one, of the first one's kind."""
    out: list[tuple[int, int, int]] = []
    for start, kind, end in spans:
        if out and start < out[-1][2]:
            out[-1] = (*out[-1][:2], max(end, out[-1][2]))
        else:
            out.append((start, kind, end))
    return out


def blob_of() -> Column:
    """The content address of column text."""
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))


def _scanned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        rows = []
        for text in texts_of(batch):
            spans = find(text)
            base = [s for s in spans if s[1] < len(BASE_RULES)]
            counts = [sum(s[1] == k for s in base) for k in range(len(BASE_RULES))]
            rows.append((RULE_VERSION, *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(spans), written(merged(spans))))
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("blob"), *columns], names=["blob", "rule_version", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "masks"])


def scan(versions: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Ledger rows for the blobs of versions (column text) that ledger lacks under this rule version, each scanned once.

    Addresses meet the ledger first.  If those that it lacks are few, they are broadcast, so that no text which was scanned before is shuffled.
    """
    blobs = versions.select(blob_of().alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    if ledger is not None:
        known = ledger.filter(F.col("rule_version") == RULE_VERSION).select("blob").distinct()
        new = cut_lineage(blobs.select("blob").distinct().join(known, "blob", "left_anti"))
        blobs = blobs.join(F.broadcast(new) if new.count() <= BROADCAST_BLOBS else new, "blob", "left_semi")
    unseen = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    return unseen.mapInArrow(_scanned, LEDGER_SCHEMA)


def update(versions: DataFrame, path: str) -> DataFrame:
    """Appends what the Parquet ledger at path lacks for versions; returns the ledger of this rule version."""
    spark = versions.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    ledger = spark.read.schema(LEDGER_SCHEMA).parquet(path) if exists else None
    scan(versions, ledger).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path).filter(F.col("rule_version") == RULE_VERSION).dropDuplicates(["blob"])


def findings(versions: DataFrame, ledger: DataFrame, *columns: str) -> DataFrame:
    """columns of every row of versions, with the findings for its blob from a ledger that has each blob once."""
    rows = versions.select(*columns, blob_of().alias("_blob"))
    found = ledger.select(F.col("blob").alias("_blob"), "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    return rows.join(found, "_blob").drop("_blob")


def scan_documents(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for every row of docs; without a path the ledger is new.

    A new ledger is read once, by the join, and so is not written to a checkpoint first.
    """
    docs = docs.select("doc_id", "text")
    ledger = update(docs, ledger_path) if ledger_path else scan(docs)
    return findings(docs, ledger, "doc_id")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each of spans (apart from each other, in order) replaced by its kind in brackets."""
    parts, at = [], 0
    for start, kind, end in spans:
        parts += [text[at:start], f"[{KINDS[kind]}]"]
        at = end
    return "".join([*parts, text[at:]])


def _parsed(masks: str) -> list[tuple[int, int, int]]:
    return [(int(start), KINDS.index(kind), int(end)) for kind, start, end in (m.split(":") for m in masks.split(","))]


@F.arrow_udf(T.StringType())
def _masked(texts: pa.Array, masks: pa.Array) -> pa.Array:
    """texts with their masks (kind:start:end, comma-joined, in order) replaced; null where there is none."""
    return pa.array((masked(t.as_py() or "", _parsed(m.as_py())) if m.is_valid else None for t, m in zip(texts, masks, strict=True)), pa.string())


def redacted(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """All rows and columns of docs, with the secrets in text replaced (and n_chars, if there is one, counted anew)."""
    ledger = update(docs.select("text"), ledger_path) if ledger_path else cut_lineage(scan(docs.select("text")))
    hits = ledger.filter("masks <> ''").select(F.col("blob").alias("_blob"), F.col("masks").alias("_masks"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), blob_of().alias("_key")).join(hits, F.col("_key") == F.col("_blob"), "left")
    hit, old = F.col("_masks").isNotNull(), F.col("_row.text")
    # Only texts with a secret go through Python.
    rows = rows.withColumn("_text", F.coalesce(_masked(F.when(hit, old), F.col("_masks")), old))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length("_text")).otherwise(F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


def edited() -> Column:
    """Column text as an editor would leave it who takes out the first line of each text that has several."""
    return F.when(F.instr("text", "\n") > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise(F.col("text"))


def scan_versions(docs: DataFrame, path: str) -> DataFrame:
    """version, texts and scanned for two versions of docs, the second one edited, scanned in turn into a ledger at path.

    scanned counts the (blob, rule version) pairs that the ledger lacked, as the ledger's growth tells.
    """
    spark, before, told = docs.sparkSession, 0, []
    for version, rows in enumerate((docs.select("text"), docs.select(edited().alias("text"))), 1):
        update(rows, path)
        held = spark.read.schema(LEDGER_SCHEMA).parquet(path).count()
        told.append((version, rows.count(), held - before))
        before = held
    return spark.createDataFrame(told, "version int, texts long, scanned long")


def scan_versions_sql() -> str:
    """The same in DuckDB SQL."""
    return """
WITH versions AS (
  SELECT 1 AS version, sha256(coalesce(text, '')) AS blob FROM documents
  UNION ALL SELECT 2, sha256(coalesce(CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE text END, '')) FROM documents),
firsts AS (SELECT blob, min(version) AS version FROM versions GROUP BY blob)
SELECT v.version::INT AS version, v.texts, coalesce(f.scanned, 0)::BIGINT AS scanned FROM (SELECT version, count(*) AS texts FROM versions GROUP BY version) v
LEFT JOIN (SELECT version, count(*) AS scanned FROM firsts GROUP BY version) f ON v.version = f.version"""


def base_counts_sql() -> str:
    """doc_id, n_assign, n_access and n_hex in DuckDB SQL; letters of keywords are spelt in both cases, as the pattern's other parts have one."""
    words = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c + ("?" if c == "_" else "") for c in w) for w in ("password", "passwd", "secret", "token", "api_key"))
    assign = f"({words})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    number = lambda pattern, group, least: f"len(list_filter(regexp_extract_all(coalesce(text, ''), '{pattern}', {group}), lambda m: length(m) >= {least}))::BIGINT"
    return f"SELECT doc_id, {number(assign, 2, 8)} AS n_assign, {number('AKIA[A-Z0-9]+', 0, 16)} AS n_access, {number('[0-9a-f]+', 0, 32)} AS n_hex FROM documents"
