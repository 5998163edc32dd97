"""Registered queries of the key-value engine, and their DuckDB SQL.

Keys come from ``events`` (a key per user, errors as tombstones), elements of sketches
from ``events.user_id`` and ``lineitem.l_partkey``, texts from ``documents``.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import bloom, cms, hll, text
from tidelog.functions.hashing import modulo, seeded_md5
from tidelog.model import EVENTS_SQL, FINE_SQL, mutations_from_events, user_key
from tidelog.operators import control, dictionary, integrity, resolve, scan, write
from tidelog.operators.ordering import with_row_index
from tidelog.plans import compaction
from tidelog.session import checkpoint_root, cut_lineage
from tidelog.sources import runs, wal
from tidelog.sources.dictionary import DictionaryStore
from tidelog.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

RUN_SIZE, SEGMENT_SIZE, MOST_RUNS, BLOCK = 500, 400, 3, 16
BLOOM = bloom.Bloom.sized(1000, 0.01)
SKETCH = cms.CountMin.sized(0.01, 0.01)
PRECISION = 10
RATE, INTERVAL = 2, 3 * 86400
NEAR = 1
AS_OF = datetime.datetime(2024, 1, 15)

LATEST = f"""log AS ({EVENTS_SQL}),
newest AS (SELECT key, unnest(arg_max(struct_pack(value := value, ts := ts, seq := seq, tombstone := tombstone), (ts, seq))) FROM log GROUP BY key),
snap AS (SELECT key, value, ts, seq FROM newest WHERE NOT tombstone)"""
FINE = f"""log AS ({FINE_SQL}),
newest AS (SELECT key, unnest(arg_max(struct_pack(value := value, ts := ts, seq := seq, tombstone := tombstone), (ts, seq))) FROM log GROUP BY key),
snap AS (SELECT key, value, ts, seq FROM newest WHERE NOT tombstone)"""


def query(sql: str | None = None):
    """Registers a query under its function's name, with SQL if there is any."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str, fine: bool = False) -> DataFrame:
    return mutations_from_events(table(spark, sf_dir, "events"), fine)


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("element"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("element"))


# Resolution.


@query(f"WITH {LATEST} SELECT * FROM snap")
def kv_snapshot(spark, sf_dir):
    return resolve.snapshot(log(spark, sf_dir))


@query(f"WITH log AS ({EVENTS_SQL}) SELECT key, value, ts, seq FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) = 1 AND NOT tombstone")
def kv_snapshot_window(spark, sf_dir):
    return resolve.snapshot_by_window(log(spark, sf_dir))


@query(f"WITH {LATEST} SELECT key, ts, seq FROM newest WHERE tombstone")
def kv_delete_effect(spark, sf_dir):
    return resolve.deleted(log(spark, sf_dir))


@query(f"WITH log AS ({EVENTS_SQL}) SELECT key, count(*) AS versions, count(*) FILTER (tombstone) AS tombstones FROM log GROUP BY key")
def kv_versions_per_key(spark, sf_dir):
    return resolve.version_counts(log(spark, sf_dir))


@query(f"WITH {LATEST.replace(EVENTS_SQL, EVENTS_SQL + f" WHERE ts <= TIMESTAMP '{AS_OF}'")} SELECT * FROM snap")
def kv_as_of(spark, sf_dir):
    return resolve.as_of(log(spark, sf_dir), F.lit(str(AS_OF)).cast("timestamp_ntz"))


@query(f"WITH {LATEST} SELECT * FROM snap")
def merge_runs(spark, sf_dir):
    rows = log(spark, sf_dir)
    return resolve.snapshot(resolve.merge(*[rows.filter(F.col("seq") % 4 == k) for k in range(4)]))


@query(f"WITH log AS ({EVENTS_SQL}) SELECT key, value, ts, seq, tombstone, row_number() OVER (ORDER BY key, ts, seq) - 1 AS row_index FROM log")
def merge_in_order(spark, sf_dir):
    return with_row_index(log(spark, sf_dir), "key", "ts", "seq")


# Points and scans.


@query(f"WITH {LATEST} SELECT key, value FROM snap WHERE key = 'u000042'")
def kv_get(spark, sf_dir):
    return scan.get(log(spark, sf_dir), "u000042")


@query(f"WITH {LATEST} SELECT key, value FROM snap WHERE key = 'nobody'")
def kv_get_missing(spark, sf_dir):
    return scan.get(log(spark, sf_dir), "nobody")


@query(f"WITH {LATEST}, wanted AS (SELECT DISTINCT 'u' || lpad(c_custkey::VARCHAR, greatest(6, length(c_custkey::VARCHAR))::INT, '0') AS key FROM customer) SELECT w.key, s.key IS NOT NULL AS found, s.value FROM wanted w LEFT JOIN snap s ON w.key = s.key")
def kv_multi_get(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(user_key(F.col("c_custkey")).alias("key"))
    return scan.multi_get(log(spark, sf_dir), keys)


@query(f"WITH {FINE} SELECT key, value FROM snap WHERE starts_with(key, 'u0000') ORDER BY key LIMIT 10")
def prefix_scan_page(spark, sf_dir):
    return scan.page(scan.prefix_scan(log(spark, sf_dir, fine=True), "u0000"), 1, 10)


@query(f"WITH {FINE} SELECT key, value FROM snap WHERE starts_with(key, 'u0000') ORDER BY key LIMIT 10 OFFSET 10")
def prefix_scan_page2(spark, sf_dir):
    return scan.page(scan.prefix_scan(log(spark, sf_dir, fine=True), "u0000"), 2, 10)


@query(f"WITH {FINE} SELECT key, value FROM snap WHERE starts_with(key, 'u0000') ORDER BY key LIMIT 10 OFFSET 9999990")
def prefix_scan_past_end(spark, sf_dir):
    return scan.page(scan.prefix_scan(log(spark, sf_dir, fine=True), "u0000"), 1_000_000, 10)


@query(f"WITH {FINE} SELECT key, value FROM snap WHERE key BETWEEN 'u000010' AND 'u000020:view' ORDER BY key LIMIT 25")
def range_scan_page(spark, sf_dir):
    return scan.page(scan.range_scan(log(spark, sf_dir, fine=True), "u000010", "u000020:view"), 1, 25)


@query(f"WITH {LATEST} SELECT key, value FROM snap WHERE key BETWEEN 'u000010' AND 'u000100'")
def range_scan_all(spark, sf_dir):
    return scan.range_scan(log(spark, sf_dir), "u000010", "u000100")


@query(f"WITH {LATEST} SELECT count(*) AS total, (count(*) + 9) // 10 AS total_pages, CASE WHEN count(*) > 20 THEN 21 END::BIGINT AS first_row, CASE WHEN count(*) > 20 THEN least(count(*), 30) END AS last_row FROM snap")
def page_info(spark, sf_dir):
    return scan.page_info(resolve.snapshot(log(spark, sf_dir)), 3, 10)


@query(f"WITH {LATEST} SELECT key, value FROM snap WHERE key > 'u000050' ORDER BY key LIMIT 1")
def iterate_next(spark, sf_dir):
    return scan.after(scan.range_scan(log(spark, sf_dir), "u000010", "u000100"), "u000050")


# Writes.

LITERAL = [write.put("a", "1", 1, 0), write.put("a", "2", 2, 1), write.put("b", "x", 5, 3), write.put("b", "y", 5, 2), write.delete("c", 9, 4), write.put("c", "late", 8, 5), write.put("d", "old", 1, 6), write.delete("d", 2, 7), write.put("d", "new", 3, 8), write.put("e", "", 4, 9)]


@query("SELECT * FROM (VALUES ('a', '2', 2::BIGINT, 1::BIGINT), ('b', 'x', 5, 3), ('d', 'new', 3, 8), ('e', '', 4, 9)) AS t(key, value, ts, seq)")
def batch_put_delete(spark, sf_dir):
    return resolve.snapshot(write.batch(spark, LITERAL))


@query(f"WITH log AS ({EVENTS_SQL} UNION ALL SELECT 'u000042', 'overwritten', TIMESTAMP '2999-01-01', 0, false), newest AS (SELECT key, unnest(arg_max(struct_pack(value := value, tombstone := tombstone), (ts, seq))) FROM log GROUP BY key) SELECT key, value FROM newest WHERE NOT tombstone")
def put_overwrite(spark, sf_dir):
    new = spark.sql("SELECT 'u000042' AS key, 'overwritten' AS value, TIMESTAMP_NTZ '2999-01-01' AS ts, 0L AS seq, false AS tombstone")
    return resolve.snapshot(log(spark, sf_dir).unionByName(new)).select("key", "value")


BATCHES = f"""log AS ({EVENTS_SQL}), batches AS (SELECT *, (row_number() OVER (ORDER BY ts, seq) - 1) // {RUN_SIZE} AS flush_id FROM log),
flushed AS (SELECT flush_id, key, unnest(arg_max(struct_pack(value := value, ts := ts, seq := seq, tombstone := tombstone), (ts, seq))) FROM batches GROUP BY flush_id, key),
manifest AS (SELECT flush_id, min(key) AS min_key, max(key) AS max_key, count(*) AS records, count(*) FILTER (tombstone) AS tombstones FROM flushed GROUP BY flush_id)"""


@query(f"WITH {BATCHES} SELECT flush_id, key, ts, seq, tombstone, value FROM flushed")
def flush_batches(spark, sf_dir):
    return write.flushed(write.flush_batches(log(spark, sf_dir), RUN_SIZE))


@query(f"WITH {BATCHES} SELECT * FROM manifest")
def manifest_ranges(spark, sf_dir):
    return runs.manifest_of(flush_batches(spark, sf_dir))


@query(f"WITH {BATCHES} SELECT a.flush_id, count(*) - 1 AS overlapping FROM manifest a JOIN manifest b ON a.min_key <= b.max_key AND b.min_key <= a.max_key GROUP BY a.flush_id")
def run_overlaps(spark, sf_dir):
    return runs.overlap_counts(manifest_ranges(spark, sf_dir))


@query(f"WITH {BATCHES} SELECT flush_id FROM manifest WHERE min_key <= 'u000100' AND max_key >= 'u000010'")
def runs_meeting_range(spark, sf_dir):
    return runs.meeting(manifest_ranges(spark, sf_dir), F.lit("u000010"), F.lit("u000100"))


@query(f"WITH log AS ({EVENTS_SQL}) SELECT count(DISTINCT key) AS keys, count(DISTINCT key) >= 100 AS full FROM log")
def memtable_full(spark, sf_dir):
    return write.is_full(log(spark, sf_dir), 100)


# Compaction.


def _compacted(spark: SparkSession, sf_dir: str, planner: str) -> DataFrame:
    """The snapshot of a store whose runs (flush batches) the planner has compacted."""
    store = runs.RunStore(spark, f"{checkpoint_root(spark)}/store-{uuid.uuid4().hex}")
    store.append_batches(write.flush_batches(log(spark, sf_dir), 2_000 if planner == "leveled" else 3_000))
    compaction.compact(store, planner, MOST_RUNS)
    return resolve.snapshot(store.read())


@query(f"WITH {LATEST} SELECT * FROM snap")
def compact_size_tiered(spark, sf_dir):
    return _compacted(spark, sf_dir, "size_tiered")


@query(f"WITH {LATEST} SELECT * FROM snap")
def compact_leveled(spark, sf_dir):
    return _compacted(spark, sf_dir, "leveled")


@query(f"WITH {LATEST}, log2 AS (SELECT key, count(*) AS dropped FROM log GROUP BY key) SELECT n.key, l.dropped FROM newest n JOIN log2 l ON n.key = l.key WHERE n.tombstone")
def tombstone_gc(spark, sf_dir):
    rows = log(spark, sf_dir)
    return resolve.deleted(rows).select("key").join(resolve.version_counts(rows), "key").select("key", F.col("versions").alias("dropped"))


# Stored runs.

STORES: dict[tuple[str, str], runs.RunStore] = {}
#: Parts of the events that become runs of their own, so that some key ranges and filters leave runs out.
STORED_RUNS = 8


def stored(spark: SparkSession, sf_dir: str) -> runs.RunStore:
    """A store of all events, keyed by user and event type, in runs of consecutive keys and one of the newest writes; made once per session and table."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in STORES:
        store = runs.RunStore(spark, f"{checkpoint_root(spark)}/stored-{uuid.uuid4().hex}", BLOCK)
        rows = with_row_index(log(spark, sf_dir, fine=True), "key", "ts", "seq")
        n = max(1, rows.count())
        store.append_batches(rows.withColumn("flush_id", F.expr(f"row_index * {STORED_RUNS} div {n}")).drop("row_index"))
        STORES[at] = store
    return STORES[at]


@query(f"WITH {FINE} SELECT key, value FROM snap WHERE key = 'u000042:view'")
def kv_get_stored(spark, sf_dir):
    store = stored(spark, sf_dir)
    held = store.read(key="u000042:view")
    return scan.get(log(spark, sf_dir).limit(0) if held is None else held, "u000042:view")


@query(f"WITH {FINE} SELECT key, value FROM snap WHERE key BETWEEN 'u000010' AND 'u000020:view' ORDER BY key LIMIT 25")
def range_scan_stored(spark, sf_dir):
    held = stored(spark, sf_dir).read("u000010", "u000020:view")
    return scan.page(scan.range_scan(log(spark, sf_dir).limit(0) if held is None else held, "u000010", "u000020:view"), 1, 25)


@query(f"WITH {FINE} SELECT key, value FROM snap WHERE starts_with(key, 'u0000') ORDER BY key LIMIT 10")
def prefix_scan_stored(spark, sf_dir):
    held = stored(spark, sf_dir).read("u0000", runs.successor("u0000"))
    return scan.page(scan.prefix_scan(log(spark, sf_dir).limit(0) if held is None else held, "u0000"), 1, 10)


@query(f"WITH {LATEST} SELECT 'whole' AS state, 0::BIGINT AS bad_blocks, 0::BIGINT AS bad_roots UNION ALL SELECT 'damaged', count(*), 0 FROM newest WHERE key = 'u000042'")
def validate_run(spark, sf_dir):
    """A run is validated as it was written, and again after a value in its files was changed, which nothing had looked at before."""
    store = runs.RunStore(spark, f"{checkpoint_root(spark)}/validated-{uuid.uuid4().hex}", BLOCK)
    store.append(log(spark, sf_dir))
    told = lambda state: store.validate().agg(F.count("block").alias("bad_blocks"), F.count_if(F.col("state") == "root").alias("bad_roots")).select(F.lit(state).alias("state"), "*")
    whole = cut_lineage(told("whole"))
    for row in store.manifest():
        fs, path = store._fs(row["path"])
        held = spark.read.parquet(row["path"])
        other = f"{row['path']}-damaged"
        held.withColumn("value", F.when(F.col("key") == "u000042", "changed").otherwise(F.col("value"))).write.parquet(other)
        fs.delete(path, True)
        fs.rename(store._fs(other)[1], path)
    return whole.unionByName(cut_lineage(told("damaged")))


@query("SELECT * FROM (VALUES ('u0000', 'u0001'), ('z', '{'), ('a~', 'a' || chr(127))) AS t(prefix, successor)")
def prefix_bounds(spark, sf_dir):
    return spark.createDataFrame([(p, runs.successor(p)) for p in ("u0000", "z", "a~")], "prefix string, successor string")


@query(f"WITH {LATEST} SELECT * FROM snap")
def vacuum_keeps_snapshot(spark, sf_dir):
    store = runs.RunStore(spark, f"{checkpoint_root(spark)}/vacuumed-{uuid.uuid4().hex}")
    store.append_batches(write.flush_batches(log(spark, sf_dir), 3_000))
    compaction.compact(store, "size_tiered", MOST_RUNS)
    store.vacuum(0, now=2**40)
    return resolve.snapshot(store.read())


# Log.

SEGMENTS = f"log AS ({EVENTS_SQL}), segs AS (SELECT *, (row_number() OVER (ORDER BY ts, seq) - 1) // {SEGMENT_SIZE} AS segment_id, (row_number() OVER (ORDER BY ts, seq) - 1) % {SEGMENT_SIZE} AS position FROM log)"
CRC_SQL = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(rec) + 1), lambda i: ascii(substr(rec, i, 1))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))"""


@query(f"WITH {SEGMENTS} SELECT segment_id, count(*) AS records, min(seq) AS min_seq, max(seq) AS max_seq, max(position) AS last_position FROM segs GROUP BY segment_id")
def wal_segments(spark, sf_dir):
    rows = wal.segmented(log(spark, sf_dir), SEGMENT_SIZE)
    return rows.groupBy("segment_id").agg(F.count("*").alias("records"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.max("position").alias("last_position"))


@query(f"WITH {LATEST} SELECT * FROM snap")
def wal_replay(spark, sf_dir):
    return resolve.snapshot(wal.replay(wal.segmented(log(spark, sf_dir), SEGMENT_SIZE)))


@query(f"WITH {SEGMENTS} SELECT key, value, ts, seq, tombstone FROM segs WHERE segment_id >= 2")
def wal_truncate(spark, sf_dir):
    return wal.replay(wal.segmented(log(spark, sf_dir), SEGMENT_SIZE), low_watermark=2)


@query("SELECT key, ts, seq, tombstone, coalesce(value, '') AS value FROM (" + EVENTS_SQL + ")")
def wal_fragment_reassembly(spark, sf_dir):
    return wal.reassembled(wal.fragments(log(spark, sf_dir), 5))


@query("SELECT key, seq, CASE WHEN n = 1 THEN 0 WHEN part = 0 THEN 1 WHEN part = n - 1 THEN 3 ELSE 2 END::INT AS kind, part::INT AS part, substr(v, part * 5 + 1, 5) AS data FROM (SELECT *, unnest(range(n)) AS part FROM (SELECT key, seq, coalesce(value, '') AS v, greatest(ceil(length(coalesce(value, '')) / 5)::BIGINT, 1) AS n FROM (" + EVENTS_SQL + ")))")
def wal_fragments(spark, sf_dir):
    return wal.fragments(log(spark, sf_dir), 5).select("key", "seq", "kind", "part", "data")


@query(f"SELECT key, seq, xor(4294967295::BIGINT, {CRC_SQL}) AS crc, true AS ok FROM (SELECT key, seq, key || '=' || coalesce(value, '') || '|' || CASE WHEN tombstone THEN '1' ELSE '0' END AS rec FROM ({EVENTS_SQL}))")
def crc_check(spark, sf_dir):
    rows = integrity.with_crc(log(spark, sf_dir))
    return rows.select("key", "seq", "crc", (F.col("crc") == F.crc32(integrity.payload())).alias("ok"))


# Streams.


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream of mutations. The path is a pattern, as a stream's own path must be a folder and the table may be one file."""
    return mutations_from_events(live.mutations(spark, f"{sf_dir}/events.parque[t]", table(spark, sf_dir, "events").schema))


@query(f"WITH {LATEST} SELECT * FROM snap")
def stream_snapshot(spark, sf_dir):
    root = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    store = runs.RunStore(spark, f"{root}/out")
    live.materialize(_streamed(spark, sf_dir), store, f"{root}/state").awaitTermination()
    return resolve.snapshot(store.read())


@query(f"WITH {LATEST} SELECT * FROM snap")
def stream_flush(spark, sf_dir):
    root = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    store = runs.RunStore(spark, f"{root}/store")
    live.flush(_streamed(spark, sf_dir), store, f"{root}/state").awaitTermination()
    return resolve.snapshot(store.read())


# Sketches.

BIT = "(('0x' || substr(md5(element::BLOB || unhex(lpad(to_hex(seed), 8, '0'))), 1, 16))::UBIGINT % {m})::BIGINT"
USERS = "SELECT user_id::VARCHAR AS element FROM events"
PARTS = "SELECT l_partkey::VARCHAR AS element FROM lineitem"
BITS_SQL = f"SELECT DISTINCT {BIT.format(m=BLOOM.m)} AS bit FROM ({USERS}), (SELECT unnest(range({BLOOM.k}))::BIGINT AS seed)"


@query("SELECT 9586::BIGINT AS m, 7::BIGINT AS k")
def bloom_params(spark, sf_dir):
    return spark.range(1).select(F.lit(BLOOM.m).cast("long").alias("m"), F.lit(BLOOM.k).cast("long").alias("k"))


@query(BITS_SQL)
def bloom_bits(spark, sf_dir):
    return BLOOM.add(elements(spark, sf_dir))


CHECK_SQL = f"""bits AS ({BITS_SQL}), probes AS (SELECT DISTINCT element FROM ({PARTS})),
hashed AS (SELECT element, {BIT.format(m=BLOOM.m)} AS bit FROM probes, (SELECT unnest(range({BLOOM.k}))::BIGINT AS seed)),
told AS (SELECT h.element, count(b.bit) = count(*) AS maybe FROM hashed h LEFT JOIN bits b ON h.bit = b.bit GROUP BY h.element)"""


@query(f"WITH {CHECK_SQL} SELECT * FROM told")
def bloom_check(spark, sf_dir):
    return BLOOM.check(parts(spark, sf_dir), bloom_bits(spark, sf_dir))


@query(f"WITH {CHECK_SQL}, held AS (SELECT DISTINCT element FROM ({USERS})) SELECT count(*) AS absent, count(*) FILTER (maybe) AS false_positives FROM told WHERE element NOT IN (SELECT element FROM held)")
def bloom_fp_rate(spark, sf_dir):
    absent = bloom_check(spark, sf_dir).join(elements(spark, sf_dir).distinct(), "element", "left_anti")
    return absent.agg(F.count("*").alias("absent"), F.count_if("maybe").alias("false_positives"))


@query(BITS_SQL)
def bloom_merge(spark, sf_dir):
    rows = elements(spark, sf_dir)
    even = F.col("element").cast("long") % 2 == 0
    return bloom.merge((BLOOM, BLOOM.add(rows.filter(even))), (BLOOM, BLOOM.add(rows.filter(~even))))[1]


@query(f"""WITH {BATCHES}, bits AS (SELECT DISTINCT flush_id, {BIT.format(m=BLOOM.m).replace("element", "key")} AS bit FROM flushed, (SELECT unnest(range({BLOOM.k}))::BIGINT AS seed)),
probe AS (SELECT DISTINCT {BIT.format(m=BLOOM.m).replace("element", "'u000042'")} AS bit FROM (SELECT unnest(range({BLOOM.k}))::BIGINT AS seed))
SELECT flush_id, count(*) = (SELECT count(*) FROM probe) AS maybe FROM bits WHERE bit IN (SELECT bit FROM probe) GROUP BY flush_id""")
def table_bloom_prune(spark, sf_dir):
    """The runs whose filter shares a bit with a key, and whether they may hold it."""
    seeds = F.explode(F.sequence(F.lit(0), F.lit(BLOOM.k - 1))).alias("seed")
    bits = flush_batches(spark, sf_dir).select("flush_id", "key", seeds).select("flush_id", modulo(seeded_md5(F.col("key"), F.col("seed")), BLOOM.m).alias("bit")).distinct()
    probe = BLOOM.add(spark.sql("SELECT 'u000042' AS element"))
    n = probe.count()
    return bits.join(F.broadcast(probe), "bit").groupBy("flush_id").agg((F.count("*") == n).alias("maybe"))


@query("SELECT 272::BIGINT AS m, 6::BIGINT AS k")
def cms_params(spark, sf_dir):
    return spark.range(1).select(F.lit(SKETCH.m).cast("long").alias("m"), F.lit(SKETCH.k).cast("long").alias("k"))


CELL = f"(('0x' || substr(md5(element::BLOB || unhex(rpad(lpad(to_hex(line), 8, '0'), 64, '0'))), 1, 16))::UBIGINT % {SKETCH.m})::BIGINT"
CELLS_SQL = f"SELECT line::INT AS line, {CELL} AS cell, count(*) AS count FROM ({PARTS}), (SELECT unnest(range({SKETCH.k}))::BIGINT AS line) GROUP BY 1, 2"


@query(CELLS_SQL)
def cms_cells(spark, sf_dir):
    return SKETCH.add(parts(spark, sf_dir))


@query(f"""WITH cells AS ({CELLS_SQL}), probes AS (SELECT DISTINCT element FROM ({PARTS})), hashed AS (SELECT element, line, {CELL} AS cell FROM probes, (SELECT unnest(range({SKETCH.k}))::BIGINT AS line))
SELECT element, min(coalesce(count, 0)) AS estimate FROM hashed h LEFT JOIN cells c ON h.line = c.line AND h.cell = c.cell GROUP BY element""")
def cms_estimate(spark, sf_dir):
    return SKETCH.estimate(parts(spark, sf_dir), cms_cells(spark, sf_dir))


@query(CELLS_SQL)
def cms_merge(spark, sf_dir):
    rows = parts(spark, sf_dir)
    even = F.col("element").cast("long") % 2 == 0
    return cms.merge((SKETCH, SKETCH.add(rows.filter(even))), (SKETCH, SKETCH.add(rows.filter(~even))))[1]


def _registers_sql(source: str, p: int, compat: bool = False) -> str:
    rest = f"(high & {(1 << (32 - p)) - 1})"
    zeros = f"CASE WHEN low <> 0 THEN bit_count((low & -low) - 1) WHEN {rest} <> 0 THEN 32 + bit_count(({rest} & -{rest}) - 1) ELSE {64 - p} END"
    return f"""SELECT high >> {32 - p} AS register, max({zeros} + {1 + (p if compat else 0)})::INT AS rank
FROM (SELECT ('0x' || substr(md5(element), 1, 8))::BIGINT AS high, ('0x' || substr(md5(element), 9, 8))::BIGINT AS low FROM ({source})) GROUP BY 1"""


def _estimate_sql(registers: str, p: int) -> str:
    m, two32 = float(1 << p), float(1 << 32)
    alpha = 0.7213 / (1.0 + 1.079 / m)
    return f"""WITH regs AS ({registers}), sums AS (SELECT count(*) AS n, {alpha * m * m}::DOUBLE / (sum(pow(2.0::DOUBLE, -rank)) + {m}::DOUBLE - count(*)) AS raw FROM regs)
SELECT round(CASE WHEN raw <= {2.5 * m} AND n < {m} THEN {m}::DOUBLE * ln({m}::DOUBLE / ({m}::DOUBLE - n)) WHEN raw > {two32 / 30}::DOUBLE AND raw < {two32}::DOUBLE THEN -{two32}::DOUBLE * ln(1.0::DOUBLE - raw / {two32}::DOUBLE) ELSE raw END)::BIGINT AS estimate FROM sums"""


@query(_registers_sql(PARTS, PRECISION))
def hll_registers(spark, sf_dir):
    return hll.registers(parts(spark, sf_dir), PRECISION)


@query(_estimate_sql(_registers_sql(PARTS, PRECISION), PRECISION))
def hll_estimate(spark, sf_dir):
    return hll.estimate(hll_registers(spark, sf_dir), PRECISION).select(F.round("estimate").cast("long").alias("estimate"))


@query(_estimate_sql(_registers_sql(PARTS, PRECISION, True), PRECISION))
def hll_estimate_compat(spark, sf_dir):
    return hll.estimate(hll.registers(parts(spark, sf_dir), PRECISION, compat=True), PRECISION).select(F.round("estimate").cast("long").alias("estimate"))


@query(_registers_sql(PARTS, PRECISION))
def hll_merge(spark, sf_dir):
    rows = parts(spark, sf_dir)
    even = F.col("element").cast("long") % 2 == 0
    return hll.merge(hll.registers(rows.filter(even), PRECISION), hll.registers(rows.filter(~even), PRECISION))


# Texts.

STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in text.STOP_WORDS)
WORDS_SQL = r"SELECT doc_id, unnest(list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\s]', '', 'g'), '\s+'), lambda w: w <> '')) AS word FROM documents"
WEIGHTS_SQL = f"SELECT doc_id, word, count(*) AS weight FROM ({WORDS_SQL}) WHERE word NOT IN ({STOPS}) GROUP BY doc_id, word"
_BYTES = " || ".join(f"format('{{:b}}', ('0x' || substr(md5(word), {2 * k + 1}, 2))::INT)" for k in range(16))
_SUMS = ", ".join(f"sum(CASE WHEN substr(b, {k + 1}, 1) = '1' THEN weight ELSE -weight END) AS s{k}" for k in range(64))
_PLACES = " + ".join(f"CASE WHEN s{k} > 0 THEN {-(1 << 63) if k == 0 else 1 << (63 - k)}::HUGEINT ELSE 0 END" for k in range(64))
PRINTS_SQL = f"""SELECT d.doc_id, coalesce(p.fingerprint, 0)::BIGINT AS fingerprint FROM documents d LEFT JOIN (
SELECT doc_id, {_PLACES} AS fingerprint FROM (SELECT doc_id, {_SUMS} FROM (SELECT doc_id, weight, substr(lpad({_BYTES}, 128, '0'), 65, 64) AS b FROM ({WEIGHTS_SQL})) GROUP BY doc_id)) p ON d.doc_id = p.doc_id"""


@query(f"SELECT doc_id, word, count(*) AS n FROM ({WORDS_SQL}) GROUP BY doc_id, word")
def clean_words(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.clean_words(F.col("text"))).alias("word"))
    return words.groupBy("doc_id", "word").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, count(*) AS words, count(*) FILTER (word IN ({STOPS})) AS stop_words FROM ({WORDS_SQL}) GROUP BY doc_id")
def stopword_filter(spark, sf_dir):
    words = text.clean_words(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", words.alias("all")).filter("size(all) > 0")
    return rows.select("doc_id", F.size("all").cast("long").alias("words"), (F.size("all") - F.size(text.without_stop_words(F.col("all")))).cast("long").alias("stop_words"))


@query(WEIGHTS_SQL)
def word_weights(spark, sf_dir):
    return text.word_weights(table(spark, sf_dir, "documents"))


@query(f"SELECT word, substr(lpad({_BYTES}, 128, '0'), 65, 64) AS digits FROM (SELECT DISTINCT word FROM ({WORDS_SQL}))")
def hash_digits(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(text.clean_words(F.col("text"))).alias("word")).distinct()
    # The digest is a column of its own, as it would be made anew for each of its parts otherwise.
    return words.withColumn("digest", F.md5(F.encode("word", "UTF-8"))).select("word", text.digest_digits(F.col("digest")).alias("digits"))


@query(PRINTS_SQL)
def simhash_fingerprint(spark, sf_dir):
    return text.fingerprints(table(spark, sf_dir, "documents"))


@query(f"WITH prints AS ({PRINTS_SQL}) SELECT p.doc_id, bit_count(xor(p.fingerprint, q.fingerprint))::INT AS distance FROM prints p, prints q WHERE q.doc_id = 0")
def simhash_distance(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    # One row, whatever ids repeat.
    one = text.fingerprints(docs.filter("doc_id = 0")).agg(F.min("fingerprint").alias("other")).withColumn("one", F.lit(1))
    told = text.fingerprints(docs).withColumn("one", F.lit(1)).join(F.broadcast(one), "one")
    return told.select("doc_id", text.distance(F.col("fingerprint"), F.col("other")).alias("distance"))


@query(f"WITH prints AS (SELECT DISTINCT fingerprint FROM ({PRINTS_SQL})) SELECT p.fingerprint AS a, q.fingerprint AS b, bit_count(xor(p.fingerprint, q.fingerprint))::INT AS distance FROM prints p, prints q WHERE p.fingerprint < q.fingerprint AND bit_count(xor(p.fingerprint, q.fingerprint)) <= {NEAR}")
def simhash_near_dups(spark, sf_dir):
    return text.near_pairs(text.fingerprints(table(spark, sf_dir, "documents")), NEAR)


# Integrity.

_LEAVES = f"""{LATEST}, numbered AS (SELECT (row_number() OVER (ORDER BY key) - 1) AS num, key || '=' || coalesce(value, '') || '|0' AS rec FROM snap),
l0 AS (SELECT num // {BLOCK} AS idx, md5(string_agg(rec, chr(10) ORDER BY num)) AS hash FROM numbered GROUP BY 1)"""
_DEPTH = 10


def _level_sql(k: int) -> str:
    return f"""l{k} AS (SELECT idx // 2 AS idx, CASE WHEN (SELECT count(*) FROM l{k - 1}) = 1 THEN max(hash) ELSE
md5(unhex(max(hash) FILTER (idx % 2 = 0) || coalesce(max(hash) FILTER (idx % 2 = 1), '{integrity.ZERO_NODE}'))) END AS hash FROM l{k - 1} GROUP BY 1)"""


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.newest(log(spark, sf_dir)).filter(resolve.live())


@query(f"WITH {_LEAVES} SELECT idx, hash FROM l0")
def merkle_leaves(spark, sf_dir):
    return integrity.leaves(_live(spark, sf_dir), BLOCK)


@query(f"WITH {_LEAVES}, {', '.join(_level_sql(k) for k in range(1, _DEPTH + 1))} SELECT hash AS root FROM l{_DEPTH}")
def merkle_root(spark, sf_dir):
    return integrity.root(_live(spark, sf_dir), BLOCK)


@query(f"WITH {_LEAVES.replace("'=' || coalesce(value, '')", "'=' || CASE WHEN key = 'u000042' THEN 'changed' ELSE coalesce(value, '') END").replace('l0 AS', 'changed AS')}, numbered2 AS (SELECT (row_number() OVER (ORDER BY key) - 1) AS num, key || '=' || coalesce(value, '') || '|0' AS rec FROM snap), l0 AS (SELECT num // {BLOCK} AS idx, md5(string_agg(rec, chr(10) ORDER BY num)) AS hash FROM numbered2 GROUP BY 1) SELECT l0.idx FROM l0 JOIN changed ON l0.idx = changed.idx WHERE l0.hash <> changed.hash")
def merkle_diff(spark, sf_dir):
    rows = _live(spark, sf_dir)
    changed = rows.withColumn("value", F.when(F.col("key") == "u000042", "changed").otherwise(F.col("value")))
    return integrity.differing(integrity.leaves(rows, BLOCK), integrity.leaves(changed, BLOCK))


# Dictionary, admission, arguments.

DICT_SQL = f"SELECT row_number() OVER (ORDER BY ts, seq, key) AS id, key FROM (SELECT key, unnest(min(struct_pack(ts := ts, seq := seq))) FROM ({EVENTS_SQL}) GROUP BY key)"


@query(DICT_SQL)
def dictionary_build(spark, sf_dir):
    return dictionary.build(log(spark, sf_dir))


@query(f"WITH dict AS ({DICT_SQL}) SELECT d.id AS key_id, l.seq FROM ({EVENTS_SQL}) l JOIN dict d ON l.key = d.key")
def dictionary_encode(spark, sf_dir):
    return dictionary.encode(log(spark, sf_dir).select("key", "seq"), dictionary_build(spark, sf_dir))


@query(f"SELECT key, seq FROM ({EVENTS_SQL})")
def dictionary_decode(spark, sf_dir):
    rows = log(spark, sf_dir).select("key", "seq")
    ids = cut_lineage(dictionary.build(log(spark, sf_dir)))
    return dictionary.decode(dictionary.encode(rows, ids), ids)


@query(f"WITH dict AS ({DICT_SQL}) SELECT id, key FROM dict")
def dictionary_persisted(spark, sf_dir):
    """Ids given in two rounds, the second of which appends new keys alone."""
    held = DictionaryStore(spark, f"{checkpoint_root(spark)}/dictionary-{uuid.uuid4().hex}")
    rows = log(spark, sf_dir)
    held.update(rows.filter(F.col("ts") <= F.lit(str(AS_OF)).cast("timestamp_ntz")))
    held.update(rows)
    return held.read()


@query(f"""WITH RECURSIVE secs AS (SELECT user_id AS bucket, floor(epoch(ts))::BIGINT AS second, count(*) AS requests FROM events GROUP BY 1, 2),
steps AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY second) AS n FROM secs),
fold AS (
  SELECT bucket, n, second, requests, second AS start, greatest({RATE} - requests, 0) AS remaining, least(requests, {RATE}) AS admitted FROM steps WHERE n = 1
  UNION ALL
  SELECT s.bucket, s.n, s.second, s.requests, CASE WHEN s.second - f.start >= {INTERVAL} THEN s.second ELSE f.start END,
         greatest(CASE WHEN s.second - f.start >= {INTERVAL} THEN {RATE} ELSE f.remaining END - s.requests, 0),
         least(s.requests, CASE WHEN s.second - f.start >= {INTERVAL} THEN {RATE} ELSE f.remaining END)
  FROM fold f JOIN steps s ON s.bucket = f.bucket AND s.n = f.n + 1)
SELECT bucket, second, requests, admitted::BIGINT AS admitted FROM fold""")
def token_bucket(spark, sf_dir):
    requests = table(spark, sf_dir, "events").select(F.col("user_id").alias("bucket"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"))
    return control.admit(requests, RATE, INTERVAL)


@query("SELECT event_type AS verb, upper(event_type) IN (" + ", ".join(f"'{v}'" for v in sorted(control.THROTTLED)) + ") AS throttled FROM (SELECT DISTINCT event_type FROM events UNION SELECT 'put' UNION SELECT 'Help')")
def throttled_verbs(spark, sf_dir):
    verbs = table(spark, sf_dir, "events").select("event_type").union(spark.sql("SELECT explode(array('put', 'Help'))")).distinct()
    return verbs.select(F.col("event_type").alias("verb"), control.throttled(F.col("event_type")).alias("throttled"))


LINES = ['PUT "a b" c\\"d', 'put  key\tvalue', 'GET "tab\there"', 'PUT "" x', "EXIT"]


@query("SELECT * FROM (VALUES (0, 0, 'PUT'), (0, 1, 'a b'), (0, 2, 'c\"d'), (1, 0, 'put'), (1, 1, 'key'), (1, 2, 'value'), (2, 0, 'GET'), (2, 1, 'tab' || chr(9) || 'here'), (3, 0, 'PUT'), (3, 1, 'x'), (4, 0, 'EXIT')) AS t(line, pos, token)")
def tokenize_args(spark, sf_dir):
    return spark.createDataFrame([(n, k, t) for n, line in enumerate(LINES) for k, t in enumerate(text.tokenize(line))], "line int, pos int, token string")


@query("""SELECT event_id, CASE WHEN regexp_matches(props, '[ \\t"]') THEN '"' || replace(props, '"', '\\"') || '"' ELSE props END AS quoted FROM events""")
def quote_output(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.quoted(F.col("props")).alias("quoted"))


from tidelog import engine_queries  # noqa: E402, F401  (registers its queries, made of what stands above)
