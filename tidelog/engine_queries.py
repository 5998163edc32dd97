"""Registered queries of the store, its command line, its settings and its saved sketches, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidelog import config
from tidelog.engine import HELP, Shell, Store
from tidelog.functions import bloom, cms, hll
from tidelog.model import RESERVED_PREFIX
from tidelog.operators import control, integrity, scan
from tidelog.plans import compaction
from tidelog.plans.compaction import Run
from tidelog.queries import (
    BITS_SQL,
    BLOCK,
    BLOOM,
    CELLS_SQL,
    FINE,
    INTERVAL,
    LATEST,
    PARTS,
    PRECISION,
    PRINTS_SQL,
    RATE,
    SKETCH,
    STORED_RUNS,
    _DEPTH,
    _LEAVES,
    _level_sql,
    _live,
    _registers_sql,
    bloom_bits,
    cms_cells,
    elements,
    hll_registers,
    log,
    parts,
    query,
    stored,
    table,
)
from tidelog.session import checkpoint_root
from tidelog.sources import runs
from tidelog.sources.sketches import SketchStore
from tidelog.streaming import live


def fresh(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def values(rows: list[tuple], *names: str) -> str:
    """SQL of literal rows."""
    literal = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


# Settings and the command line.

SETTINGS = '{"MaxMemtableSize": 7, "TokenRate": 9, "CompactionAlgorithm": "Leveled", "BlockSize": 64, "SummaryStep": 4, "SSTableSingleFile": true}'


@query(values([("max_memtable_size", "7"), ("token_rate", "9"), ("compaction", "leveled"), ("merkle_block", "64"), ("memtable_num", "2"), ("single_file", "True")], "name", "value"))
def config_settings(spark, sf_dir):
    found = config.parse(SETTINGS)
    return spark.createDataFrame([(n, str(getattr(found, n))) for n in ("max_memtable_size", "token_rate", "compaction", "merkle_block", "memtable_num", "single_file")], "name string, value string")


SESSION = [
    ("put a 1", "added [a -> 1]"),
    ('PUT "b c" "x y"', 'added ["b c" -> "x y"]'),
    ("GET a", "found [a -> 1]"),
    ("DELETE a", "deleted a"),
    ("GET a", "not found for key a"),
    ('PREFIX_SCAN "b" 1 10', 'page 1: 1..1 of 1\n"b c" -> "x y"'),
    ("RANGE_SCAN a z 9 10", "no records (page 9 of 1)"),
    ("RANGE_SCAN a z 0 10", "error: page and size start at 1"),
    ("PREFIX_ITERATE b", '"b c" -> "x y"'),
    ("NEXT", "end"),
    ("STOP", "stopped"),
    (f"PUT {RESERVED_PREFIX}x 1", f"error: '{RESERVED_PREFIX}x' is not a user's key"),
    ('GET "a', "error: a quote is not closed"),
    ("GET", "usage: GET takes 1 arguments"),
    ("HLL_CREATE h 4", "created h"),
    ("HLL_ADD h x", "added to h"),
    ("HLL_COUNT h", "about 1"),
    ("HLL_DELETE h", "deleted h"),
    ("HLL_COUNT h", "error: no hll 'h'"),
    ("VALIDATE", "no runs"),
    ("FOO", "unknown command FOO"),
    ("HELP", HELP),
    ("EXIT", "bye"),
]


@query(values([(n, answer) for n, (_, answer) in enumerate(SESSION)], "line", "answer"))
def shell_session(spark, sf_dir):
    shell = Shell(Store(spark, fresh(spark, "shell")), clock=lambda: 0)
    told = shell.run(iter([line for line, _ in SESSION] + ["GET a"]))
    return spark.createDataFrame(list(enumerate(told)), "line int, answer string")


@query(values([(k, k <= 3) for k in range(1, 6)], "line", "admitted"))
def shell_admission(spark, sf_dir):
    shell = Shell(Store(spark, fresh(spark, "shell"), config.Config(token_rate=3)), clock=lambda: 0)
    told = [shell.answer("GET none") for _ in range(5)]
    return spark.createDataFrame([(k, t != "token limit exceeded, wait") for k, t in enumerate(told, 1)], "line int, admitted boolean")


CACHE_OPS = ["+a", "+b", "+c", "?a", "+d", "?b", "+e"]


@query(values([("lru", "a"), ("lru", "d"), ("lru", "e"), ("fifo", "c"), ("fifo", "d"), ("fifo", "e")], "kind", "key"))
def caches(spark, sf_dir):
    rows = []
    for kind in ("lru", "fifo"):
        cache = control.Cache(3, promote=kind == "lru")
        for op in CACHE_OPS:
            if op[0] == "+":
                cache.put(op[1:], op)
            else:
                cache.get(op[1:])
        rows += [(kind, k) for k in "abcde" if k in cache]
    return spark.createDataFrame(rows, "kind string, key string")


# The store.


def _nations(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """25 rows."""
    return {f"n{r['n_nationkey']}": r["n_name"] for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()}


@query("SELECT 'n' || n_nationkey AS key, n_name AS value FROM nation WHERE n_nationkey <> 3")
def store_recovery(spark, sf_dir):
    """What one store logged, partly flushed and left without closing, read by the next one at its folder."""
    path, settings = fresh(spark, "store"), config.Config(max_memtable_size=50, wal_max_records_per_segment=4)
    rows = _nations(spark, sf_dir)
    first = Store(spark, path, settings)
    first.put_all({k: "old" for k in list(rows)[:10]})
    first.flush()
    first.put_all(rows)
    first.delete("n3")
    return scan.prefix_scan(Store(spark, path, settings).mutations(), "n")


@query("WITH rows AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS n FROM nation) SELECT n // 4 AS segment_id, count(*) AS records FROM rows GROUP BY 1")
def store_segments(spark, sf_dir):
    store = Store(spark, fresh(spark, "store"), config.Config(max_memtable_size=50, wal_max_records_per_segment=4))
    for at in range(0, 25, 5):
        store.put_all(dict(list(_nations(spark, sf_dir).items())[at : at + 5]))
    return spark.read.parquet(f"{store.path}/wal").groupBy("segment_id").agg(F.count("*").alias("records")).select(F.col("segment_id").cast("long"), "records")


@query(f"""WITH {FINE}, numbered AS (SELECT key, row_number() OVER (ORDER BY key, ts, seq) - 1 AS row_index, count(*) OVER () AS n FROM log),
ranges AS (SELECT row_index * {STORED_RUNS} // n AS flush_id, min(key) AS min_key, max(key) AS max_key FROM numbered GROUP BY 1)
SELECT count(*) AS runs, count(*) FILTER (min_key <= 'u000020:view' AND max_key >= 'u000010') AS opened FROM ranges""")
def range_pruning(spark, sf_dir):
    """Of all runs those that a range scan opens, counted by their files."""
    store = stored(spark, sf_dir)
    held = store.read("u000010", "u000020:view")
    opened = {f.rpartition("/")[0] for f in held.inputFiles()} if held is not None else set()
    return spark.createDataFrame([(len(store.manifest()), len(opened))], "runs long, opened long")


@query("SELECT true AS held_opened, true AS few_opened")
def filter_pruning(spark, sf_dir):
    """Whether the filters let every run pass that holds a key, and of keys that no run holds few."""
    store = stored(spark, sf_dir)
    rows = store.manifest()
    held = {r["run"]: store.filters(r["min_key"])[r["run"]] for r in rows}
    firsts = all(runs.may_hold(held[r["run"]], k) for r in rows for k in (r["min_key"], r["max_key"]))
    absent = sum(runs.may_hold(f, f"absent{k}") for f in held.values() for k in range(200))
    return spark.createDataFrame([(firsts, absent <= 0.05 * 200 * len(rows))], "held_opened boolean, few_opened boolean")


@query(f"WITH {LATEST} SELECT 1::BIGINT AS files, count(*) AS records, min(key) AS min_key, max(key) AS max_key FROM newest")
def single_file_run(spark, sf_dir):
    store = runs.RunStore(spark, fresh(spark, "single"), single_file=True)
    store.append(log(spark, sf_dir))
    (row,) = store.manifest()
    files = len(store.open([row["path"]]).inputFiles())
    return spark.createDataFrame([(files, row["records"], row["min_key"], row["max_key"])], "files long, records long, min_key string, max_key string")


@query(values([(0, "m", "z"), (1, "a", "c")], "level", "min_key", "max_key"))
def level_move(spark, sf_dir):
    """A run that meets no other moves down a level as it is."""
    store = runs.RunStore(spark, fresh(spark, "levels"))
    for low, high in (("a", "c"), ("m", "z")):
        store.append(spark.createDataFrame([(low, "v", 1, 1, False), (high, "v", 2, 2, False)], "key string, value string, ts long, seq long, tombstone boolean"))
    files = {r["path"] for r in store.manifest()}
    compaction.compact(store, "leveled", 1)
    return spark.createDataFrame([(r["level"], r["min_key"], r["max_key"]) for r in store.manifest() if r["path"] in files], "level int, min_key string, max_key string")


PLANNED = [Run(f"r{k}", 0, f"{k:02}", f"{k + 3:02}", k) for k in range(10)]


@query(values([("size_tiered", 0, 10, 1), ("leveled", 0, 10, 1)], "planner", "step", "merged", "level"))
def compaction_rounds(spark, sf_dir):
    rows = [(planner, n, len(step.runs), step.level) for planner in compaction.PLANNERS for n, step in enumerate(compaction.rounds(PLANNED, planner, 4))]
    return spark.createDataFrame(rows, "planner string, step int, merged int, level int")


# Hash trees.


@query(f"WITH {_LEAVES}, {', '.join(_level_sql(k) for k in range(1, _DEPTH + 1))}, every AS ({' UNION ALL '.join(f'SELECT {k} AS level, idx, hash, (SELECT count(*) FROM l{max(k - 1, 0)}) AS below FROM l{k}' for k in range(_DEPTH + 1))}) SELECT level::INT AS level, idx, hash FROM every WHERE level = 0 OR below > 1")
def merkle_tree(spark, sf_dir):
    """All nodes of a hash tree, written and read back."""
    path = fresh(spark, "tree")
    nodes = integrity.tree(_live(spark, sf_dir), BLOCK)
    nodes.select(F.col("level").cast("int").alias("level"), F.col("idx").cast("long").alias("idx"), "hash").write.parquet(path)
    return spark.read.parquet(path)


# Saved sketches.


@query(BITS_SQL)
def bloom_saved(spark, sf_dir):
    store = SketchStore(spark, fresh(spark, "sketches"))
    store.save("bloom", "users", BLOOM.dump(bloom_bits(spark, sf_dir)))
    return bloom.Bloom.load(spark, store.load("bloom", "users")[0])[1]


@query(CELLS_SQL)
def cms_saved(spark, sf_dir):
    store = SketchStore(spark, fresh(spark, "sketches"))
    store.save("cms", "parts", SKETCH.dump(cms_cells(spark, sf_dir)))
    return cms.CountMin.load(spark, store.load("cms", "parts")[0])[1]


@query(_registers_sql(PARTS, PRECISION))
def hll_saved(spark, sf_dir):
    store = SketchStore(spark, fresh(spark, "sketches"))
    store.save("hll", "parts", hll.dump(hll_registers(spark, sf_dir), PRECISION))
    return hll.load(spark, store.load("hll", "parts")[0])[1]


@query(_registers_sql(PARTS, PRECISION))
def hll_file(spark, sf_dir):
    """Registers saved, written to a file, read from it under another name."""
    store, path = SketchStore(spark, fresh(spark, "sketches")), fresh(spark, "file")
    store.save("hll", "parts", hll.dump(hll_registers(spark, sf_dir), PRECISION))
    store.write_file("hll", "parts", path)
    store.read_file("hll", "again", path)
    return hll.load(spark, store.load("hll", "again")[0])[1]


@query(CELLS_SQL)
def cms_file(spark, sf_dir):
    store, path = SketchStore(spark, fresh(spark, "sketches")), fresh(spark, "file")
    store.save("cms", "parts", SKETCH.dump(cms_cells(spark, sf_dir)))
    store.write_file("cms", "parts", path)
    store.read_file("cms", "again", path)
    return cms.CountMin.load(spark, store.load("cms", "again")[0])[1]


@query(values([(0, 2), (1, 0)], "step", "estimate"))
def hll_reset(spark, sf_dir):
    store = Store(spark, fresh(spark, "store"))
    store.hll_create("h", 6)
    store.hll_add("h", "a", "b", "a")
    told = [(0, round(store.hll_count("h")))]
    store.hll_reset("h")
    return spark.createDataFrame([*told, (1, round(store.hll_count("h")))], "step int, estimate int")


@query(values([(kind, n, there) for kind in ("bloom", "cms", "hll", "simhash") for n, there in enumerate((False, True, False, True))], "kind", "step", "there"))
def sketches_deleted(spark, sf_dir):
    """Whether a sketch is there before it is saved, then, after its deletion and when it is saved again."""
    store, rows = SketchStore(spark, fresh(spark, "sketches")), []
    for kind in ("bloom", "cms", "hll", "simhash"):
        for n, act in enumerate((None, "save", "delete", "save")):
            if act == "save":
                store.save(kind, "x", b"1")
            elif act == "delete":
                store.delete(kind, "x")
            rows.append((kind, n, store.load(kind, "x") is not None))
    return spark.createDataFrame(rows, "kind string, step int, there boolean")


@query(f"WITH prints AS ({PRINTS_SQL}) SELECT bit_count(xor(p.fingerprint, q.fingerprint))::INT AS distance FROM prints p, prints q WHERE p.doc_id = 0 AND q.doc_id = 1")
def simhash_files(spark, sf_dir):
    """The distance of two text files' saved fingerprints."""
    store = Store(spark, fresh(spark, "store"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    for k in (0, 1):
        path = fresh(spark, "text")
        docs.filter(F.col("doc_id") == k).select(F.coalesce("text", F.lit("")).alias("value")).coalesce(1).write.text(path)
        store.simhash_create(f"d{k}", path)
    return spark.createDataFrame([(store.simhash_distance("d0", "d1"),)], "distance int")


@query("SELECT true AS close")
def native_hll(spark, sf_dir):
    """Whether Spark's own sketches are within five standard errors of the exact number."""
    told = parts(spark, sf_dir).agg(F.hll_sketch_estimate(F.hll_sketch_agg("element", 12)).alias("a"), F.approx_count_distinct("element", 0.02).alias("b"), F.countDistinct("element").alias("n"))
    return told.select(((F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n")) & (F.abs(F.col("b") - F.col("n")) <= 0.1 * F.col("n"))).alias("close"))


@query("SELECT 272::BIGINT AS cells, true AS holds")
def native_cms(spark, sf_dir):
    """Whether Spark's own Count-Min sketch has the size of such a sketch (its header and counters)."""
    told = parts(spark, sf_dir).agg(F.length(F.count_min_sketch(F.col("element"), F.lit(0.01), F.lit(0.99), F.lit(1))).alias("bytes"))
    return told.select(F.lit(SKETCH.m).cast("long").alias("cells"), (F.col("bytes") >= 8 * 200).alias("holds"))


# Streams.


@query(f"""WITH RECURSIVE steps AS (SELECT user_id AS bucket, event_id AS request, floor(epoch(ts))::BIGINT AS second, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS n FROM events),
fold AS (
  SELECT bucket, request, n, second AS start, {RATE - 1} AS remaining, true AS admitted FROM steps WHERE n = 1
  UNION ALL
  SELECT s.bucket, s.request, s.n, CASE WHEN s.second - f.start >= {INTERVAL} THEN s.second ELSE f.start END,
         greatest(CASE WHEN s.second - f.start >= {INTERVAL} THEN {RATE} ELSE f.remaining END - 1, 0), s.second - f.start >= {INTERVAL} OR f.remaining > 0
  FROM fold f JOIN steps s ON s.bucket = f.bucket AND s.n = f.n + 1)
SELECT bucket, request, admitted FROM fold""")
def stream_admission(spark, sf_dir):
    """Every event admitted or not by its user's bucket, as a stream with state."""
    root = fresh(spark, "admission")
    events = live.mutations(spark, f"{sf_dir}/events.parque[t]", table(spark, sf_dir, "events").schema)
    requests = events.select(F.col("user_id").alias("bucket"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"), F.col("event_id").alias("request"))
    told = live.admissions(requests, RATE, INTERVAL)
    told.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")


# Keys and elements.


@query("SELECT user_id::VARCHAR AS element, true AS maybe FROM events GROUP BY user_id")
def bloom_has_all(spark, sf_dir):
    """A filter never denies what was added."""
    return BLOOM.check(elements(spark, sf_dir), bloom_bits(spark, sf_dir))


@query(values([("reserved", 0), ("own", 1)], "kind", "n"))
def reserved_keys(spark, sf_dir):
    """Keys of the engine's own are no user's: scans leave them out."""
    rows = [(f"{RESERVED_PREFIX}a", "v", 1, 1, False), ("a", "v", 1, 2, False)]
    log = spark.createDataFrame(rows, "key string, value string, ts long, seq long, tombstone boolean")
    own = scan.prefix_scan(log, "")
    told = own.agg(F.count_if(F.col("key").startswith(RESERVED_PREFIX)).alias("reserved"), F.count("*").alias("own"))
    return told.select(F.explode(F.array(F.struct(F.lit("reserved").alias("kind"), F.col("reserved").cast("int").alias("n")), F.struct(F.lit("own").alias("kind"), F.col("own").cast("int").alias("n")))).alias("r")).select("r.*")
