"""The key-value engine against dictionary and byte-wise models."""

import hashlib
import math
import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog import config, queries
from tidelog.engine import VERBS, Shell, Store
from tidelog.functions import bloom, cms, hll, text
from tidelog.model import MUTATION, RESERVED_PREFIX, check_key, mutations_from_events
from tidelog.operators import control, dictionary, integrity, ordering, resolve, scan, write
from tidelog.plans import compaction
from tidelog.plans.compaction import Run
from tidelog.sources import runs, wal
from tidelog.sources.dictionary import DictionaryStore
from tidelog.sources.sketches import SketchStore
from tidelog.streaming import live


def model(rows):
    newest = {}
    for key, value, ts, seq, gone in rows:
        if key not in newest or (ts, seq) > newest[key][:2]:
            newest[key] = (ts, seq, gone, value)
    return {k: v[3] for k, v in newest.items() if not v[2]}


def random_rows(seed, n=300, keys=25):
    rng = random.Random(seed)
    return [(f"k{rng.randrange(keys):02}", f"v{k}", rng.randrange(50), k, False) if rng.random() < 0.7 else (f"k{rng.randrange(keys):02}", None, rng.randrange(50), k, True) for k in range(n)]


def held(df):
    return {r["key"]: r["value"] for r in df.collect()}


CASES = {
    "overwrite": ([("a", "1", 1, 0, False), ("a", "2", 2, 1, False)], {"a": "2"}),
    "out of order": ([("a", "2", 2, 0, False), ("a", "1", 1, 1, False)], {"a": "2"}),
    "tie on ts": ([("a", "1", 5, 1, False), ("a", "2", 5, 2, False)], {"a": "2"}),
    "delete then put": ([("a", "1", 1, 0, False), ("a", None, 2, 1, True), ("a", "3", 3, 2, False)], {"a": "3"}),
    "late delete": ([("a", "3", 3, 0, False), ("a", None, 2, 1, True)], {"a": "3"}),
    "unknown delete": ([("z", None, 1, 0, True)], {}),
    "empty value": ([("a", "", 1, 0, False)], {"a": ""}),
    "byte order of ts": ([("a", "old", 255, 0, False), ("a", "new", 256, 1, False)], {"a": "new"}),
    "nothing": ([], {}),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    rows, expected = CASES[name]
    log = write.batch(spark, rows)
    assert held(resolve.snapshot(log)) == expected == held(resolve.snapshot_by_window(log))


@pytest.mark.parametrize("seed", range(3))
def test_snapshot_is_the_model_in_any_order(spark, seed):
    rows = random_rows(seed)
    expected = model(rows)
    random.Random(seed).shuffle(rows)
    log = write.batch(spark, rows)
    assert held(resolve.snapshot(log)) == expected
    assert held(resolve.snapshot(log.unionAll(log))) == expected
    assert held(resolve.as_of(log, 20)) == model([r for r in rows if r[2] <= 20])
    assert {r["key"] for r in resolve.deleted(log).collect()} == {r[0] for r in rows} - set(expected)


def test_scans_and_pages(spark):
    log = write.batch(spark, random_rows(4))
    rows = scan.range_scan(log, "k05", "k15")
    expected = sorted(k for k in model(random_rows(4)) if "k05" <= k <= "k15")
    paged = [r["key"] for n in range(1, 6) for r in scan.page(rows, n, 3).collect()]
    assert paged == expected[:15]
    assert scan.page(rows, 99, 3).collect() == []
    told = scan.page_info(rows, 2, 3).first()
    assert told["total"] == len(expected) and told["total_pages"] == math.ceil(len(expected) / 3) and told["first_row"] == 4
    assert scan.page_info(rows, 99, 3).first()["first_row"] is None
    assert held(scan.range_scan(log, "k15", "k05")) == {}
    assert held(scan.prefix_scan(log, "k0")) == {k: v for k, v in model(random_rows(4)).items() if k.startswith("k0")}
    for bad in ((0, 3), (1, 0)):
        with pytest.raises(ValueError):
            scan.page(rows, *bad)
    cursor = scan.range_iterate(log, "k05", "k15")
    assert cursor.next()[0] == expected[0]
    assert scan.after(rows, expected[0]).first()["key"] == expected[1]
    cursor.stop()
    assert cursor.next() is None


def test_prefixes_and_unicode_keys(spark):
    log = write.batch(spark, [(k, k, 1, n, False) for n, k in enumerate(("ab", "abc", "ac", "č", "čx", f"{RESERVED_PREFIX}x"))])
    assert set(held(scan.prefix_scan(log, "ab"))) == {"ab", "abc"}
    assert set(held(scan.prefix_scan(log, "č"))) == {"č", "čx"}
    assert held(scan.prefix_scan(log, RESERVED_PREFIX)) == {}
    assert [r["key"] for r in scan.page(scan.prefix_scan(log, ""), 1, 9).collect()] == sorted(("ab", "abc", "ac", "č", "čx"), key=str.encode)
    for bad in ("", f"{RESERVED_PREFIX}x"):
        with pytest.raises(ValueError):
            check_key(bad)


def test_point_reads_are_pushed_down(spark, tmp_path):
    write.batch(spark, random_rows(1)).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "EqualTo(key,k01)" in plan(scan.get(log, "k01"))
    assert "StringStartsWith(key,k0)" in plan(scan.prefix_scan(log, "k0"))
    assert "GreaterThanOrEqual(key,k01)" in plan(scan.range_scan(log, "k01", "k05"))
    assert "TakeOrderedAndProject" in plan(scan.page(scan.range_scan(log, "k01", "k05"), 2, 3))


def test_multi_get(spark):
    log = write.batch(spark, random_rows(2))
    keys = spark.createDataFrame([("k01",), ("k02",), ("k02",), ("none",)], "key string")
    expected = model(random_rows(2))
    assert {r["key"]: (r["found"], r["value"]) for r in scan.multi_get(log, keys).collect()} == {k: (k in expected, expected.get(k)) for k in ("k01", "k02", "none")}


def test_long_ids_keep_their_keys(spark, tmp_path):
    rows = [(1, 1234560, "view", 1), (2, 1234569, "click", 2), (3, 1234561, "error", 3), (4, 42, "view", 4), (5, 123456, "view", 5), (6, None, "view", 6)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, n long").withColumn("ts", F.timestamp_seconds("n").cast("timestamp_ntz"))
    keys = {1: "u1234560", 2: "u1234569", 3: "u1234561", 4: "u000042", 5: "u123456", 6: None}
    assert {r["seq"]: r["key"] for r in mutations_from_events(events).collect()} == keys
    assert {r["key"] for r in mutations_from_events(events.filter("event_id = 1"), fine=True).collect()} == {"u1234560:view"}
    events = events.filter("user_id is not null")
    assert {r["key"] for r in resolve.snapshot(mutations_from_events(events)).collect()} == {"u1234560", "u1234569", "u000042", "u123456"}
    events.write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(1234560,), (1234561,), (42,), (7,)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    found = {r["key"]: r["value"] for r in queries.QUERIES["kv_multi_get"](spark, str(tmp_path)).collect()}
    assert found == {"u1234560": "view:1", "u1234561": None, "u000042": "view:4", "u000007": None}


def test_runs_are_sorted_and_merged_in_order(spark):
    rows = random_rows(17, 80, 9)
    log = write.batch(spark, rows)
    run = [tuple(r) for r in write.sorted_run(log).select("key", "value", "tombstone").collect()]
    assert [r[0] for r in run] == sorted({r[0] for r in rows}) and {k: v for k, v, gone in run if not gone} == model(rows)
    merged = resolve.merged_in_order(log.filter("seq % 2 = 0"), log.filter("seq % 2 = 1")).collect()
    assert [(r["key"], r["ts"], r["seq"]) for r in merged] == sorted((r[0], r[2], r[3]) for r in rows)


def test_digits_are_the_words_bits(spark):
    words = ["a", "word", "čšž", "日本", "x" * 100]
    df = spark.createDataFrame([(w,) for w in words], "word string").withColumn("digest", F.md5(F.encode("word", "UTF-8")))
    assert {r["word"]: int(r["digits"], 2) for r in df.select("word", text.digest_digits(F.col("digest")).alias("digits")).collect()} == {w: text.word_bits(w) for w in words}


def test_row_index(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert all(r["x"] == r["row_index"] for r in ordering.with_row_index(rows, "x").collect())
    assert ordering.with_row_index(rows.filter("x < 0"), "x").collect() == []


@pytest.mark.parametrize("planner", compaction.PLANNERS)
def test_compaction_keeps_the_snapshot(spark, tmp_path, planner):
    store = runs.RunStore(spark, str(tmp_path / "store"))
    rows = random_rows(9, 400)
    for at in range(0, 400, 50):
        store.append(write.batch(spark, rows[at : at + 50]))
    before = held(resolve.snapshot(store.read()))
    assert before == model(rows)
    assert compaction.compact(store, planner, 2, horizon=10**9) > 0
    assert held(resolve.snapshot(store.read())) == before
    assert compaction.compact(store, planner, 2) == 0
    levels = compaction.levels([Run(r["run"], r["level"], r["min_key"], r["max_key"], r["created"]) for r in store.manifest()])
    assert all(len(held_) <= 2 * (10**level if planner == "leveled" else 1) for level, held_ in levels.items())


def test_batches_become_runs(spark, tmp_path):
    store = runs.RunStore(spark, str(tmp_path / "store"))
    rows = random_rows(12, 230)
    store.append_batches(write.flush_batches(write.batch(spark, rows), 50))
    store.append_batches(write.flush_batches(write.batch(spark, []), 50))
    listed = store.manifest()
    assert [r["created"] for r in listed] == [1, 2, 3, 4, 5] and sum(r["records"] for r in listed) <= 230
    assert held(resolve.snapshot(store.read())) == model(rows)
    meets = store.read("k03", "k04")
    assert meets is None or {"k03", "k04"} <= {r["key"] for r in meets.collect()}


def test_tombstone_masks_a_deeper_level(spark, tmp_path):
    store = runs.RunStore(spark, str(tmp_path / "store"))
    store.append(write.batch(spark, [("a", "1", 1, 0, False), ("b", "1", 1, 1, False)]), level=1)
    store.append(write.batch(spark, [("a", None, 2, 2, True)]))
    store.append(write.batch(spark, [("a", None, 3, 3, True)]))
    compaction.compact(store, "size_tiered", 1, horizon=10**9)
    assert held(resolve.snapshot(store.read())) == {"b": "1"}
    (run,) = store.manifest()
    assert (run["level"], run["records"], run["tombstones"]) == (2, 1, 0)


def test_tombstones_wait_for_late_rows(spark, tmp_path):
    store = runs.RunStore(spark, str(tmp_path / "store"))
    store.append(write.batch(spark, [("a", None, 5, 0, True)]))
    store.append(write.batch(spark, [("b", "1", 6, 1, False)]))
    compaction.compact(store, "size_tiered", 1)
    store.append(write.batch(spark, [("a", "late", 4, 2, False)]))
    assert held(resolve.snapshot(store.read())) == {"b": "1"}


def test_planners():
    a, b, c = Run("a", 0, "a", "c", 1), Run("b", 0, "x", "z", 2), Run("c", 1, "b", "d", 0)
    assert compaction.leveled([a, b, c], 1).runs == (a, c)
    assert compaction.leveled([b, Run("d", 0, "y", "y", 3)], 1).level == 1
    assert compaction.size_tiered([a, b, c], 1).runs == (a, b)
    assert compaction.size_tiered([a, c], 1) is None
    assert not compaction.can_drop_tombstones(compaction.Step((a,), 1), [a, c])
    assert len(compaction.rounds([a, b, c, Run("d", 0, "q", "q", 4)], "size_tiered", 1)) >= 1


def test_wal(spark, tmp_path):
    rows = random_rows(6, 100)
    log = wal.segmented(write.batch(spark, rows), 30)
    wal.append(log, str(tmp_path / "wal"))
    stored = wal.read(spark, str(tmp_path / "wal"))
    assert held(resolve.snapshot(wal.replay(stored))) == model(rows)
    broken = stored.withColumn("value", F.when(F.col("seq") == rows[0][3], "?").otherwise(F.col("value")))
    assert wal.replay(broken).count() == 99
    assert wal.low_watermark(stored.filter("segment_id < 2")).first()[0] == 2
    assert wal.truncate(spark, str(tmp_path / "wal"), 2) == 2
    assert wal.read(spark, str(tmp_path / "wal")).select("segment_id").distinct().count() == 2
    first = log.filter("not tombstone and value is not null").first()
    assert first["crc"] == zlib.crc32(f"{first['key']}={first['value']}|0".encode())


@pytest.mark.parametrize("size", [1, 3, 50])
def test_fragments(spark, size):
    rows = [("a", "0123456789", 1, 0, False), ("b", "", 1, 1, False), ("c", None, 1, 2, True), ("d", "čšž", 1, 3, False)]
    parts = wal.fragments(write.batch(spark, rows), size)
    assert held(wal.reassembled(parts)) == {r[0]: r[1] or "" for r in rows}
    assert "a" not in held(wal.reassembled(parts.filter("not (key = 'a' and part = 0)")))


def u64(data):
    return int.from_bytes(hashlib.md5(data).digest()[:8], "big")


def test_bloom(spark):
    assert (bloom.Bloom.sized(1000, 0.01).m, bloom.Bloom.sized(1000, 0.01).k) == (9586, 7)
    b = bloom.Bloom.sized(100, 0.05, seed=1_700_000_000)
    words = [f"w{k}" for k in range(100)] + [None]
    rows = spark.createDataFrame([(w,) for w in words], "element string")
    bits = b.add(rows)
    expected = {u64(w.encode() + struct.pack(">I", b.seed + k)) % b.m for w in words if w for k in range(b.k)}
    assert {r["bit"] for r in bits.collect()} == expected
    assert b.check(rows.filter("element is not null"), bits).filter("not maybe").count() == 0
    again, loaded = bloom.Bloom.load(spark, b.dump(bits))
    assert again == b and {r["bit"] for r in loaded.collect()} == expected
    with pytest.raises(ValueError):
        bloom.merge((b, bits), (bloom.Bloom.sized(100, 0.05, seed=1), bits))
    for bad in ((0, 0.1), (5, 0), (5, 1)):
        with pytest.raises(ValueError):
            bloom.Bloom.sized(*bad)


def test_cms(spark):
    s = cms.CountMin.sized(0.01, 0.01, seed=5)
    assert (s.m, s.k) == (272, 6)
    words = [f"w{k % 17}" for k in range(300)]
    rows = spark.createDataFrame([(w,) for w in words], "element string")
    cells = s.add(rows)
    counts = {}
    for w in words:
        for k in range(s.k):
            at = (k, u64(w.encode() + struct.pack(">I28x", 5 + k)) % s.m)
            counts[at] = counts.get(at, 0) + 1
    assert {(r["line"], r["cell"]): r["count"] for r in cells.collect()} == counts
    assert all(r["estimate"] >= words.count(r["element"]) for r in s.estimate(rows, cells).collect())
    again, loaded = cms.CountMin.load(spark, s.dump(cells))
    assert again == s and {(r["line"], r["cell"]): r["count"] for r in cms.merge((s, cells), (again, loaded))[1].collect()} == {k: 2 * v for k, v in counts.items()}
    with pytest.raises(ValueError):
        cms.CountMin.sized(0, 0.1)


@pytest.mark.parametrize("p", [4, 10, 16])
def test_hll(spark, p):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("element"))
    regs = hll.registers(rows, p)
    expected = {}
    for k in range(3000):
        h = u64(str(k).encode())
        rest = h & ((1 << (64 - p)) - 1)
        rank = (rest & -rest).bit_length() if rest else 64 - p + 1
        expected[h >> (64 - p)] = max(rank, expected.get(h >> (64 - p), 0))
    assert {r["register"]: r["rank"] for r in regs.collect()} == expected
    assert abs(hll.estimate(regs, p).first()[0] / 3000 - 1) < (0.6 if p == 4 else 0.1)
    loaded_p, loaded = hll.load(spark, hll.dump(regs, p))
    assert loaded_p == p and {r["register"]: r["rank"] for r in hll.merge(regs, loaded).collect()} == expected
    assert {r["register"]: r["rank"] for r in hll.registers(rows, p, compat=True).collect()} == {k: v + p for k, v in expected.items()}


def test_hll_edges(spark):
    empty = spark.createDataFrame([], "element string")
    assert hll.estimate(hll.registers(empty, 10), 10).first()[0] == 0
    for bad in (3, 17):
        with pytest.raises(ValueError):
            hll.check_precision(bad)


def simhash(t):
    words = [w for w in "".join(c for c in t.lower() if c.isalpha() or c.isspace()).split() if w not in text.STOP_WORDS]
    sums = [0] * 64
    for w in words:
        digits = "".join(f"{b:b}" for b in hashlib.md5(w.encode()).digest()).rjust(128, "0")[64:128]
        for k, d in enumerate(digits):
            sums[k] += 1 if d == "1" else -1
    return sum(1 << (63 - k) for k, s in enumerate(sums) if s > 0)


def test_simhash(spark):
    texts = ["The quick brown fox, the lazy dog!", "the QUICK brown fox; the lazy dog", "", "and the of", None, "über naïve café", "it's one two two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    made = {r["doc_id"]: r["fingerprint"] & (1 << 64) - 1 for r in text.fingerprints(docs).collect()}
    assert made == {k: simhash(t or "") for k, t in enumerate(texts)}
    assert made[0] == made[1] and made[2] == made[3] == 0
    prints = spark.createDataFrame([(1, 0), (2, 1), (3, 3), (4, -1), (5, -1), (6, 0b111)], "doc_id int, fingerprint long")
    pairs = {(r["a"], r["b"], r["distance"]) for r in text.near_pairs(prints, 2).collect()}
    assert pairs == {(0, 1, 1), (0, 3, 2), (1, 3, 1), (1, 7, 2), (3, 7, 1)}


def merkle(blocks):
    level = [hashlib.md5(b).digest() for b in blocks]
    while len(level) > 1:
        level += [bytes(16)] * (len(level) % 2)
        level = [hashlib.md5(a + b).digest() for a, b in zip(level[::2], level[1::2], strict=True)]
    return level[0].hex()


@pytest.mark.parametrize("n", [1, 4, 5, 13, 40])
def test_merkle(spark, n):
    rows = [(f"k{k:03}", f"v{k}", 1, k, False) for k in range(n)]
    run = write.batch(spark, rows)
    blocks = ["\n".join(f"{r[0]}={r[1]}|0" for r in rows[at : at + 4]).encode() for at in range(0, n, 4)]
    root = integrity.root(run, 4).first()["root"]
    assert root == merkle(blocks)
    tree = integrity.tree(run, 4).collect()
    assert max(tree, key=lambda r: r["level"])["hash"] == root
    changed = run.withColumn("value", F.when(F.col("seq") == n - 1, "?").otherwise(F.col("value")))
    assert [r["idx"] for r in integrity.differing(integrity.leaves(run, 4), integrity.leaves(changed, 4)).collect()] == [(n - 1) // 4]
    assert integrity.root(changed, 4).first()["root"] != root


def test_merkle_beyond_one_fold(spark):
    """More leaves than are folded together at once: 1,030 make eleven levels above them, 2,049 make twelve."""
    for n in (integrity.FAN_OUT + 6, 2 * integrity.FAN_OUT + 1):
        rows = [(f"k{k:05}", f"v{k}", 1, k, False) for k in range(n)]
        run = write.batch(spark, rows)
        level, want = [hashlib.md5(f"{r[0]}={r[1]}|0".encode()).digest() for r in rows], set()
        for depth in range(n.bit_length() + 1):
            want |= {(depth, k, h.hex()) for k, h in enumerate(level)}
            if len(level) == 1:
                break
            level += [bytes(16)] * (len(level) % 2)
            level = [hashlib.md5(a + b).digest() for a, b in zip(level[::2], level[1::2], strict=True)]
        assert {(r["level"], r["idx"], r["hash"]) for r in integrity.tree(run, 1).collect()} == want
        assert [r["root"] for r in integrity.root(run, 1).collect()] == [level[0].hex()]


def test_token_bucket(spark):
    seconds = [0, 1, 2, 10, 11, 12]
    rows = spark.createDataFrame([("a", s) for s in seconds], "bucket string, second long")
    assert [r["admitted"] for r in control.admit(rows, 2, 10).orderBy("second").collect()] == [1, 1, 0, 1, 1, 0]
    rng = random.Random(2)
    wild = sorted(rng.randrange(400) for _ in range(500))
    bucket = control.Bucket(3, 25)
    expected = {}
    for s in wild:
        expected[s] = expected.get(s, 0) + bucket.admit(s)
    rows = spark.createDataFrame([("a", s) for s in wild], "bucket string, second long")
    assert {r["second"]: r["admitted"] for r in control.admit(rows, 3, 25).collect()} == expected


def test_caches():
    lru, fifo = control.Cache(2), control.Cache(2, promote=False)
    for cache in (lru, fifo):
        cache.put("a", 1), cache.put("b", 2), cache.get("a"), cache.put("c", 3)
    assert "a" in lru and "b" not in lru
    assert "a" not in fifo and "b" in fifo
    lru.drop("a")
    assert lru.get("a") is None


def test_dictionary(spark):
    log = write.batch(spark, random_rows(3))
    ids = dictionary.build(log)
    rows = ids.orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(1, len(rows) + 1))
    more = dictionary.build(write.batch(spark, [("new", "1", 1, 0, False), ("k01", "1", 1, 1, False)]), ids)
    assert {r["key"]: r["id"] for r in more.collect()} == {r["key"]: r["id"] for r in rows} | {"new": len(rows) + 1}
    again = dictionary.decode(dictionary.encode(log, ids), ids)
    assert again.select(*MUTATION.names).exceptAll(log).count() == 0 and again.count() == log.count()


def test_tokenizer():
    assert text.tokenize('PUT "a b" c\\"d') == ["PUT", "a b", 'c"d']
    assert text.tokenize('PUT "" x') == ["PUT", "x"]
    assert text.tokenize('PUT "" x', compat=False) == ["PUT", "", "x"]
    assert text.tokenize("  a\tb  ") == ["a", "b"]
    with pytest.raises(ValueError):
        text.tokenize('PUT "a')


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab "\\\t', min_size=1), max_size=4))
def test_quoting_comes_back(words):
    line = " ".join('"' + w.replace("\\", "\\\\").replace('"', '\\"') + '"' for w in words)
    assert text.tokenize(line, compat=False) == words


def test_config():
    made = config.parse('{"MaxMemtableSize": 7, "CompactionAlgorithm": "Leveled", "SummaryStep": 4}')
    assert (made.max_memtable_size, made.compaction) == (7, "leveled")
    for bad in ('{"Nothing": 1}', '{"TokenRate": 0}', '{"CompactionAlgorithm": "x"}'):
        with pytest.raises(ValueError):
            config.parse(bad)


def test_store_and_recovery(spark, tmp_path):
    path = str(tmp_path / "store")
    small = config.Config(max_memtable_size=3, memtable_num=1, max_count_in_level=1)
    store = Store(spark, path, small)
    for k in range(7):
        store.put(f"k{k}", f"v{k}")
    store.delete("k0")
    store.put("k1", "again")
    assert store.get("k0") is None and store.get("k1") == "again" == store.get("k1") and store.get("k9") is None
    again = Store(spark, path, small)
    assert again.get("k1") == "again" and again.get("k6") == "v6"
    assert held(again.range_scan("k1", "k3")) == {"k1": "again", "k2": "v2", "k3": "v3"}
    again.flush()
    assert held(Store(spark, path, small).prefix_scan("k")) == {f"k{k}": "again" if k == 1 else f"v{k}" for k in range(1, 7)}


def test_shell(spark, tmp_path):
    note = tmp_path / "note.txt"
    note.write_text("some words of a note\nand more words")
    shell = Shell(Store(spark, str(tmp_path / "store"), config.Config(token_rate=1000)))
    lines = ['put "a key" one', 'GET "a key"', "GET none", "PUT b two", "DELETE b", "PREFIX_SCAN a 1 5", "PREFIX_SCAN a 9 5", "RANGE_ITERATE a z", "NEXT", "STOP", "VALIDATE"]
    lines += ["BLOOM_CREATE f 100 0.01", "BLOOM_ADD f x", "BLOOM_CHECK f x", "BLOOM_CHECK f y", "BLOOM_DELETE f", "BLOOM_CHECK f x"]
    lines += ["CMS_CREATE c 0.1 0.1", "CMS_ADD c x", "CMS_ADD c x", "CMS_COUNT c x", "HLL_CREATE h 10", "HLL_ADD h x", "HLL_COUNT h", "HLL_CREATE h 3"]
    lines += [f"SIMHASH_CREATE s {note}", "SIMHASH_DISTANCE s s", "PUT a", "PUT __sys__x 1", "WHAT", "HELP", "EXIT", "GET b"]
    said = list(shell.run(iter(lines)))
    assert said[:5] == ['added ["a key" -> one]', 'found ["a key" -> one]', "not found for key none", "added [b -> two]", "deleted b"]
    assert said[5] == 'page 1: 1..1 of 1\n"a key" -> one' and said[6] == "no records (page 9 of 1)"
    assert said[7:11] == ['"a key" -> one', "end", "stopped", "no runs"]
    assert said[13:17] == ["probably", "definitely not", "deleted f", "error: no bloom 'f'"]
    assert said[20] == "about 2 times" and said[23] == "about 1" and said[24].startswith("error")
    assert said[26] == "distance 0" and said[27].startswith("usage") and said[28].startswith("error") and said[29] == "unknown command WHAT"
    assert said[-1] == "bye" and len(said) == len(lines) - 1 and "NEXT" in VERBS
    limited = Shell(shell.store, clock=lambda: 0)
    limited.bucket = control.Bucket(1, 10)
    assert limited.answer("GET none") == "not found for key none" and limited.answer("GET none") == "token limit exceeded, wait"


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    import io

    from tidelog.__main__ import main

    (tmp_path / "config.json").write_text('{"TokenRate": 2, "TokenInterval": 9999}')
    monkeypatch.setattr("sys.stdin", io.StringIO("PUT a 1\r\nGET a\n\nGET a\nEXIT\nGET a\n"))
    main([str(tmp_path / "store"), "--config", str(tmp_path / "config.json")])
    assert capsys.readouterr().out.splitlines() == ["added [a -> 1]", "found [a -> 1]", "token limit exceeded, wait", "bye"]


def rewritten(store, row, change):
    """The files of a run, changed in place."""
    fs, path = store._fs(row["path"])
    change(store.spark.read.parquet(row["path"])).write.parquet(f"{row['path']}-new")
    fs.delete(path, True)
    fs.rename(store._fs(f"{row['path']}-new")[1], path)


def bad(store):
    return sorted(((r["run"], r["part"], r["block"], r["state"]) for r in store.validate().collect()), key=str)


@pytest.mark.parametrize("batches", [False, True])
def test_validate_lists_bad_blocks(spark, tmp_path, batches):
    store = runs.RunStore(spark, str(tmp_path / "runs"), 5)
    rows = [(f"k{k:03}", f"v{k}", k, k, False) for k in range(100)]
    if batches:
        store.append_batches(write.flush_batches(write.batch(spark, rows), 50))
    else:
        store.append(write.batch(spark, rows))
        store.append(write.batch(spark, rows[:1]))
    assert bad(store) == []
    first = store.manifest()[0]
    places = {r["key"]: divmod(r["_place"], 1 << 33) for r in spark.read.parquet(first["path"]).collect()}
    at = lambda key: (first["run"], places[key][0], places[key][1] // 5)
    # Nothing has validated the run before the damage.
    rewritten(store, first, lambda df: df.withColumn("value", F.when(F.col("key") == "k007", "?").otherwise(F.col("value"))))
    assert bad(store) == [(*at("k007"), "changed")]
    last = max(places, key=lambda k: (places[k][0], places[k][1]))
    lost = {at(last), at("k007")}
    rewritten(store, first, lambda df: df.filter(F.col("key") != last))
    assert {b[:3] for b in bad(store)} == lost
    spark.createDataFrame([("new", 1, 1, False, "?", 77 << 33)], "key string, ts long, seq long, tombstone boolean, value string, _place long").write.mode("append").parquet(first["path"])
    assert (first["run"], 77, 0, "added") in bad(store)
    store._fs(first["path"])[0].delete(store._fs(first["path"])[1], True)
    assert {b[3] for b in bad(store)} == {"missing"} and {b[0] for b in bad(store)} == {first["run"]}


def test_validate_sees_kept_hashes_that_were_changed(spark, tmp_path):
    store = runs.RunStore(spark, str(tmp_path / "runs"), 5)
    store.append(write.batch(spark, [(f"k{k:03}", "v", k, k, False) for k in range(60)]))
    (row,) = store.manifest()
    leaves = f"{store.path}/leaves/{row['run']}"
    spark.read.parquet(leaves).withColumn("hash", F.when(F.col("block") == 0, F.lit("0" * 32)).otherwise(F.col("hash"))).write.parquet(f"{leaves}-new")
    store._fs(leaves)[0].delete(store._fs(leaves)[1], True)
    store._fs(leaves)[0].rename(store._fs(f"{leaves}-new")[1], store._fs(leaves)[1])
    assert {b[3] for b in bad(store)} == {"changed", "root"}


def test_validate_in_a_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.put_all({f"k{k}": "v" for k in range(4)})
    store.flush()
    assert list(store.validate().values()) == [[]]
    (row,) = store.runs.manifest()
    rewritten(store.runs, row, lambda df: df.withColumn("value", F.lit("?")))
    assert all(store.validate().values()) and "changed in" in Shell(store).answer("VALIDATE")


def model_tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        row = levels[-1] + [integrity.ZERO_NODE] * (len(levels[-1]) % 2)
        levels.append([hashlib.md5(bytes.fromhex(a + b)).hexdigest() for a, b in zip(row[::2], row[1::2], strict=True)])
    return levels


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 16, 17, 33])
def test_trees_are_folded_in_steps(spark, monkeypatch, n):
    monkeypatch.setattr(integrity, "FAN_OUT", 4)
    run = write.batch(spark, [(f"k{k:03}", "v", k, k, False) for k in range(n)])
    hashes = [r["hash"] for r in integrity.leaves(run, 1).orderBy("idx").collect()]
    levels = model_tree(hashes)
    assert integrity.root(run, 1).first()["root"] == levels[-1][0]
    found = {(r["level"], r["idx"]): r["hash"] for r in integrity.tree(run, 1).collect()}
    assert {at: h for at, h in found.items() if at[1] < len(levels[at[0]])} == {(k, i): h for k, level in enumerate(levels) for i, h in enumerate(level)}


def test_roots_of_groups(spark):
    rows = [(f"r{n}", 0, k, hashlib.md5(f"{n}.{k}".encode()).hexdigest()) for n in range(1, 12) for k in range(n)]
    leaves = spark.createDataFrame(rows, "run string, part long, block long, hash string")
    found = {r["run"]: r["root"] for r in integrity.roots(leaves, "run", 11).collect()}
    assert found == {f"r{n}": model_tree([h for run, _, _, h in rows if run == f"r{n}"])[-1][0] for n in range(1, 12)}


def files(df):
    return {f.rpartition("/")[0].rpartition("/runs/")[2] for f in df.inputFiles()}


def test_reads_open_only_runs_that_may_matter(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), config.Config(max_count_in_level=50))
    for part in range(4):
        # Ranges of all runs meet; keys differ.
        store.put_all({f"k{k:02}": str(part) for k in range(part, 40, 4)})
        store.flush()
    every = {r["run"] for r in store.runs.manifest()}
    assert len(every) == 4
    opened = files(store.mutations(key="k05"))
    assert store.get("k05") == "1" and len(opened) < 4 and store.runs.manifest()[1]["run"] in opened
    assert store.get("k99") is None and store.runs.read(key="k99") is None
    store.put_all({"zz1": "a", "zz2": "b"})
    store.flush()
    assert {r["key"] for r in store.prefix_scan("zz").collect()} == {"zz1", "zz2"} and len(files(store.mutations("zz", runs.successor("zz")))) == 1
    assert {r["key"] for r in store.range_scan("zz", "zz1").collect()} == {"zz1"}


@given(st.text(max_size=4), st.text(max_size=6))
def test_successor_bounds_a_prefix(prefix, rest):
    prefix, rest = prefix.encode(errors="ignore").decode(), rest.encode(errors="ignore").decode()
    above = runs.successor(prefix)
    assert above is None or prefix + rest < above and prefix + rest.replace("\U0010ffff", "") + "\U0010fffe" < above
    assert runs.successor("") is None and runs.successor("\U0010ffff") is None and runs.successor("a\ud7ff") == "a\ue000"


def test_manifest_filters_have_all_keys(spark, tmp_path):
    store = runs.RunStore(spark, str(tmp_path / "runs"))
    keys = [f"č{k}" for k in range(300)]
    store.append(write.batch(spark, [(k, "v", n, n, False) for n, k in enumerate(keys)]))
    store.append_batches(write.flush_batches(write.batch(spark, [(k, "v", n, n, False) for n, k in enumerate(keys)]), 70))
    for row in store.manifest():
        held = {r["key"] for r in spark.read.parquet(row["path"]).collect()}
        made = store.filters(row["min_key"])[row["run"]]
        assert all(runs.may_hold(made, k) for k in held)
        assert sum(runs.may_hold(made, f"other{k}") for k in range(1000)) < 50
    assert runs.may_hold(None, "x")


def test_vacuum(spark, tmp_path):
    store = runs.RunStore(spark, str(tmp_path / "runs"))
    rows = random_rows(3, 200)
    for at in range(0, 100, 25):
        store.append(write.batch(spark, rows[at : at + 25]))
    store.append_batches(write.flush_batches(write.batch(spark, rows[100:]), 25))
    opened = store.read()
    compaction.compact(store, "size_tiered", 2)
    # What a reader may have opened stays for its time.
    assert store.vacuum(3600) == (0, 0) and held(resolve.snapshot(opened)) == model(rows)
    versions = len(store._versions())
    gone = store.vacuum(0, now=2**40)
    assert gone[0] >= 8 and gone[1] == versions - 1 and store.vacuum(0, now=2**40) == (0, 0)
    assert held(resolve.snapshot(store.read())) == model(rows) and bad(store) == []
    listed = {r["run"].partition("/")[0] for r in store.manifest()}
    assert {p.name for p in (tmp_path / "runs" / "runs").iterdir() if not p.name.startswith(".")} == listed


def test_segments_rotate(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), config.Config(max_memtable_size=50, wal_max_records_per_segment=4))
    for k in range(3):
        store.put(f"a{k}", "v")
    store.put_all({f"b{k}": "v" for k in range(7)})
    log = wal.read(spark, f"{store.path}/wal")
    assert {r["segment_id"]: r["count"] for r in log.groupBy("segment_id").count().collect()} == {0: 4, 1: 4, 2: 2}
    assert log.select("segment_id", "position").distinct().count() == 10
    again = Store(spark, store.path, store.config)
    assert again.get("b6") == "v" and again.segment == 3
    again.flush()
    assert not [p for p in (tmp_path / "store" / "wal").iterdir() if p.name.startswith("segment_id=")]


def test_dictionary_is_kept(spark, tmp_path):
    store = DictionaryStore(spark, str(tmp_path / "dictionary"))
    assert store.read().collect() == []
    rows = [("b", "1", 1, 0, False), ("a", "1", 2, 1, False), ("c", "1", 3, 2, False), ("b", "2", 4, 3, False), ("d", "1", 5, 4, False)]
    store.update(write.batch(spark, rows[:2]))
    store.update(write.batch(spark, rows))
    store.update(write.batch(spark, rows))
    again = DictionaryStore(spark, store.path)
    assert {r["key"]: r["id"] for r in again.read().collect()} == {"b": 1, "a": 2, "c": 3, "d": 4} and again.read().count() == 4
    log = write.batch(spark, rows)
    assert sorted(map(tuple, again.decode(again.encode(log)).select(*log.columns).collect()), key=str) == sorted(rows, key=str)


def model_print(text_):
    words = [w for w in "".join(c for c in text_.lower() if c.isalpha() or c in " \t\n").split() if w not in text.STOP_WORDS]
    digits = ["".join(f"{b:b}" for b in hashlib.md5(w.encode()).digest()).rjust(128, "0")[-64:] for w in words]
    found = int("".join("1" if 2 * sum(d[k] == "1" for d in digits) > len(digits) else "0" for k in range(64)), 2)
    return found - (1 << 64) if found >> 63 else found


def test_fingerprints_are_of_rows(spark, monkeypatch):
    rows = [(1, "a quick fox"), (1, "another text with words"), (None, "some words without id"), (None, "quick fox fox"), (2, ""), (3, None), (4, "the"), (5, "word " * 300 + "other " * 200)]
    found = [tuple(r) for r in text.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(found, key=str) == sorted(((d, model_print(t or "")) for d, t in rows), key=str)
    import numpy as np

    bits = np.array([text.word_bits(w) for w in "some words of a text that has several pieces".split()], dtype=np.uint64)
    ends = np.array([0, 3, 3, 8, 9, 9])
    whole = text._summed(bits, ends)
    for piece in (1, 2, 4):
        monkeypatch.setattr(text, "PIECE", piece)
        assert (text._summed(bits, ends) == whole).all()


@pytest.mark.parametrize("radius", range(4))
def test_near_pairs_are_all_pairs_within_the_radius(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(3)]
    prints = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(4))) for b in base for _ in range(25)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in signed + signed[:5]], "fingerprint long")
    expected = {(a, b, d) for k, a in enumerate(signed) for b in signed[k + 1 :] if (d := ((a ^ b) & (1 << 64) - 1).bit_count()) <= radius}
    assert sorted(map(tuple, text.near_pairs(df, radius).collect())) == sorted(expected)


def test_bloom_checks_agree(spark, monkeypatch):
    b = bloom.Bloom.sized(60, 0.2)
    bits = b.add(spark.createDataFrame([(f"w{k}",) for k in range(60)], "element string"))
    probes = spark.createDataFrame([(f"w{k}",) for k in range(40, 200)] * 2, "element string")
    here = {r["element"]: r["maybe"] for r in b.check(probes, bits).collect()}
    monkeypatch.setattr(bloom, "PACKED_BITS", 0)
    assert here == {r["element"]: r["maybe"] for r in b.check(probes, bits).collect()} and len(here) == 160


def test_admission_goes_on_over_batches(spark):
    rng = random.Random(15)
    requests = [(rng.choice("abc"), rng.randrange(5000)) for _ in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        told = {(r["bucket"], r["second"]): (r["requests"], r["admitted"]) for r in control.admit(spark.createDataFrame(requests, "bucket string, second long"), 3, 40).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    buckets, expected = {k: control.Bucket(3, 40) for k in "abc"}, {}
    for b, s in sorted(requests):
        n, admitted = expected.get((b, s), (0, 0))
        expected[b, s] = (n + 1, admitted + buckets[b].admit(s))
    assert told == expected


def test_overlap_counts(spark):
    rng = random.Random(16)
    bounds = [tuple(sorted((f"k{rng.randrange(30):02}", f"k{rng.randrange(30):02}"))) for _ in range(40)]
    manifest = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(bounds)], "flush_id long, min_key string, max_key string")
    meets = lambda x, y: x[0] <= y[1] and y[0] <= x[1]
    assert {r["flush_id"]: r["overlapping"] for r in runs.overlap_counts(manifest).collect()} == {k: sum(meets(x, y) for y in bounds) - 1 for k, x in enumerate(bounds)}
    assert {r["flush_id"] for r in runs.meeting(manifest, F.lit("k05"), F.lit("k08")).collect()} == {k for k, x in enumerate(bounds) if meets(x, ("k05", "k08"))}


def test_sketch_store(spark, tmp_path):
    store = SketchStore(spark, str(tmp_path / "sketches"))
    assert store.load("hll", "a") is None
    store.save("hll", "a", b"1", p=4)
    assert store.load("hll", "a") == (b"1", {"p": 4})
    with pytest.raises(ValueError):
        store.save("hll", "a", b"2", replace=False)
    store.delete("hll", "a")
    assert store.load("hll", "a") is None


def test_streams(spark, tmp_path):
    rows = random_rows(8, 200)
    source = str(tmp_path / "in")
    for at in range(0, 200, 50):
        write.batch(spark, rows[at : at + 50]).coalesce(1).write.mode("append").parquet(source)
    stream = live.mutations(spark, source, MUTATION, files_per_trigger=1)
    q = live.snapshots(stream).writeStream.outputMode("complete").format("memory").queryName("newest").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert held(spark.table("newest").filter("not tombstone")) == model(rows)
    kept = runs.RunStore(spark, str(tmp_path / "kept"))
    for _ in range(2):
        live.materialize(stream, kept, str(tmp_path / "state")).awaitTermination(120)
    assert held(resolve.snapshot(kept.read())) == model(rows) and len(kept.manifest()) == 4
    kept.append(write.batch(spark, rows[:3]), source=kept.manifest()[0]["source"])
    assert len(kept.manifest()) == 4
    store = runs.RunStore(spark, str(tmp_path / "store"))
    for _ in range(2):  # the second pass finds nothing new
        live.flush(stream, store, str(tmp_path / "check"), lambda s: compaction.compact(s, "size_tiered", 2)).awaitTermination(120)
    assert held(resolve.snapshot(store.read())) == model(rows)


def test_streaming_admission(spark, tmp_path):
    rng = random.Random(5)
    requests = sorted((rng.choice("ab"), rng.randrange(100), k) for k in range(120))
    requests.sort(key=lambda r: (r[1], r[2]))
    schema = "bucket string, second long, request long"
    spark.createDataFrame(requests, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.admissions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 3, 20)
    q = stream.writeStream.format("memory").queryName("admitted").trigger(availableNow=True).start()
    q.awaitTermination(180)
    buckets = {k: control.Bucket(3, 20) for k in "ab"}
    assert {r["request"]: r["admitted"] for r in spark.table("admitted").collect()} == {r: buckets[b].admit(s) for b, s, r in requests}
