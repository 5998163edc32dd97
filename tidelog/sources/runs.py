"""Sorted immutable runs in Parquet, and the manifest that lists them."""

from __future__ import annotations

import hashlib
import re
import struct
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions.bloom import Bloom
from tidelog.functions.hashing import bit, modulo, seeded_md5
from tidelog.model import MUTATION
from tidelog.operators import integrity
from tidelog.operators.ordering import with_row_index
from tidelog.operators.resolve import newest

MANIFEST = "run string, level int, min_key string, max_key string, records long, tombstones long, newest_ts string, created long, path string, leaves long, root string, filter binary, source string"
LEAVES = "run string, part long, block long, hash string"
#: A run's filter is kept in the manifest up to so many bits (64 KB); a larger run has Parquet's own filters alone.
FILTER_BITS, FALSE_POSITIVES = 1 << 19, 0.01
#: Parquet's filters on the key, as large as a row group's keys need.
KEY_FILTER = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
#: Records of a block whose hash is kept.
BLOCK = 128
_PLACE = "_place"


def successor(prefix: str) -> str | None:
    """The least string above all that start with prefix, in the order of code points; None if there is none."""
    for at in range(len(prefix) - 1, -1, -1):
        code = ord(prefix[at]) + 1
        if code <= 0x10FFFF:
            return prefix[:at] + chr(0xE000 if 0xD800 <= code < 0xE000 else code)
    return None


def packed(bloom: Bloom, words: Iterable[tuple[int, int]]) -> bytes:
    """A manifest's filter: bits and hashes (32 bits each, big-endian), then the words (number, 64 bits) of set bits."""
    held = [0] * (bloom.m // 64 + 1)
    for at, value in words:
        held[at] = value & (1 << 64) - 1
    return struct.pack(f">II{len(held)}Q", bloom.m, bloom.k, *held)


def may_hold(filter_: bytes | None, key: str) -> bool:
    """Whether a run with this filter may hold key; one without a filter may."""
    if filter_ is None:
        return True
    m, k = struct.unpack_from(">II", filter_)
    for seed in range(k):
        at = int.from_bytes(hashlib.md5(key.encode() + struct.pack(">I", seed)).digest()[:8], "big") % m
        if not struct.unpack_from(">Q", filter_, 8 + at // 64 * 8)[0] >> at % 64 & 1:
            return False
    return True


def _words(bloom: Bloom, rows: DataFrame, *by: str) -> DataFrame:
    """by, word and value: the words of the filters over the keys of each group."""
    seeds = F.explode(F.sequence(F.lit(0), F.lit(bloom.k - 1))).alias("seed")
    at = modulo(seeded_md5(F.col("key"), F.col("seed")), bloom.m).alias("at")
    return rows.select(*by, "key", seeds).select(*by, at).groupBy(*by, F.expr("at div 64").alias("word")).agg(F.bit_or(bit(F.col("at") % 64)).alias("value"))


_TOLD = ("min", "max", "records", "tombstones", "newest")


def _told() -> list[Column]:
    return [c.alias(name) for name, c in zip(_TOLD, (F.min("key"), F.max("key"), F.count("*"), F.count_if("tombstone"), F.max("ts").cast("string")), strict=True)]


class RunStore:
    """Runs below a folder that all executors share.

    A run is one Parquet folder, sorted by key over disjoint files, with Bloom filters on
    the key.  Each row has its place in the run, and the hashes of the run's blocks are kept
    beside it, under their root.  A manifest version is a Parquet folder as well; readers take
    the newest complete one, so a write that fails half-way is never seen.
    """

    def __init__(self, spark: SparkSession, path: str, block: int = BLOCK, single_file: bool = False):
        self.spark, self.path, self.block, self.single_file = spark, path.rstrip("/"), block, single_file

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _versions(self) -> list[int]:
        """The complete versions of the manifest."""
        fs, folder = self._fs(f"{self.path}/manifest")
        if not fs.exists(folder):
            return []
        names = [s.getPath() for s in fs.listStatus(folder)]
        complete = [p.getName() for p in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p.toString() + "/_SUCCESS"))]
        return sorted(int(m[1]) for n in complete if (m := re.fullmatch(r"v(\d+)", n)))

    def _listed(self, version: int | None = None) -> DataFrame | None:
        """A manifest (the newest one) as a DataFrame; None if there is none."""
        if version is None:
            version = max(self._versions(), default=-1)
        return None if version < 0 else self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v{version}")

    def manifest(self, version: int | None = None) -> list[Row]:
        """The rows of a manifest, oldest run first and without filters: a short row per run, whatever its size."""
        listed = self._listed(version)
        return [] if listed is None else sorted(listed.drop("filter").collect(), key=lambda r: (r["created"], r["run"]))

    def commit(self, new: Iterable[tuple] = (), drop: Iterable[str] = (), moved: dict[str, int] | None = None) -> None:
        """Makes the next version: the newest one without the runs of drop, with those of moved at their new levels, and with new rows.

        Of two writers at once, one fails on the version's folder.
        """
        version = max(self._versions(), default=-1)
        rows = self.spark.createDataFrame(list(new), MANIFEST)
        if (listed := self._listed(version)) is not None:
            kept = listed.filter(~F.col("run").isin(list(drop))) if drop else listed
            for run, level in (moved or {}).items():
                kept = kept.withColumn("level", F.when(F.col("run") == run, level).otherwise(F.col("level")))
            rows = kept.unionByName(rows)
        rows.coalesce(1).write.parquet(f"{self.path}/manifest/v{version + 1}")

    def write(self, mutations: DataFrame, level: int = 0, horizon=None, source: str | None = None, created: int | None = None) -> tuple | None:
        """Writes one run (the newest mutation of every key, without tombstones before horizon) and returns its manifest row, or None if nothing is left to write.

        created is the run's place in the order of runs, behind all listed ones unless it is given.
        """
        run = uuid.uuid4().hex
        path = f"{self.path}/runs/{run}"
        rows = newest(mutations)
        if horizon is not None:
            rows = rows.filter(~F.col("tombstone") | (F.col("ts") >= horizon))
        # One file takes one task, so that it is for small runs or for who asks for it.
        ranged = rows.repartition(1) if self.single_file else rows.repartitionByRange("key")
        dealt = ranged.sortWithinPartitions("key").withColumn(_PLACE, F.monotonically_increasing_id())
        dealt.write.options(**KEY_FILTER).parquet(path)
        held = self.spark.read.schema(dealt.schema).parquet(path)
        told = held.agg(*_told()).first()
        if not told["records"]:
            return None
        leaves, root = self._write_leaves(held.withColumn("run", F.lit(run)), run, told["records"])
        if created is None:
            created = max((r["created"] for r in self.manifest()), default=0) + 1
        bloom = Bloom.sized(told["records"], FALSE_POSITIVES)
        filter_ = packed(bloom, _words(bloom, held.select("key")).collect()) if bloom.m <= FILTER_BITS else None
        return run, level, *told, created, path, leaves, root, filter_, source

    def _write_leaves(self, held: DataFrame, run: str, records: int) -> tuple[int, str]:
        """Writes the leaves of one run; returns their number and the root."""
        self._leaves(held).write.parquet(f"{self.path}/leaves/{run}")
        leaves = self.spark.read.schema(LEAVES).parquet(f"{self.path}/leaves/{run}")
        # A file ends a block.
        most = records // self.block + len(held.inputFiles())
        if most <= integrity.FAN_OUT:
            return tuple(integrity.roots(leaves, "run", most).first()[1:])
        numbered = with_row_index(leaves, "part", "block", name="idx").select("idx", "hash")
        return leaves.count(), integrity.root_of(numbered).first()["root"]

    def _leaves(self, held: DataFrame) -> DataFrame:
        return integrity.stored_leaves(held.withColumnRenamed(_PLACE, "place"), self.block, "run")

    def append_batches(self, batches: DataFrame, level: int = 0) -> None:
        """Writes a run for every flush_id of batches and lists them, in a fixed number of jobs however many there are."""
        last = F.max(F.struct("ts", "seq", "tombstone", "value")).alias("last")
        rows = batches.groupBy("flush_id", "key").agg(last).select("flush_id", "key", "last.*")
        folder = uuid.uuid4().hex
        path = f"{self.path}/runs/{folder}"
        # A batch is as long as a flush at most, so that its records can be numbered by a window.
        dealt = rows.withColumn(_PLACE, F.row_number().over(Window.partitionBy("flush_id").orderBy("key")).cast("long") - 1)
        dealt.write.partitionBy("flush_id").options(**KEY_FILTER).parquet(path)
        held = self.spark.read.schema(dealt.schema).parquet(path)
        told = {r["flush_id"]: tuple(r)[1:] for r in held.groupBy("flush_id").agg(*_told()).collect()}
        if not told:
            return
        most = max(t[2] for t in told.values())
        named = held.withColumn("run", F.concat(F.lit(f"{folder}/flush_id="), F.col("flush_id").cast("string")))
        self._leaves(named).write.parquet(f"{self.path}/leaves/{folder}")
        leaves = self.spark.read.schema(LEAVES).parquet(f"{self.path}/leaves/{folder}")
        roots = {r["run"]: (r["n"], r["root"]) for r in integrity.roots(leaves, "run", -(-most // self.block)).collect()}
        bloom, words = Bloom.sized(most, FALSE_POSITIVES), {}
        if bloom.m <= FILTER_BITS:
            listed = _words(bloom, held.select("flush_id", "key"), "flush_id").groupBy("flush_id").agg(F.collect_list(F.struct("word", "value")).alias("words"))
            words = {r["flush_id"]: packed(bloom, r["words"]) for r in listed.toLocalIterator()}
        listed = self.manifest()
        first, new = max((r["created"] for r in listed), default=0) + 1, []
        for at, (flush_id, stats) in enumerate(sorted(told.items())):
            run = f"{folder}/flush_id={flush_id}"
            new.append((run, level, *stats, first + at, f"{self.path}/runs/{run}", *roots[run], words.get(flush_id), None))
        self.commit(new)

    def append(self, mutations: DataFrame, level: int = 0, source: str | None = None) -> None:
        """Writes one run and lists it. If a listed run has the same source (a name for what it was made from), nothing is written."""
        listed = self.manifest()
        if source is not None and any(r["source"] == source for r in listed):
            return
        created = max((r["created"] for r in listed), default=0) + 1
        if (row := self.write(mutations, level, source=source, created=created)) is not None:
            self.commit([row])

    def runs_for(self, low: str | None = None, high: str | None = None, key: str | None = None) -> list[Row]:
        """The runs whose key range meets low to high (None: open), and whose filter lets key pass if one is given."""
        rows = [r for r in self.manifest() if (high is None or r["min_key"] <= high) and (low is None or r["max_key"] >= low)]
        if key is None:
            return rows
        passed = {run for run, held in self.filters(key).items() if may_hold(held, key)}
        return [r for r in rows if r["run"] in passed]

    def filters(self, key: str) -> dict[str, bytes | None]:
        """The filter of each run whose key range holds key."""
        listed = self._listed()
        if listed is None:
            return {}
        return {r["run"]: r["filter"] for r in listed.filter((F.col("min_key") <= key) & (F.col("max_key") >= key)).select("run", "filter").collect()}

    def read(self, low: str | None = None, high: str | None = None, schema=None, key: str | None = None) -> DataFrame | None:
        """All rows of the runs that ``runs_for`` gives; None if there is no such run."""
        rows = self.runs_for(low, high, key)
        return self.open([r["path"] for r in rows], schema) if rows else None

    def open(self, paths: list[str], schema=None) -> DataFrame:
        """All rows of the runs at paths as one scan; without a schema the first run's holds for all."""
        rows = self.spark.read.schema(schema or self.spark.read.parquet(paths[0]).schema).parquet(*paths)
        return rows.drop(_PLACE)

    def validate(self) -> DataFrame:
        """run, part, block and state of every block that is not as it was written, over all runs of the manifest at once.

        state is changed, missing or added; a run whose kept hashes no longer have the manifest's root has
        a row root without part and block.  Files that can't be read count as missing.
        """
        rows = [r for r in self.manifest() if r["root"] is not None]
        if not rows:
            return self.spark.createDataFrame([], "run string, part long, block long, state string")
        listed = self.spark.createDataFrame([(r["run"], r["root"], r["leaves"]) for r in rows], "run string, kept_root string, n long")
        reader = self.spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
        ts = self.spark.read.parquet(rows[0]["path"]).schema["ts"].dataType.simpleString() if self._readable(rows[0]["path"]) else "long"
        schema = f"key string, ts {ts}, seq long, tombstone boolean, value string, {_PLACE} long"
        folders = sorted({r["run"].partition("/")[0] for r in rows})
        present = [f for f in folders if self._readable(f"{self.path}/runs/{f}")]
        held = self._located(reader.option("recursiveFileLookup", "true").schema(schema), [f"{self.path}/runs/{f}" for f in present]) if present else None
        kept = reader.schema(LEAVES).parquet(*[f"{self.path}/leaves/{f}" for f in folders if self._readable(f"{self.path}/leaves/{f}")]).join(F.broadcast(listed), "run")
        if held is None:
            found = kept.select("run", "part", "block", F.lit(None).cast("string").alias("found")).limit(0)
        else:
            found = self._leaves(held.join(F.broadcast(listed.select("run")), "run", "left_semi")).withColumnRenamed("hash", "found")
        both = kept.select("run", "part", "block", "hash").join(found, ["run", "part", "block"], "full")
        state = F.when(F.col("found").isNull(), "missing").when(F.col("hash").isNull(), "added").when(F.col("hash") != F.col("found"), "changed")
        bad = both.select("run", "part", "block", state.alias("state")).filter("state is not null")
        return bad.unionByName(self._bad_roots(kept, listed))

    def _bad_roots(self, kept: DataFrame, listed: DataFrame) -> DataFrame:
        """The runs whose kept hashes are not all there or have another root, found by making the roots anew."""
        small = listed.filter(F.col("n") <= integrity.FAN_OUT)
        made = integrity.roots(kept.join(F.broadcast(small.select("run")), "run", "left_semi"), "run", integrity.FAN_OUT).drop("n")
        for row in listed.filter(F.col("n") > integrity.FAN_OUT).collect():  # few: each has more than FAN_OUT blocks
            numbered = with_row_index(kept.filter(F.col("run") == row["run"]), "part", "block", name="idx").select("idx", "hash")
            made = made.unionByName(integrity.root_of(numbered).select(F.lit(row["run"]).alias("run"), "root"))
        wrong = listed.join(made, "run", "left").filter(~F.col("root").eqNullSafe(F.col("kept_root")))
        return wrong.select("run", F.lit(None).cast("long").alias("part"), F.lit(None).cast("long").alias("block"), F.lit("root").alias("state"))

    def _readable(self, path: str) -> bool:
        fs, hadoop = self._fs(path)
        return fs.exists(hadoop)

    @staticmethod
    def _located(reader, paths: list[str]) -> DataFrame:
        """The rows of runs with their run, which is their files' folder below runs."""
        rows = reader.parquet(*paths)
        return rows.withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), r".*/runs/(.*)/[^/]*$", 1))

    def vacuum(self, retention: float, now: float | None = None) -> tuple[int, int]:
        """Deletes what no manifest lists that is the newest one or younger than retention seconds, and older manifests; returns the numbers of runs and manifests deleted.

        A reader that opened the store within that time finds all its files; so does a writer whose run is not listed yet.
        """
        limit = (now or time.time()) - retention
        versions = self._versions()
        if not versions:
            return 0, 0
        fs, folder = self._fs(f"{self.path}/manifest")
        made = {int(s.getPath().getName()[1:]): s.getModificationTime() / 1000 for s in fs.listStatus(folder) if re.fullmatch(r"v\d+", s.getPath().getName())}
        # A version was the newest one until the next was made.
        old = [v for v, after in zip(versions, versions[1:], strict=False) if made[after] < limit]
        paths = [f"{self.path}/manifest/v{v}" for v in versions if v not in old]
        kept = {r["run"] for r in self.spark.read.schema(MANIFEST).parquet(*paths).select("run").distinct().collect()}
        folders = {k.partition("/")[0] for k in kept}
        gone = 0
        for top in self._list(f"{self.path}/runs"):
            name = top.getPath().getName()
            inner = [s for s in self._list(f"{self.path}/runs/{name}") if s.getPath().getName().startswith("flush_id=")]
            if name not in folders:
                if top.getModificationTime() / 1000 < limit:
                    fs.delete(top.getPath(), True)
                    fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/leaves/{name}"), True)
                    gone += max(1, len(inner))
                continue
            for status in inner:
                if f"{name}/{status.getPath().getName()}" not in kept and status.getModificationTime() / 1000 < limit:
                    fs.delete(status.getPath(), True)
                    gone += 1
        for version in old:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/v{version}"), True)
        return gone, len(old)

    def _list(self, path: str) -> list:
        fs, hadoop = self._fs(path)
        return list(fs.listStatus(hadoop)) if fs.exists(hadoop) else []


def manifest_of(batches: DataFrame) -> DataFrame:
    """What a manifest would list for flush batches: flush_id, min_key, max_key, records and tombstones."""
    return batches.groupBy("flush_id").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("records"), F.count_if("tombstone").alias("tombstones"))


def overlap_counts(manifest: DataFrame) -> DataFrame:
    """flush_id and overlapping: with how many other runs each run's key range meets, by a sweep over sorted bounds.

    The runs that meet one are those that begin up to its end, but for those that end before its beginning.
    Beginnings come before ends where keys are equal, so that touching ranges meet.
    """
    begins = manifest.select("flush_id", F.col("min_key").alias("key"), F.lit(0).alias("kind"))
    ends = manifest.select("flush_id", F.col("max_key").alias("key"), F.lit(1).alias("kind"))
    # A bound's number among all bounds, less that among its own kind, is the number of the other kind before it.
    every = with_row_index(begins.unionByName(ends), "key", "kind", "flush_id", name="of_all").select("flush_id", "kind", "of_all")
    own = with_row_index(begins, "key", "flush_id", name="of_kind").unionByName(with_row_index(ends, "key", "flush_id", name="of_kind"))
    other = every.join(own, ["flush_id", "kind"]).select("flush_id", "kind", (F.col("of_all") - F.col("of_kind")).alias("other"))
    begun = F.sum(F.when(F.col("kind") == 1, F.col("other")))
    ended = F.sum(F.when(F.col("kind") == 0, F.col("other")))
    return other.groupBy("flush_id").agg((begun - ended - 1).alias("overlapping"))


def meeting(manifest: DataFrame, low: Column, high: Column) -> DataFrame:
    """flush_id of the runs whose key range meets low to high: what a compaction that starts from that range takes along."""
    return manifest.filter((F.col("min_key") <= high) & (F.col("max_key") >= low)).select("flush_id")
