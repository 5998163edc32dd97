"""Admission by token bucket, and client-side caches."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Verbs that cost a token.
THROTTLED = frozenset(
    "PUT GET DELETE PREFIX_SCAN RANGE_SCAN PREFIX_ITERATE RANGE_ITERATE BLOOM_CREATE BLOOM_ADD BLOOM_CHECK CMS_CREATE CMS_ADD CMS_COUNT HLL_CREATE HLL_ADD HLL_COUNT SIMHASH_CREATE SIMHASH_DISTANCE".split()
)


def throttled(verb: Column) -> Column:
    return F.upper(verb).isin(sorted(THROTTLED))


def admit(requests: DataFrame, rate: int, interval: int) -> DataFrame:
    """bucket, second, requests and admitted, for every second of every bucket.

    requests has bucket and second (integer).  A bucket's window starts with its first
    request and holds ``rate`` tokens; the first request at ``interval`` seconds or more
    after that start begins a new window.  Requests of one second are counted before
    they meet, so a bucket's fold sees one row per second, however many requests it has.
    """
    if rate < 1 or interval < 1:
        raise ValueError("rate and interval start at 1")
    seconds = requests.select("bucket", F.col("second").cast("long")).groupBy("bucket", "second").agg(F.count("*").alias("requests"))

    kind = requests.schema["bucket"].dataType.simpleString()
    # A bucket's seconds follow one another in one partition; state goes from batch to batch, so that no bucket is held as a whole.
    dealt = seconds.repartition("bucket").sortWithinPartitions("bucket", "second")

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, start, left = object(), 0, 0
        for batch in batches:
            admitted = []
            for own, second, number in zip(*(batch.column(c).to_pylist() for c in ("bucket", "second", "requests")), strict=True):
                if own != bucket or second - start >= interval:
                    bucket, start, left = own, second, rate
                taken = number if number < left else left
                left -= taken
                admitted.append(taken)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(admitted, pa.int64())], names=["bucket", "second", "requests", "admitted"])

    return dealt.mapInArrow(fold, f"bucket {kind}, second long, requests long, admitted long")


class Bucket:
    """The same for one client, request by request."""

    def __init__(self, rate: int, interval: int):
        self.rate, self.interval = rate, interval
        self.start: int | None = None
        self.left = 0

    def admit(self, second: int) -> bool:
        if self.start is None or second - self.start >= self.interval:
            self.start, self.left = second, self.rate
        if not self.left:
            return False
        self.left -= 1
        return True


class Cache:
    """A bounded cache of values on the client; ``promote`` makes it least-recently-used, else first-in first-out."""

    def __init__(self, size: int, promote: bool = True):
        self.size, self.promote = size, promote
        self._held: OrderedDict = OrderedDict()

    def get(self, key):
        if key in self._held and self.promote:
            self._held.move_to_end(key)
        return self._held.get(key)

    def put(self, key, value) -> None:
        if key in self._held and self.promote:
            self._held.move_to_end(key)
        self._held[key] = value
        while len(self._held) > self.size:
            self._held.popitem(last=False)

    def drop(self, key) -> None:
        self._held.pop(key, None)

    def __contains__(self, key) -> bool:
        return key in self._held
