"""Structured Streaming over the mutation log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators.resolve import newest
from tidelog.session import cut_lineage
from tidelog.sources.runs import RunStore


def mutations(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """The Parquet mutations that arrive in a folder, as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def snapshots(stream: DataFrame) -> DataFrame:
    """The newest mutation of every key as a streaming aggregation (update or complete mode). Late rows are harmless: order decides."""
    return newest(stream)


def materialize(stream: DataFrame, store: RunStore, checkpoint: str) -> StreamingQuery:
    """Keeps the newest mutation of every key of stream in store: each micro-batch appends a run of the keys that it changed.

    Readers see whole runs only.  A micro-batch that is tried again finds its run listed, or, if that was compacted since, writes rows that resolve to the same.
    """

    def write(batch: DataFrame, number: int) -> None:
        # Written out, as dealing rows by ranges reads them twice.
        store.append(cut_lineage(batch), source=f"{checkpoint}#{number}")

    return snapshots(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def flush(stream: DataFrame, store: RunStore, checkpoint: str, after: Callable[[RunStore], object] | None = None) -> StreamingQuery:
    """Writes each micro-batch of stream as one run at level 0, then calls ``after`` (such as a compaction).

    A micro-batch that is tried again after a failure finds its run listed, or writes its rows once more; resolution makes that harmless.
    """

    def write(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        store.append(batch, source=f"{checkpoint}#{number}")
        if after is not None:
            after(store)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def admissions(requests: DataFrame, rate: int, interval: int) -> DataFrame:
    """bucket, request and admitted for a stream of (bucket, second, request), by a window of ``rate`` tokens per bucket.

    The state of a bucket is its window's start and the tokens left.  Requests of a micro-batch are taken in order of second and request.
    """
    kinds = {c: requests.schema[c].dataType.simpleString() for c in ("bucket", "request")}

    def step(key, batches, state):
        import numpy as np
        import pandas as pd

        rows = pd.concat(list(batches)).sort_values(["second", "request"])
        second = rows["second"].to_numpy()
        start, left = state.get if state.exists else (None, 0)
        admitted, at = np.zeros(len(rows), dtype=bool), 0
        # A window at a time: its first requests are admitted, as many as tokens are left.
        while at < len(rows):
            if start is None or second[at] - start >= interval:
                start, left = int(second[at]), rate
            end = int(np.searchsorted(second, start + interval))
            taken = min(left, end - at)
            admitted[at : at + taken] = True
            left, at = left - taken, end
        state.update((start, left))
        yield pd.DataFrame({"bucket": key[0], "request": rows["request"].to_numpy(), "admitted": admitted})

    grouped = requests.select("bucket", F.col("second").cast("long"), "request").groupBy("bucket")
    return grouped.applyInPandasWithState(step, f"bucket {kinds['bucket']}, request {kinds['request']}, admitted boolean", "start long, left long", "append", "NoTimeout")
