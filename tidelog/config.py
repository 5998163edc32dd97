"""Settings, read from JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    """What a store can be told. Sizes of memory structures and caches that have no counterpart in Spark are accepted only."""

    max_memtable_size: int = 5
    memtable_num: int = 2
    lru_cache_size: int = 3
    token_rate: int = 100
    token_interval: int = 60
    wal_max_records_per_segment: int = 50
    merkle_block: int = 128
    compaction: str = "size_tiered"
    max_count_in_level: int = 5
    #: Whether a run is one file, however many records it has.
    single_file: bool = False
    #: Seconds for which compacted runs and old manifests stay, for readers that opened them.
    retention: int = 3600

    def __post_init__(self):
        if self.compaction not in ("size_tiered", "leveled"):
            raise ValueError(f"unknown compaction {self.compaction!r}")
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, int) and not isinstance(value, bool) and value < 1:
                raise ValueError(f"{f.name} starts at 1")


#: Names of the JSON settings, and of the fields that take them.
NAMES = {
    "MaxMemtableSize": "max_memtable_size",
    "MemtableNum": "memtable_num",
    "LRUCacheSize": "lru_cache_size",
    "TokenRate": "token_rate",
    "TokenInterval": "token_interval",
    "WalMaxRecordsPerSegment": "wal_max_records_per_segment",
    "BlockSize": "merkle_block",
    "CompactionAlgorithm": "compaction",
    "MaxCountInLevel": "max_count_in_level",
    "SSTableSingleFile": "single_file",
    "RetentionSeconds": "retention",
}
#: Settings of structures that Spark and Parquet have themselves.
ACCEPTED = {"MemtableStruct", "SkipListLevelNum", "BTreeDegree", "BlockCacheSize", "WalBlocksPerSegment", "SummaryStep", "SSTableCompression"}
COMPACTIONS = {"SizeTiered": "size_tiered", "Leveled": "leveled"}


def parse(text: str) -> Config:
    """The settings of a JSON object; unknown ones are an error."""
    found = {}
    for name, value in json.loads(text).items():
        if name in NAMES:
            found[NAMES[name]] = COMPACTIONS.get(value, value) if name == "CompactionAlgorithm" else value
        elif name not in ACCEPTED:
            raise ValueError(f"unknown setting {name!r}")
    return Config(**found)
