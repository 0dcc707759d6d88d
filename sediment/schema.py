"""Configuration and schemas of the versioned key-value log."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import types as T

PUT, DELETE = "PUT", "DELETE"

#: A mutation. ``seq`` orders all mutations; the greatest one of a key holds.
MUTATION = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("ts", T.LongType()),
        T.StructField("user", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("key", T.StringType(), False),
        T.StructField("value", T.StringType()),
    ]
)
#: A stored mutation: Parquet under level=/run_id=, sorted by key inside each file.
RUN = T.StructType([*MUTATION.fields, T.StructField("level", T.IntegerType()), T.StructField("run_id", T.StringType())])


@dataclass(frozen=True)
class KVConfig:
    """Settings with the defaults of the shipped configuration; sizes in bytes."""

    # The shipped configuration.
    tombstone: str = "<KURTCOBAIN!>"
    block_size: int = 40
    summary_step: int = 3
    token_refill_rate: float = 0.1
    max_token: int = 1000
    memtable_type: str = "hashmap"
    memtable_count: int = 1
    memtable_size: int = 20
    wal_segment_size: int = 1000
    wal_buffer_size: int = 3
    bloom_filter_false_positive_rate: float = 0.01
    bloom_filter_expected_elements: int = 10
    lsm_levels: int = 2
    lsm_base_dir: str = "data/sstable"
    compaction_threshold: int = 2
    min_prefix_length: int = 1
    max_prefix_length: int = 10
    skip_list_levels: int = 4
    cache_capacity: int = 10

    @classmethod
    def from_json(cls, text: str) -> KVConfig:
        """Keys in any case; unknown ones are an error."""
        given = {k.lower(): v for k, v in json.loads(text).items()}
        known = {f.name for f in fields(cls)}
        if extra := sorted(set(given) - known):
            raise ValueError(f"unknown settings: {', '.join(extra)}")
        return cls(**given)
