"""Shared helpers of the training-data operators.

Rows and intermediate tables
----------------------------
* A row whose key (``doc_id``, ``vec_id``, ``page_id``) is null cannot be reported and
  takes no part; a null text counts as the empty text unless an operator says otherwise.
* Operators read only the columns they name, so further columns of a table, whatever
  their names, never clash.
* Intermediate tables are written as Parquet under ``spark.checkpoint.dir`` (shared by
  the driver and all executors), which cuts the lineage: a lost executor costs the
  tasks that were running on it and nothing that was written before.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.session import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder (any file system Spark can write)."""
    checkpoint_dir(spark)   # names a folder of its own only where the session has none
    base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key as long, text) of the rows that have a key."""
    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)) \
        .where(F.col(key).isNotNull())


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text_at: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each slice holds about ``max_bytes`` of text or one row."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(text_at)
        if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
            col = col.cast(pa.large_binary())
        elif pa.types.is_large_string(col.type):
            col = col.cast(pa.large_binary())
        offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
        start = 0
        while start < b.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + max_bytes, side="right")) - 1
            end = min(max(end, start + 1), b.num_rows)
            yield b.slice(start, end - start)
            start = end
    pa.default_memory_pool().release_unused()     # a worker lives on after its task


def group_ends(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and lengths of the runs of equal values in a sorted array."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return starts, np.diff(np.r_[starts, len(sorted_keys)])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(s, s + n)`` over the given starts and lengths."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    nz = lengths > 0
    s, n = starts[nz], lengths[nz]
    heads = np.cumsum(n) - n
    out[heads] = s
    out[heads[1:]] -= s[:-1] + n[:-1] - 1
    return np.cumsum(out)


def table(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    """A record batch from ``name -> (values, type)``."""
    return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in columns.values()], names=list(columns))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 63-bit hash of each number."""
    h = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h ^ (h >> np.uint64(31))).astype(np.int64) & np.int64((1 << 63) - 1)


def word_hash(words: pa.Array) -> np.ndarray:
    """A 63-bit hash of the bytes of each string."""
    raw = words.cast(pa.large_binary())
    if not len(raw):
        return np.zeros(0, np.int64)
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0]:ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    sizes = np.diff(ends)
    parts = mixed((np.arange(len(data)) - np.repeat(ends[:-1] - ends[0], sizes)) * 257 + data + 1)
    sums = np.zeros(len(sizes), np.int64)
    if len(data):
        sums[sizes > 0] = np.add.reduceat(parts, (ends[:-1] - ends[0])[sizes > 0])
    return mixed(sums)
