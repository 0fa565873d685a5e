"""Exact dedup with a heavy-hitter split.

1. Every text is normalised (A-Z to a-z, nothing else) and digested once; the table of
   (doc_id, digest) is written to the shared folder, the texts are not moved.
2. Each task keeps a Misra-Gries summary of its digests with ``counters`` entries.  The
   summaries merge by adding: the merged estimate of a digest lies between
   ``count - n / (counters + 1)`` and ``count``, so every digest with at least
   ``n / heavy`` rows passes the candidate filter and fewer than ``1.5 * heavy`` digests do.
3. The candidates are verified by an exact count; the verified ones and their winners
   (largest doc_id) are at most ``heavy`` rows, which bounds the broadcast: rows of
   frequent digests get their answer on the map side and never meet in one task.
4. All other digests (each under ``n / heavy`` rows) go through an ordinary shuffle.

Defined cases: a null text is the empty text; rows without doc_id take no part; rows that
repeat a doc_id count as rows and all carry the verdict of that id; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from parcelwise.llm.common import keyed_texts, saved, shuffle_partitions, slices, table, utf8

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
DIGESTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("digest", T.BinaryType())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1, 32 << 20):
        digests = [hashlib.sha256(t.translate(LOWER)).digest() for t in utf8(b.column(1))]
        yield table({"doc_id": (b.column(0), pa.int64()), "digest": (digests, pa.binary())})


def trim(counts: Counter, counters: int) -> Counter:
    """A Misra-Gries summary of at most ``counters`` entries from exact or summarised counts:
    the (counters + 1)-th largest count is taken off every entry."""
    if len(counts) <= counters:
        return counts
    off = sorted(counts.values(), reverse=True)[counters]
    return Counter({k: c - off for k, c in counts.items() if c > off})


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            counts.update(b.column(0).to_pylist())
            counts = trim(counts, counters)
        yield table({"digest": (list(counts), pa.binary()), "seen": (list(counts.values()), pa.int64())})
    return run


def heavy_digests(digests: DataFrame, n: int, heavy: int) -> DataFrame:
    """(digest, keep_id, group_size) of the digests with at least ``n / heavy`` rows; at most ``heavy`` rows."""
    counters = 4 * heavy
    least = n / heavy
    candidates = (digests.select("digest").mapInArrow(_summaries(counters), "digest binary, seen long")
                  .groupBy("digest").agg(F.sum("seen").alias("seen"))
                  .where(F.col("seen") >= F.lit(least - n / (counters + 1))).select("digest"))
    return (digests.join(F.broadcast(candidates), "digest")
            .groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
            .where((F.col("group_size") >= F.lit(least)) & (F.col("group_size") > 1)))


def exact_dedup(docs: DataFrame, heavy: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``heavy``: how many frequent digests may be broadcast at most (default: four for each
    shuffle partition, so that what is left of any digest is a fraction of a partition).
    """
    spark = docs.sparkSession
    digests = saved(keyed_texts(docs).mapInArrow(_digest, DIGESTS), "digests")
    n = digests.count()
    winners = saved(heavy_digests(digests, n, heavy or max(256, 4 * shuffle_partitions(spark))), "winners")
    split = digests.join(F.broadcast(winners), "digest", "left")
    group = Window.partitionBy("digest")
    rest = (split.where(F.col("keep_id").isNull()).select("doc_id", "digest")
            .select("doc_id", "digest", F.max("doc_id").over(group).alias("keep_id"),
                    F.count("*").over(group).alias("group_size")))
    both = split.where(F.col("keep_id").isNotNull()).select("doc_id", "digest", "keep_id", "group_size").unionByName(rest)
    return both.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"),
                       F.lower(F.hex("digest")).alias("text_sha256"))
