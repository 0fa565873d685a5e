"""Token ids as ORC files, read back by stripes.

Documents are range-partitioned by doc_id and sorted, so the part files follow each other
in ascending doc_id order, and each worker encodes its range and streams it to one file.
ORC stores the ids with integer run-length encoding, keeps minimum and maximum of doc_id
for each stripe and each row group (the row index), and a Bloom filter of doc_id for each
row group: a lookup reads the few row groups that can hold the id, a scan reads
stripes in parallel.

The global start of a document is the total of all files before its own (one row for each
file) plus a running sum inside the file.

Defined cases: a null text is the empty text (the end id alone); rows without doc_id take
no part; rows that repeat a doc_id are all written, in order of a hash of their texts (each file numbers its
rows, and the index counts along these numbers); an empty table gives an empty result; the files hold whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from parcelwise.llm.common import keyed_texts, saved, scratch, shuffle_partitions, slices, table
from parcelwise.llm.encoding import encoder

SCHEMA = "doc_id long, part int, row long, ids array<int>"


def _encode(path: str, kind: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, row = encoder(path, kind), TaskContext.get().partitionId(), 0
        for b in slices(batches, 1, 4 << 20):
            flat, ends = enc.encode_column(b.column(1))
            flat = np.insert(flat, ends[1:], end).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends + np.arange(len(ends)), pa.int32()), pa.array(flat))
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(np.full(n, part), pa.int32()),
                                              pa.array(np.arange(row, row + n), pa.int64()), ids], names=["doc_id", "part", "row", "ids"])
            row += n
    return run


def write_token_orc(docs: DataFrame, target: str, tokenizer: str, kind: str, end: int,
                    stripe_bytes: int = 64 << 20, row_group: int = 10_000, false_positives: float = 0.01) -> None:
    """Encode whole texts, append ``end`` to each document, write ORC in ascending doc_id order."""
    p = shuffle_partitions(docs.sparkSession)
    tie = F.xxhash64("text")
    (keyed_texts(docs).repartitionByRange(p, "doc_id", tie).sortWithinPartitions("doc_id", tie)
     .mapInArrow(_encode(tokenizer, kind, end), SCHEMA)
     .write.option("compression", "zstd").option("orc.stripe.size", stripe_bytes)
     .option("orc.row.index.stride", row_group).option("orc.create.index", "true")
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", false_positives).orc(target))


def read_token_orc(spark: SparkSession, target: str) -> DataFrame:
    """(doc_id, ids); a filter on doc_id is pushed to the stripes' and row groups' metadata."""
    return spark.read.schema(SCHEMA).orc(target).select("doc_id", "ids")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("ids")
        values = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
        ends = ids.offsets.to_numpy()
        yield table({"doc_id": (b.column("doc_id"), pa.int64()), "part": (b.column("part"), pa.int32()), "row": (b.column("row"), pa.int64()),
                     "n_tokens": (np.diff(ends), pa.int64()),
                     "ids_crc32": ([zlib.crc32(values[s:e]) for s, e in zip(ends[:-1], ends[1:])], pa.int64())})


def token_index(spark: SparkSession, target: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    rows = saved(spark.read.schema(SCHEMA).orc(target)
                 .mapInArrow(_measure, "doc_id long, part int, row long, n_tokens long, ids_crc32 long"), "token_rows")
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)   # one row for each file
    files = files.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(files, "part")
            .select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))


def token_output(docs: DataFrame, tokenizer: str, kind: str = "word", end: int = 2) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and return their index."""
    spark = docs.sparkSession
    target = scratch(spark, "tokens")
    write_token_orc(docs, target, tokenizer, kind, end)
    return token_index(spark, target)
