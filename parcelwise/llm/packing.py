"""Best-fit-decreasing packing of documents into fixed-length sequences.

A document's ids (end id included) are cut only when longer than a sequence: all pieces
but the first then have full length.  Best fit decreasing places pieces from the longest
to the shortest, each in the open bin with the least room that still holds it; that bin
is found in a segment tree over the remaining capacities in logarithmic time.

Only lengths decide, and bins with equal room are interchangeable, so the placing runs on
the histogram of lengths (at most ``capacity`` rows, whatever the input): a step places as
many pieces of one length as go to bins of one remaining capacity.  Its result is exactly
that of the piece-by-piece rule and is a short list of ranges "pieces a to b of length n go
to the bins from c on, t in each, at offset o"; each length splits at most two ranges, so the
list does not grow with the input.  Pieces are numbered within their length by a
distributed count: (length, slice) counts first, where a hash of the piece chooses the slice,
then a row number inside each slice, so one common length never meets in one task.

Defined cases: a null text is the empty text (the end id alone); rows without doc_id take
no part; rows that repeat a doc_id are packed each for itself; an empty table gives an empty
result; very long texts become many full pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from parcelwise.llm.common import keyed_texts, saved, shuffle_partitions, slices, table
from parcelwise.llm.encoding import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``n`` ids: the first may be shorter."""
    first = n % capacity
    edges = ([0] if first else []) + list(range(first, n + 1, capacity))
    return list(zip(edges, edges[1:]))


def _pieces(path: str, kind: str, end: int, capacity: int, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, kind, remembered)
        for b in slices(batches, 1, 4 << 20):
            out = []
            flat, ends = enc.encode_column(b.column(1))
            flat, ends = np.insert(flat, ends[1:], end).astype("<u4"), ends + np.arange(len(ends))
            for doc, first, last in zip(b.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                out += [(doc, i, s, e - s, zlib.crc32(flat[first + s:first + e])) for i, (s, e) in enumerate(cuts(last - first, capacity))]
            doc, piece, start, length, crc = zip(*out)
            yield table({"doc_id": (doc, pa.int64()), "piece": (piece, pa.int32()), "start": (start, pa.int64()),
                         "length": (length, pa.int64()), "ids_crc32": (crc, pa.int64())})
    return run


class CapacityTree:
    """Segment tree over remaining capacities: which of them have open bins."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)

    def mark(self, room: int, used: bool) -> None:
        i = room + self.leaves
        self.any[i] = used
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of at least ``least`` that has an open bin."""
        i = least + self.leaves
        while not self.any[i]:
            while i & 1:          # a right child: go up until there is something to the right
                i //= 2
            if i == 0:
                return None
            i += 1
            if i & (i - 1) == 0:  # past the last leaf of this level
                return None
        while i < self.leaves:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Ranges (length, first, last + 1, bin, per bin, offset) and the number of bins."""
    tree, open_, plan, bins = CapacityTree(capacity), defaultdict(list), [], 0

    def give(room: int, a: int, b: int) -> None:
        if a < b and room:
            open_[room].append((a, b))
            tree.mark(room, True)

    for length in sorted(histogram, reverse=True):
        at, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, need = capacity, -(-left // (capacity // length))
                a, b = bins, bins + need
                bins += need
            else:
                a, b = open_[room].pop()
                if not open_[room]:
                    tree.mark(room, False)
            per = room // length
            full = min(b - a, left // per)
            if full:
                plan.append((length, at, at + full * per, a, per, capacity - room))
                give(room - per * length, a, a + full)
                at, left, a = at + full * per, left - full * per, a + full
            if left and a < b:          # fewer than a bin takes: the rest of this length
                plan.append((length, at, at + left, a, per, capacity - room))
                give(room - left * length, a, a + 1)
                at, left, a = at + left, 0, a + 1
            give(room, a, b)
    return plan, bins


def numbered(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``rank``: 0, 1, ... within each length."""
    s = shuffle_partitions(pieces.sparkSession)
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(s)).cast("int"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = (sliced.groupBy("length", "slice").count()
            .select("length", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")))
    inside = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    return (sliced.withColumn("inside", F.row_number().over(inside) - 1).join(base, ["length", "slice"])
            .withColumn("rank", F.col("base") + F.col("inside")).drop("slice", "base", "inside"))


def _place(plan: list[tuple[int, int, int, int, int, int]]):
    rows = np.array(sorted(plan), np.int64).reshape(-1, 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, firsts = rows[:, 0], rows[:, 1]
        keys = lengths << 44 | firsts
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            inside = rank - firsts[at]
            cols = {n: (b.column(n), pa.int32() if n == "piece" else pa.int64()) for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield table(cols | {"sequence_id": (rows[at, 3] + inside // rows[at, 4], pa.int64()),
                                "offset": (rows[at, 5] + inside % rows[at, 4] * length, pa.int64())})
    return run


def pack(docs: DataFrame, tokenizer: str, kind: str = "byte", end: int = 0, capacity: int = 2048,
         remembered: int = 32 << 20) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    ``remembered``: bytes of a generation of chunks that a worker's encoder keeps (memory and time only)."""
    pieces = saved(keyed_texts(docs).mapInArrow(_pieces(tokenizer, kind, end, capacity, remembered), PIECES), "pieces")
    lengths = pieces.groupBy("length").count()            # at most ``capacity`` rows
    plan, _ = best_fit_decreasing({r["length"]: r["count"] for r in lengths.collect()}, capacity)
    return numbered(pieces).mapInArrow(_place(plan), PIECES + ", sequence_id long, offset long")
