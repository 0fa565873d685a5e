"""SimHash near-dedup by a segment-popcount embedding.

Fingerprints (64 bits) come from word shingles.  A fingerprint is embedded as the vector
of the bit counts of its 16 four-bit segments.  Flipping one bit moves that vector by one
step, so the Manhattan distance of two vectors is a lower bound of the bit distance, and
fingerprints within 2 bits lie within 2 steps: each lies within one step of a common
lattice point.  Every distinct fingerprint is therefore written to the (at most 33)
lattice cells within one step, an equi-join on the cell finds all candidates, and the bit
distance of each candidate is verified exactly.

Dense places (many distinct fingerprints with one vector, as a large family of near copies
makes them) are not joined pair by pair.  A vector held by more than ``dense`` fingerprints
makes the cells around it hot; fingerprints of hot cells are embedded once more with
segments of one bit, where the Manhattan distance equals the bit distance: two
fingerprints are within 2 bits if and only if they share one of the 65 cells within one
step.  A cell of that grid can hold at most 65 fingerprints; each is linked to the
smallest.  So both grids together find every link, cold cells hold at most 33 x ``dense``
rows, and no group is ever expanded into all its pairs.  A distance other than 2 widens
the lattice balls: only 0 to 2 are offered.

Spark sizes the 33 or 65 rows that a fingerprint becomes as the one row that was read: the
cells and points are joined by merge and never broadcast on that estimate.  Neither are the
tables read back, whose compressed files say little about their rows in memory.

Defined cases: a null text is the empty text; a text without words has fingerprint zero and
is linked like any other; texts with fewer words than a shingle use the whole word
sequence; rows without doc_id take no part; repeated rows get the same answer; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import keyed_texts, saved, shuffle_partitions, slices, table, utf8
from parcelwise.llm.components import components
from parcelwise.llm.exact_dedup import LOWER

SEED = 42
SEGMENTS, WIDTH = 16, 4


def fingerprint(text: bytes, words: int = 3) -> int:
    """The 64-bit SimHash of the ``words``-word shingles of a UTF-8 text, as unsigned int."""
    seq = b" ".join(text.translate(LOWER).split())   # bytes.split(): space and \t \n \v \f \r
    if not seq:
        return 0
    gaps = np.flatnonzero(np.frombuffer(seq, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(seq)]
    h = xxhash.xxh64_intdigest
    if len(starts) < words:
        hashes = np.array([h(seq, SEED)], np.uint64)
    else:
        hashes = np.fromiter((h(seq[s:e], SEED) for s, e in zip(starts, ends[words - 1:])), np.uint64, len(starts) - words + 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i:i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 32 << 20):
            fps = np.array([fingerprint(t, words) for t in utf8(b.column(1))], np.uint64).view(np.int64)
            yield table({"doc_id": (b.column(0), pa.int64()), "fp": (fps, pa.int64())})
    return run


def segment_counts(fps: np.ndarray) -> np.ndarray:
    """The bit counts (n, 16) of the four-bit segments of unsigned fingerprints."""
    shifts = np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(WIDTH)
    nibbles = (fps[:, None] >> shifts) & np.uint64(15)
    return np.array([bin(i).count("1") for i in range(16)], np.int64)[nibbles.astype(np.int64)]


def cells_within_one_step(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of all lattice cells at most one step from each embedded fingerprint."""
    counts = segment_counts(fps)
    unit = np.int64(1) << (3 * np.arange(SEGMENTS, dtype=np.int64))
    own = counts @ unit
    up_row, up_seg = np.nonzero(counts < WIDTH)
    down_row, down_seg = np.nonzero(counts > 0)
    rows = np.concatenate([np.arange(len(fps)), up_row, down_row])
    return rows, np.concatenate([own, own[up_row] + unit[up_seg], own[down_row] - unit[down_seg]])


def _own_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unit = np.int64(1) << (3 * np.arange(SEGMENTS, dtype=np.int64))
    for b in batches:
        fps = b.column(0).to_numpy().view(np.uint64)
        yield table({"cell": (segment_counts(fps) @ unit, pa.int64())})


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells at most one step from a cell (given as its packed counts)."""
    unit = np.int64(1) << (3 * np.arange(SEGMENTS, dtype=np.int64))
    for b in batches:
        own = b.column(0).to_numpy()
        counts = (own[:, None] // unit) & 7
        up, up_seg = np.nonzero(counts < WIDTH)
        down, down_seg = np.nonzero(counts > 0)
        yield table({"cell": (np.concatenate([own, own[up] + unit[up_seg], own[down] - unit[down_seg]]), pa.int64())})


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            b = whole.slice(at, 4096)
            fp, rep = b.column(0).to_numpy(), b.column(1).to_numpy()
            rows, cells = cells_within_one_step(fp.view(np.uint64))
            yield table({"cell": (cells, pa.int64()), "fp": (fp[rows], pa.int64()), "rep": (rep[rows], pa.int64())})


def _ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    masks = np.r_[np.uint64(0), np.uint64(1) << np.arange(64, dtype=np.uint64)]
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            b = whole.slice(at, 4096)
            points = (b.column(0).to_numpy().view(np.uint64)[:, None] ^ masks).view(np.int64).ravel()
            yield table({"point": (points, pa.int64()), "rep": (np.repeat(b.column(1).to_numpy(), 65), pa.int64())})


def links(reps: DataFrame, distance: int = 2, dense: int = 32) -> DataFrame:
    """(a, b): links between the representatives of distinct fingerprints (fp, rep) that are
    at most ``distance`` bits apart; the links of a dense place are a connected star forest."""
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")
    hot = saved(reps.select("fp").mapInArrow(_own_cell, "cell long").groupBy("cell").count()
                .where(F.col("count") > dense).select("cell").mapInArrow(_neighbours, "cell long").distinct(), "hot_cells")
    cells = reps.mapInArrow(_emit, "cell long, fp long, rep long")
    cold = cells.join(hot, "cell", "left_anti")
    a, b = cold.alias("a"), cold.hint("merge").alias("b")
    pairs = a.join(b, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.rep") < F.col("b.rep"))
                   & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance)) \
        .select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))
    crowded = cells.join(hot, "cell", "left_semi").select("fp", "rep").distinct()
    if distance < 2:     # the shared-cell test of the fine grid is exact for 2 only
        fine = crowded.mapInArrow(_ball, "point long, rep long") if distance else None
        if fine is None:
            return pairs.distinct()
        own = crowded.select(F.col("fp").alias("point"), F.col("rep").alias("a"))
        stars = fine.join(own.hint("merge"), "point").where("a < rep").select("a", F.col("rep").alias("b"))
    else:
        points = crowded.mapInArrow(_ball, "point long, rep long").repartition(shuffle_partitions(reps.sparkSession), "point")
        low = points.groupBy("point").agg(F.min("rep").alias("a"))
        stars = points.join(low.hint("merge"), "point").where("a < rep").select("a", F.col("rep").alias("b"))
    return pairs.unionByName(stars).distinct()


def simhash_dedup(docs: DataFrame, words: int = 3, distance: int = 2, dense: int = 32) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    fps = saved(keyed_texts(docs).mapInArrow(_fingerprints(words), "doc_id long, fp long"), "fingerprints")
    reps = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "representatives")
    found = components(links(reps, distance, dense))
    labels = reps.join(found.hint("merge"), reps["rep"] == found["id"], "left") \
        .select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(labels.hint("merge"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
