"""Exact top-k inner-product search by columnar branch and bound.

Vectors become integers, ``floor(1024 * x)``.  Queries are dealt into blocks and rows into
groups; the task of one (group, query block) cell holds that block of queries and reads its
rows block by block, so its memory is bounded on both sides.

A row block is kept in vertical layout (all rows' values of one dimension together).  For
each query, partial products are accumulated one block of dimensions at a time.  By Cauchy
and Schwarz what the remaining dimensions can still add lies within plus or minus
``|q_rest| * |x_rest|``; a row whose upper bound is below the k-th best lower bound (or the
k-th best score that the cell has found so far) cannot reach the result, and the survivors
are compacted before the next block.  Survivors of the last block have exact scores.  Each cell
gives at most k rows per query, and a window over these gives the result.

Defined cases: vectors that are null or hold a null or non-finite component take no part;
rows without id take no part; a shorter vector counts as filled up with zeros; equal scores
go to the smaller id; repeated rows are separate rows: each is a query of its own and a candidate, but no row is a
candidate of a query with its own id; an empty table gives an empty result.  Scores are 64-bit integers (products that
do not fit wrap around: components of at most 2^20 and 2^20 dimensions are safe).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from parcelwise.llm.common import saved, table

ROWS, QUERIES, BLOCK = 4096, 16_384, 8     # rows of a row block, queries of a query block, dimensions of a step


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(row, id, v array<long>) of the vectors that take part; ``row`` is unique."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.where(F.col(key).isNotNull() & v.isNotNull() & finite) \
        .select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * F.lit(1024.0))).alias("v"))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """The vectors as columns: (dimensions, rows), filled up with zeros."""
    ends = lists.offsets.to_numpy()
    sizes = np.diff(ends)
    out = np.zeros((int(sizes.max(initial=0)), len(sizes)), np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)[ends[0]:ends[-1]]
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes), rows] = flat
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row blocks in vertical layout."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            b = whole.slice(at, ROWS)
            m = _matrix(b.column(1))
            yield table({"first": ([b.column(0)[0].as_py()], pa.int64()), "ids": ([b.column(0).to_numpy().tobytes()], pa.binary()),
                         "values": ([m.tobytes()], pa.binary())})


def _rest(m: np.ndarray) -> np.ndarray:
    """Row s: for each column the norm of its dimensions from step s on (rounded up)."""
    steps = -(-m.shape[0] // BLOCK)
    out = np.zeros((steps + 1, m.shape[1]))
    for s in range(steps - 1, -1, -1):
        out[s] = out[s + 1] + np.square(m[s * BLOCK:(s + 1) * BLOCK].astype(np.float64)).sum(axis=0)
    return np.sqrt(out) * (1 + 1e-12)


def bounded_scores(query: np.ndarray, q_rest: np.ndarray, m: np.ndarray, rest: np.ndarray, alive: np.ndarray, k: int, floor: float):
    """Columns of ``m`` (among ``alive``) that can be in the top k, with their exact scores."""
    partial = np.zeros(len(alive), np.int64)
    for s in range(len(rest) - 1):
        for d in range(s * BLOCK, min((s + 1) * BLOCK, m.shape[0])):
            if query[d]:
                partial += query[d] * (m[d] if len(alive) == m.shape[1] else m[d, alive])
        if len(alive) <= k:
            continue
        slack = q_rest[s + 1] * rest[s + 1, alive] + 1
        floor = max(floor, float(np.partition(partial - slack, len(alive) - k)[len(alive) - k]))
        keep = partial + slack >= floor
        if not keep.all():
            alive, partial = alive[keep], partial[keep]
    return alive, partial


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, queries, best = None, [], {}

        def result():
            rows = [(row, q, i, s) for (row, q), found in best.items() for s, i in found]
            row, q, i, s = zip(*rows) if rows else ((), (), (), ())
            return table({"row": (row, pa.int64()), "query_id": (q, pa.int64()), "vec_id": (i, pa.int64()), "score": (s, pa.int64())})

        for b in batches:
            for key, ids, values in zip(*(b.column(n).to_pylist() for n in ("cell", "ids", "values"))):
                if key != cell:
                    if best:
                        yield result()
                    cell, queries, best = key, [], {}
                if ids is None:              # queries of a cell come before its rows
                    q = np.frombuffer(values, np.int64)
                    queries.append((int(q[0]), int(q[1]), q[2:]))
                    continue
                ids = np.frombuffer(ids, np.int64)
                m = np.frombuffer(values, np.int64).reshape(-1, len(ids))
                rest = _rest(m)
                for row, qid, q in queries:
                    wide = np.zeros(m.shape[0], np.int64)
                    wide[:min(len(q), m.shape[0])] = q[:m.shape[0]]
                    found = best.get((row, qid), [])
                    floor = float(found[-1][0]) if len(found) == k else -np.inf
                    at, scores = bounded_scores(wide, _rest(wide[:, None])[:, 0], m, rest, np.flatnonzero(ids != qid), k, floor)
                    if len(at) > k:      # the k best, ties to the smaller id
                        top = np.lexsort((ids[at], -scores))[:k]
                        at, scores = at[top], scores[top]
                    best[row, qid] = sorted(found + list(zip(scores.tolist(), ids[at].tolist())), key=lambda x: (-x[0], x[1]))[:k]
        if best:
            yield result()
    return run


def top_k(vectors: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "embedding",
          group_rows: int = 16 * ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows for each row where ``is_query`` (a Column over ``id``) holds."""
    spark = vectors.sparkSession
    rows = saved(usable(vectors, key, vector), "vectors")
    queries = rows.where(is_query)
    n, nq = rows.count(), queries.count()
    groups, qblocks = max(1, -(-n // group_rows)), max(1, -(-nq // QUERIES))
    spread = max(groups, min(n // ROWS, spark.sparkContext.defaultParallelism))    # small tables still use all cores
    groups = spread
    wide = queries.select("row", "id", "v", F.pmod(F.xxhash64("row"), F.lit(qblocks)).alias("qb")).select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "qb", "row", "id", "v")
    asked = wide.select((F.col("g") * qblocks + F.col("qb")).alias("cell"), "row", "id", "v") \
        .mapInArrow(_query_rows, "cell long, first long, ids binary, values binary")
    blocks = rows.select("id", "v").mapInArrow(_blocks, "first long, ids binary, values binary") \
        .withColumn("g", F.pmod(F.xxhash64("first"), F.lit(groups))) \
        .select(F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1))).alias("qb"), "g", "first", "ids", "values") \
        .select((F.col("g") * qblocks + F.col("qb")).alias("cell"), "first", "ids", "values")
    cells = asked.unionByName(blocks).repartition(groups * qblocks, "cell") \
        .sortWithinPartitions("cell", F.col("ids").asc_nulls_first())
    found = cells.mapInArrow(_search(k), "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _query_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, ids = (b.column(n).to_pylist() for n in ("row", "id"))
        ends, flat = b.column("v").offsets.to_numpy(), b.column("v").values.to_numpy(zero_copy_only=False).astype(np.int64)
        values = [np.r_[np.int64(r), np.int64(i), flat[s:e]].astype(np.int64).tobytes() for r, i, s, e in zip(rows, ids, ends[:-1], ends[1:])]
        yield table({"cell": (b.column("cell"), pa.int64()), "first": (ids, pa.int64()),
                     "ids": ([None] * len(ids), pa.binary()), "values": (values, pa.binary())})
