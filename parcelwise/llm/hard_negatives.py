"""Hard negatives by an inverted multi-index.

Vectors become integers, ``floor(scale * x)``, and are cut into two halves.  Each half has a
codebook (k-means on a bounded sample; it decides the speed only, never a result), and the pair of
nearest codewords is a row's cell.  For an anchor ``a`` and a cell (i, j) Cauchy and Schwarz give

    a1.c1[i] + |a1| r1[i] + a2.c2[j] + |a2| r2[j]  >=  a.x  for every row x of the cell,

r being the largest distance of a row's half to its codeword.  A multi-sequence heap over the two
sorted lists of half bounds yields the cells from the largest bound down.  A search is a set of score
windows, each wanting its k best rows: it stops once every window is certified, that is, k rows are found
whose scores are above the next cell's bound, or that bound is below the window.  Cells whose
lower bound lies above all windows are passed over.

Rows are dealt into shards by a hash; a task holds one shard (bounded by ``shard_rows``) as a
multi-index of its own and the anchors stream past it, so only the anchors are
copied, once for each shard.  Two rounds: the k best rows of the anchor's own label (its positives),
then, with the positives' scores known, the k best rows of other labels in each
positive's window.  Every shard gives at most k rows a window, and one window function merges them.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no
part, nor do rows without id; a shorter vector counts as filled up with zeros; equal scores go
to the smaller id; repeated rows are separate rows: each is an anchor of its own and a candidate,
but never for an anchor with its own id; a negative positive score has an empty window; an empty table gives an
empty result; further columns are ignored.  Scores are exact integers: products are taken in
floating point only where all of them stay below 2^53, otherwise in 64-bit integers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from parcelwise.llm.common import saved, table

EXACT = 1 << 53
BATCH = 256          # rows scored at a time


def usable(vectors: DataFrame, label: Column, scale: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(row, id, label, v array<long>) of the rows that take part; ``row`` is unique."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.where(F.col(key).isNotNull() & v.isNotNull() & label.isNotNull() & finite) \
        .select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), label.cast("long").alias("label"),
                F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """The vectors as rows, filled up with zeros."""
    ends = lists.offsets.to_numpy()
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), width), np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)[ends[0]:ends[-1]]
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def codebook(points: np.ndarray, words: int, rounds: int = 6, seed: int = 1) -> np.ndarray:
    """Codewords of half vectors by k-means."""
    if not len(points):
        return np.zeros((1, points.shape[1]))
    different = np.unique(points, axis=0)
    words = min(words, len(different))
    centres = different[np.random.default_rng(seed).choice(len(different), words, replace=False)].astype(np.float64)
    for _ in range(rounds):
        near = nearest(points, centres)
        n = np.bincount(near, minlength=words)
        for d in range(points.shape[1]):
            sums = np.bincount(near, weights=points[:, d], minlength=words)
            centres[:, d] = np.where(n > 0, sums / np.maximum(n, 1), centres[:, d])
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin(np.square(centres).sum(axis=1) - 2 * (points.astype(np.float64) @ centres.T), axis=1)


class MultiIndex:
    """The inverted multi-index of one shard."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, m: np.ndarray, books: tuple[np.ndarray, np.ndarray]):
        half = books[0].shape[1]
        codes, self.radius, self.books = [], [], books
        for part, book in zip((m[:, :half], m[:, half:]), books):
            code = nearest(part, book) if len(part) else np.zeros(0, np.int64)
            far = np.sqrt(np.square(part - book[code]).sum(axis=1))
            r = np.full(len(book), -np.inf)              # no row: nothing to find there
            np.maximum.at(r, code, far)
            codes.append(code)
            self.radius.append(r)
        cell = codes[0] * len(books[1]) + codes[1]
        order = np.lexsort((ids, cell))
        self.ids, self.labels, self.m, self.half = ids[order], labels[order], m[order], half
        self.ends = np.searchsorted(cell[order], np.arange(len(books[0]) * len(books[1]) + 1))
        self.most = float(np.abs(m).max(initial=0))
        self.floats = self.m.astype(np.float64)

    def scores(self, a: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.most * float(np.abs(a).max(initial=0)) * max(len(a), 1) < EXACT:
            return (self.floats[rows] @ a.astype(np.float64)).astype(np.int64)
        return (self.m[rows] * a).sum(axis=1)

    def cells(self, a: np.ndarray) -> Iterator[tuple[float, float, int]]:
        """(upper bound, lower bound, cell) of the cells that have rows, from the largest upper bound down."""
        mid, slack = [], []
        for part, book, r in zip((a[:self.half], a[self.half:]), self.books, self.radius):
            part = part.astype(np.float64)
            mid.append(book @ part)
            slack.append(np.sqrt(part @ part) * np.where(r < 0, 0, r) * (1 + 1e-9) + 1e-6)
        upper = [np.where(r < 0, -np.inf, c + s) for c, s, r in zip(mid, slack, self.radius)]
        first, second = (np.argsort(-u, kind="stable") for u in upper)
        u1, u2 = upper[0][first], upper[1][second]
        n1, n2, wide = int(np.isfinite(u1).sum()), int(np.isfinite(u2).sum()), len(self.books[1])
        if not n1 or not n2:
            return
        heap = [(-(u1[0] + u2[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            if j + 1 < n2:
                heapq.heappush(heap, (-(u1[i] + u2[j + 1]), i, j + 1))
            if j == 0 and i + 1 < n1:
                heapq.heappush(heap, (-(u1[i + 1] + u2[0]), i + 1, 0))
            c, d = int(first[i]), int(second[j])
            if self.ends[c * wide + d] < self.ends[c * wide + d + 1]:
                yield -bound, float(mid[0][c] - slack[0][c] + mid[1][d] - slack[1][d]), c * wide + d

    def search(self, a: np.ndarray, wanted: np.ndarray, windows: list[tuple[float, float]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (lowest, highest score) the k best wanted rows in it: (ids, scores), ties to the smaller id.
        ``wanted``: which rows may be found."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(windows)
        wide = [w for w, (low, high) in enumerate(windows) if low <= high]
        margin = 1e-9 * self.most * float(np.abs(a).sum()) + 1e-6       # rounding of the bounds
        rows: list[np.ndarray] = []
        waiting = 0

        def take() -> None:
            at = np.concatenate(rows)
            at = at[wanted[at]]
            s, ids = self.scores(a, at), self.ids[at]
            for w in wide:
                low, high = windows[w]
                inside = (s >= low) & (s <= high)
                if inside.any():
                    i, t = np.r_[found[w][0], ids[inside]], np.r_[found[w][1], s[inside]]
                    best = np.lexsort((i, -t))[:k]
                    found[w] = i[best], t[best]
            rows.clear()

        for upper, lower, cell in self.cells(a):
            bound = upper + margin
            if waiting >= BATCH:
                take()
                waiting = 0
            open_ = [w for w in wide if bound >= windows[w][0] and not (len(found[w][0]) == k and found[w][1][-1] > bound)]
            if not open_:
                break                # certified; rows that wait are still looked at
            if lower - margin <= max(windows[w][1] for w in open_):
                rows.append(np.arange(self.ends[cell], self.ends[cell + 1]))
                waiting += len(rows[-1])
        if rows:
            take()
        return found


def _shards(run, books, width: int):
    """Rows of a shard (kind 0) make its index, the anchors after them (kind 1) go to ``run``."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, index = None, [], None
        for batch in batches:
            keys, kinds = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])])
            for start, end in zip(edges, np.r_[edges[1:], len(keys)]):
                b = batch.slice(start, end - start)
                if keys[start] != shard:
                    shard, parts, index = keys[start], [], None
                ids, labels, m = b.column("id").to_numpy(), b.column("label").to_numpy(), matrix(b.column("v"), width)
                if kinds[start] == 0:
                    parts.append((ids, labels, m))
                    continue
                if not parts and index is None:
                    continue                             # a shard without rows
                if index is None:
                    index = MultiIndex(*(np.concatenate(x) for x in zip(*parts)), books.value)
                    parts = []
                yield run(index, b.column("row").to_pylist(), ids, labels, m, b.column("positives").to_pylist())
    return task


FOUND = "row long, id long, nth long, positive_id long, positive_score long, vec_id long, score long"


def _result(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 7
    return table({n: (c, pa.int64()) for n, c in zip(("row", "id", "nth", "positive_id", "positive_score", "vec_id", "score"), cols)})


def _positives(k: int):
    def run(index, rows, ids, labels, m, _):
        out = []
        for row, i, label, a in zip(rows, ids.tolist(), labels, m):
            (found, scores), = index.search(a, (index.labels == label) & (index.ids != i), [(-np.inf, np.inf)], k)
            out += [(row, i, None, None, None, f, s) for f, s in zip(found.tolist(), scores.tolist())]
        return _result(out)
    return run


def _negatives(k: int, least: int, most: int, of: int):
    def run(index, rows, ids, labels, m, positives):
        out = []
        for row, i, label, a, given in zip(rows, ids.tolist(), labels, m, positives):
            # whole scores n with least * p <= of * n <= most * p
            windows = [(-(-least * p["score"] // of), most * p["score"] // of) for p in given]
            for nth, (p, (found, scores)) in enumerate(zip(given, index.search(a, (index.labels != label) & (index.ids != i), windows, k))):
                out += [(row, i, nth, p["vec_id"], p["score"], f, s) for f, s in zip(found.tolist(), scores.tolist())]
        return _result(out)
    return run


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, scale: int = 256, positives: int = 5, negatives: int = 5,
                   least: int = 80, most: int = 100, of: int = 100, key: str = "vec_id", vector: str = "embedding",
                   words: int = 16, sample: int = 16_384, shard_rows: int = 65_536) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    For each row where ``is_anchor`` (a Column over ``id``) holds: its ``positives`` best rows of the same label, and for
    each of these the ``negatives`` best rows of other labels whose score n satisfies
    least * p <= of * n <= most * p.  ``words`` and ``sample`` (rows the codebooks are fitted on, the first by a hash of the
    id) and ``shard_rows`` (rows a task holds) change the speed and memory only."""
    spark = vectors.sparkSession
    rows = saved(usable(vectors, label, scale, key, vector), "vectors")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(2, width)
    drawn = rows.select("v", F.xxhash64("id", "row").alias("h"), "row").orderBy("h", "row").limit(sample).select("v").toArrow()
    m = matrix(drawn.column("v").combine_chunks(), width) if drawn.num_rows else np.zeros((0, width), np.int64)
    books = spark.sparkContext.broadcast((codebook(m[:, :width // 2], words), codebook(m[:, width // 2:], words)))
    shards = max(1, -(-n // shard_rows), min(n // 4096, spark.sparkContext.defaultParallelism))
    shard = F.pmod(F.xxhash64("row"), F.lit(shards))
    none = F.lit(None).cast("array<struct<vec_id:long,score:long>>")
    stored = rows.select(shard.alias("shard"), F.lit(0).alias("kind"), "row", "id", "label", "v", none.alias("positives"))

    def visit(anchors: DataFrame, run) -> DataFrame:
        asked = anchors.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(1).alias("kind"),
                               "row", "id", "label", "v", "positives")
        return stored.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "kind") \
            .mapInArrow(_shards(run, books, width), FOUND)

    def first(found: DataFrame, by: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    anchors = rows.where(is_anchor)
    best = first(visit(anchors.withColumn("positives", none), _positives(positives)), ["row"], positives)
    best = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p")) \
        .select("row", F.transform("p", lambda x: F.struct(x["vec_id"].alias("vec_id"), x["score"].alias("score"))).alias("positives"))
    asked = saved(anchors.join(best, "row"), "positives")
    found = visit(asked, _negatives(negatives, least, most, of))
    return first(found, ["row", "nth"], negatives).select(
        F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
