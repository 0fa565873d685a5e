"""Removal of repeated passages by longest-previous-factor arrays.

A byte goes when a string of ``length`` bytes that covers it also starts in a document
with a smaller doc_id; the first document to hold a passage keeps it.

Suffixes are sorted bucket by bucket instead of in one array.  The bucket of a position is
the smallest hash of the ``anchor``-byte strings inside its ``length``-byte prefix, which
depends on these bytes alone: equal prefixes always meet in one bucket.  Neighbouring
positions mostly share that minimum, so each bucket receives runs of positions with their
bytes (about 3.4 bytes for each byte of text, compressed to less than half).

In a bucket, positions whose prefix hash occurs in one document only are set aside (their longest previous
factor is shorter than ``length``); the others are sorted by their prefix: that is the suffix order as
far as ``length`` bytes decide it.  The common prefixes of neighbours are counted, the previous and the next
suffix of a smaller document are found for every suffix by pointer jumping, and the larger of the smallest common prefixes on
the way to them is its longest previous factor.  Positions whose factor reaches ``length`` mark their bytes.

Groups of copies: a run of positions identical to one of a smaller document is marked at
once, and what it would match the other one does too.  This is done in each map chunk, where
such runs are not even sent, and again in each bucket before its suffixes are sorted.  A run
that reaches over an edge of a repeated passage, or around a frequent string inside varying
text, has other bytes in every document, though, and is no copy.

Hot anchors: runs are counted by a slot of their minimum in a sample of the texts.  Where a slot holds
at least ``hot`` runs and eight times the mean slot, the runs' positions go on one by one,
by the hash of their whole prefix instead of the anchor's.  That is a rule on the
prefix alone too, so equal prefixes still meet, and the sample never changes a result.
Of equal prefixes in a chunk only the smallest document's positions are sent, the others
are marked at once: a prefix costs a bucket one document's positions for each chunk, and
prefixes that differ are spread over all buckets.  Marks and texts meet by doc_id, never by content.

Defined cases: a null text is the empty text; texts shorter than ``length`` lose nothing;
matches never cross documents; very long texts are cut into overlapping pieces that give
the same positions; rows without doc_id take no part; rows that repeat a doc_id are one document to
the rule (none is smaller than the other) and keep their own marks; an empty table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import group_ends, keyed_texts, ranges, saved, shuffle_partitions, slices, table, utf8
from parcelwise.llm.merkle import positions

CHUNK = 6 << 20          # bytes of text in a map chunk
PIECE = 1 << 20          # positions of a long text that are taken at once
MUL = np.uint64(0x9E3779B97F4A7C15)   # an odd multiplier (2^64 / golden ratio)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * MUL
    h ^= h >> np.uint64(32)
    return h * MUL


BYTE = _mix(np.arange(1, 257, dtype=np.uint64))                   # a hash of each byte value
STEP = _mix(np.arange(1001, 1033, dtype=np.uint64)) | np.uint64(1)     # odd multipliers
BLOCK = 1 << 15          # positions hashed at once: the arrays stay in the processor's cache


def _hash_block(data: np.ndarray, length: int) -> np.ndarray:
    out, done, h, size, left, n = None, 0, BYTE[data], 1, length, len(data) - length + 1
    for level in range(length.bit_length()):
        if left & 1:
            part = h[done:done + n]
            out = part.copy() if out is None else out * STEP[level + 16] + part
            done += size
        left >>= 1
        if left:
            h = h[:-size] * STEP[level] + h[size:]
            size *= 2
    return out


def prefix_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes from each position of a uint8 array (by doubling)."""
    n = max(len(data) - length + 1, 0)
    out = np.empty(n, np.uint64)
    for at in range(0, n, BLOCK):
        out[at:at + BLOCK] = _hash_block(data[at:at + BLOCK + length - 1], length)
    return out


def window_minima(data: np.ndarray, length: int, anchor: int) -> np.ndarray:
    """For each ``length`` bytes the smallest hash of the ``anchor``-byte strings in them."""
    n, width = max(len(data) - length + 1, 0), length - anchor + 1
    out = np.empty(n, np.uint64)
    for at in range(0, n, BLOCK):
        h, size = _mix(_hash_block(data[at:at + BLOCK + length - 1], anchor)), 1
        while size * 2 <= width:
            h = np.minimum(h[:-size], h[size:])
            size *= 2
        out[at:at + BLOCK] = h if size == width else np.minimum(h[:len(h) - (width - size)], h[width - size:])
    return out


def runs_of(chunk: list[tuple[int, bytes]], length: int, anchor: int):
    """Runs of neighbouring positions with one anchor minimum: bytes of the chunk, and of
    each run its minimum, document, place in the document, place in the chunk, positions."""
    keep = [(d, t) for d, t in chunk if len(t) >= length]
    data = np.frombuffer(b"".join(t for _, t in keep), np.uint8)
    sizes = np.array([len(t) for _, t in keep], np.int64)
    begin = np.cumsum(sizes) - sizes
    if not len(data):
        return data, None
    low = window_minima(data, length, anchor)
    valid = np.ones(len(low), bool)
    tails = ranges(begin + sizes - length + 1, np.full(len(sizes), length - 1))
    valid[tails[tails < len(low)]] = False
    head = np.r_[True, low[1:] != low[:-1]]
    head[begin] = True
    at = np.flatnonzero(head & valid)
    stops = np.flatnonzero(np.r_[head | ~valid, True])
    count = stops[np.searchsorted(stops, at, side="right")] - at
    which = np.searchsorted(begin, at, side="right") - 1
    docs = np.array([d for d, _ in keep], np.int64)[which]
    return data, (low[at], docs, at - begin[which], at, count)


def _pieces(b: pa.RecordBatch, length: int) -> Iterator[tuple[int, int, bytes]]:
    for d, t in zip(b.column(0).to_pylist(), utf8(b.column(1))):
        for at in range(0, max(len(t) - length + 1, 0), PIECE):
            yield d, at, t[at:at + PIECE + length - 1]


def _chunks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    chunk, size = [], 0
    for b in slices(batches, 1, CHUNK):
        for piece in _pieces(b, length):
            chunk.append(piece)
            size += len(piece[2])
            if size >= CHUNK:
                yield chunk
                chunk, size = [], 0
    if chunk:
        yield chunk


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether data[a:a+n] == data[b:b+n], for each pair of places."""
    if not len(a):
        return np.zeros(0, bool)
    equal = data[ranges(a, sizes)] == data[ranges(b, sizes)]
    return np.add.reduceat(~equal, np.cumsum(sizes) - sizes) == 0


def copies(data: np.ndarray, hashes: np.ndarray, docs: np.ndarray, at: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """Which runs repeat, byte for byte, a run of a smaller document (``hashes``: of the prefix at each place)."""
    key = _mix(hashes[at] ^ _mix(hashes[at + count - 1] + count.astype(np.uint64)))
    order = np.argsort(key)
    start, n = group_ends(key[order])
    shared = np.repeat(n > 1, n)
    order = order[shared]
    order = order[np.lexsort((docs[order], key[order]))]
    start, n = group_ends(key[order])
    first = np.repeat(order[start], n)
    later = (docs[order] > docs[first]) & (count[order] == count[first])
    mine, theirs = order[later], first[later]
    same = _same_bytes(data, at[mine], at[theirs], count[mine] + length - 1)
    out = np.zeros(len(at), bool)
    out[mine[same]] = True
    return out


def _pack(docs: np.ndarray, *arrays: np.ndarray) -> bytes:
    """Equally long int64 and int32 arrays as one compressed block."""
    raw = docs.astype("<i8").tobytes() + b"".join(a.astype("<i4").tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unpack(block: bytes, arrays: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n = len(raw) // (8 + 4 * arrays)
    return [np.frombuffer(raw, "<i8", n)] + [np.frombuffer(raw, "<i4", n, 8 * n + 4 * n * i) for i in range(arrays)]


SENT = "bucket int, marks boolean, runs array<binary>, bytes array<binary>"
SUB = 4          # a bucket is searched in so many parts, which bounds the memory of a task


SLOTS = 1 << 24          # runs are counted by their minimum modulo this
SLICE = 1 << 20          # positions of hot runs that are taken at once
BLOCK_CHARS = 1 << 16    # longer texts are sampled by blocks of so many characters


def _count_runs(length: int, anchor: int, share: int):
    """Runs by slot: of whole short texts, and of every block in ``share`` of the long ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pick = random.Random()
        for b in slices(batches, 1, CHUNK):
            chunk = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                blocks = range(0, len(t), BLOCK_CHARS)
                chunk += [(d, t[at:at + BLOCK_CHARS].encode()) for at in blocks if len(blocks) == 1 or not pick.randrange(share)]
            runs = runs_of(chunk, length, anchor)[1]
            if runs is not None:
                slot, n = np.unique((runs[0] % np.uint64(SLOTS)).astype(np.int32), return_counts=True)
                yield table({"slot": (slot, pa.int32()), "n": (n, pa.int64())})
    return run


def hot_slots(texts: DataFrame, length: int, anchor: int, hot: int, share: int) -> np.ndarray:
    """Slots (ascending) that hold at least ``hot`` runs and eight times the mean, judged by one text in ``share``."""
    some = texts.where("text is not null").where((F.length("text") > BLOCK_CHARS) | (F.rand() < 1 / share))
    counts = saved(some.mapInArrow(_count_runs(length, anchor, share), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")), "anchor_counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(hot, 8 * share * total / SLOTS)
    return np.sort(counts.where(F.col("n") * share >= F.lit(least)).select("slot").toArrow().column(0).to_numpy())


def hot_positions(data: np.ndarray, hashes: np.ndarray, docs: np.ndarray, at: np.ndarray, count: np.ndarray, rows: np.ndarray, length: int):
    """The positions of the runs ``rows``, in slices that keep equal prefixes together: run and place of
    each, and whether a smaller document of the chunk has its prefix."""
    places, owner = ranges(at[rows], count[rows]), np.repeat(rows, count[rows])
    n = 1 + len(places) // SLICE
    part = (_mix(hashes[places]) >> np.uint64(40)) % np.uint64(n)
    for i in range(n if len(places) else 0):
        here = np.flatnonzero(part == i)
        who, place = owner[here], places[here]
        chosen, found = _shared(hashes[place], docs, who), np.zeros(len(here), bool)
        if len(chosen):
            found[chosen] = longest_previous_factors(prefix_words(data, place[chosen], length), docs[who[chosen]], length) == length
        yield who, place, found


def _send(length: int, anchor: int, buckets: int, parts: int, slots: np.ndarray, shift: int = 0):
    """Map side: runs, and positions of hot ones (of ``slots``), to their buckets; marks of what repeats
    a smaller document of the chunk (marks = true) to the part of their doc_id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, length):
            ids, base = (np.array(x, np.int64) for x in zip(*((d, at) for d, at, _ in chunk)))
            data, runs = runs_of([(i, t) for i, (_, _, t) in enumerate(chunk)], length, anchor)
            if runs is None:
                continue
            low, piece, pos, at, count = runs
            docs, pos = ids[piece], pos + base[piece]
            hashes = prefix_hashes(data, length)
            copy = copies(data, hashes, docs >> shift, at, count, length)
            hot = ~copy & np.isin((low % np.uint64(SLOTS)).astype(np.int32), slots)
            text = data.tobytes()
            yield from sent(text, low, docs, pos, at, count, np.flatnonzero(copy), np.flatnonzero(~copy & ~hot))
            for who, place, found in hot_positions(data, hashes, docs >> shift, at, count, np.flatnonzero(hot), length):
                yield from sent(text, _mix(hashes[place]), docs[who], pos[who] + place - at[who], place, np.ones(len(place), np.int64),
                                np.flatnonzero(found), np.flatnonzero(~found))

    def sent(text, key, docs, pos, at, count, marked, rest) -> Iterator[pa.RecordBatch]:
        press, out = zstandard.ZstdCompressor(level=3), []
        for part, sel in _by(docs[marked] % parts, marked):
            out.append((part, True, [_pack(docs[sel], pos[sel], pos[sel] + count[sel] + length - 1)], None))
        ends = at + count + length - 1
        rows: dict[int, tuple[list[bytes], list[bytes]]] = {}
        for part, sel in _by((key[rest] % np.uint64(buckets * SUB)).astype(np.int64), rest):
            bytes_ = b"".join([text[s:e] for s, e in zip(at[sel].tolist(), ends[sel].tolist())])
            blocks = rows.setdefault(part // SUB, ([b""] * SUB, [b""] * SUB))
            blocks[0][part % SUB] = _pack(docs[sel], pos[sel], count[sel])
            blocks[1][part % SUB] = press.compress(bytes_)
        out += [(bucket, False, *blocks) for bucket, blocks in rows.items()]
        if out:
            bucket, marks, metas, blobs = zip(*out)
            yield table({"bucket": (bucket, pa.int32()), "marks": (marks, pa.bool_()),
                         "runs": (metas, pa.list_(pa.binary())), "bytes": (blobs, pa.list_(pa.binary()))})
    return run


def _by(keys: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    for s, n in zip(*group_ends(keys[order])):
        yield int(keys[order[s]]), rows[order[s:s + n]]


def prefix_words(data: np.ndarray, places: np.ndarray, length: int) -> list[np.ndarray]:
    """The ``length`` bytes from each place as big-endian words of up to eight bytes."""
    out = []
    for at in range(0, length, 8):
        word = np.zeros(len(places), np.uint64)
        for j in range(at, min(at + 8, length)):
            word = (word << np.uint64(8)) | data[places + j]
        out.append(word)
    return out


def common_prefixes(prefixes: list[np.ndarray], order: np.ndarray, length: int) -> np.ndarray:
    """Bytes that each suffix in ``order`` has in common with the one before it, ``length`` at most; the first has 0."""
    out, equal = np.zeros(len(order), np.int64), np.ones(max(len(order) - 1, 0), bool)
    for i, word in enumerate(prefixes):
        ranked = word[order]
        differ = ranked[1:] ^ ranked[:-1]
        size = min(8, length - 8 * i)
        same = np.full(len(differ), size)
        for j in range(size):            # bytes from the first on, until one differs
            same = np.where((differ >> np.uint64(8 * (size - 1 - j)) > 0) & (same == size), j, same)
        out[1:] += np.where(equal, same, 0)
        equal &= differ == 0
    return out


def factor_to_smaller(docs: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For suffixes in order: the common prefix with the nearest earlier suffix of a smaller document (0: none).
    ``common``: with the suffix before."""
    at, least = np.arange(len(docs)) - 1, common.copy()
    going = np.flatnonzero(at >= 0)
    while len(going):
        going = going[(least[going] > 0) & (docs[at[going]] >= docs[going])]
        next_at, next_least = at[at[going]], np.minimum(least[going], least[at[going]])
        at[going], least[going] = next_at, next_least
        ended = at[going] < 0
        least[going[ended]] = 0
        going = going[~ended]
    least[at < 0] = 0
    return least


def longest_previous_factors(prefixes: list[np.ndarray], docs: np.ndarray, length: int) -> np.ndarray:
    """For each suffix (by its prefix words) the longest prefix, ``length`` at most, that a suffix of a smaller document shares:
    the larger one of its common prefixes with the previous and with the next smaller document in suffix order."""
    order = np.lexsort((docs, *prefixes[::-1]))
    common, ranked = common_prefixes(prefixes, order, length), docs[order]
    before = factor_to_smaller(ranked, common)
    after = factor_to_smaller(ranked[::-1], np.r_[0, common[1:][::-1]] if len(common) else common)[::-1]
    out = np.zeros(len(order), np.int64)
    out[order] = np.maximum(before, after)
    return out


def repeated_in_bucket(docs: np.ndarray, pos: np.ndarray, count: np.ndarray, data: np.ndarray, length: int, shift: int = 0):
    """(doc, start, end) of the byte ranges of the bucket's runs that repeat a smaller document (``docs >> shift``)."""
    docs, pos, count = (x.astype(np.int64) for x in (docs, pos, count))
    sizes = count + length - 1
    begin = np.cumsum(sizes) - sizes
    hashes = prefix_hashes(data, length)
    copy = copies(data, hashes, docs >> shift, begin, count, length)
    rest = np.flatnonzero(~copy)
    places = ranges(begin[rest], count[rest])
    owner = np.repeat(rest, count[rest])
    chosen = _shared(hashes[places], docs >> shift, owner)
    found = np.zeros(len(places), bool)
    if len(chosen):
        found[chosen] = longest_previous_factors(prefix_words(data, places[chosen], length), docs[owner[chosen]] >> shift, length) == length
    hits = np.flatnonzero(found)
    new = np.r_[True, (hits[1:] != hits[:-1] + 1) | (owner[hits[1:]] != owner[hits[:-1]])] if len(hits) else np.zeros(0, bool)
    first, last = hits[new], hits[np.r_[new[1:], True]] if len(hits) else hits
    who, shift = owner[first], pos[owner[first]] - begin[owner[first]]
    return (np.concatenate([docs[copy], docs[who]]), np.concatenate([pos[copy], shift + places[first]]),
            np.concatenate([pos[copy] + sizes[copy], shift + places[last] + length]))


def _shared(h: np.ndarray, docs: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Indices (ascending) of the hashes that occur in more than one document."""
    left = np.arange(len(h))
    for mul in (STEP[30], STEP[31]):     # a cheap first sieve: hashes alone in their slot of a count table
        bits = max(int(4 * len(left)).bit_length(), 8)
        slot = ((h[left] * mul) >> np.uint64(64 - bits)).astype(np.int64)
        left = left[np.bincount(slot, minlength=1 << bits)[slot] > 1]
    order = left[np.argsort(h[left])]
    start, n = group_ends(h[order])
    if not len(start):
        return start
    by_hash = docs[owner[order]]
    mixed = np.minimum.reduceat(by_hash, start) < np.maximum.reduceat(by_hash, start)
    return np.sort(order[np.repeat(mixed, n)])


HELD = 1 << 20           # marks that a search task gathers before it sends them


def _search(length: int, parts: int, shift: int = 0):
    """Reduce side: rows of a bucket come together (sorted by bucket); marks of the map side go on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        open_ = zstandard.ZstdDecompressor()

        def flush() -> Iterator[pa.RecordBatch]:
            docs, start, end = (np.concatenate(x) for x in zip(*held))
            rows = list(_by(docs % parts, np.arange(len(docs))))
            held.clear()
            yield table({"part": ([p for p, _ in rows], pa.int32()),
                         "block": ([_pack(docs[s], start[s], end[s]) for _, s in rows], pa.binary())})

        def search(rows: list[tuple[list[bytes], list[bytes]]]) -> Iterator[pa.RecordBatch]:
            for i in range(SUB):
                blocks = [(runs[i], blob[i]) for runs, blob in rows if runs[i]]
                if not blocks:
                    continue
                docs, pos, count = (np.concatenate(x) for x in zip(*(_unpack(m, 2) for m, _ in blocks)))
                data = np.frombuffer(b"".join([open_.decompress(x) for _, x in blocks]), np.uint8)
                held.append(repeated_in_bucket(docs, pos, count, data, length, shift))
                if sum(len(x[0]) for x in held) > HELD:
                    yield from flush()

        bucket, rows = None, []
        for b in batches:
            for key, marks, runs, blob in zip(*(c.to_pylist() for c in b.columns)):
                if marks:
                    held.append(tuple(_unpack(runs[0], 2)))
                    continue
                if key != bucket:
                    yield from search(rows)
                    bucket, rows = key, []
                rows.append((runs, blob))
        yield from search(rows)
        if held:
            yield from flush()
    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a part come together, its marks before its documents."""
    part, marks, found = None, [], None
    open_ = zstandard.ZstdDecompressor()
    for whole in batches:
        out = []
        for key, doc, own, block in zip(*(c.to_pylist() for c in whole.columns)):
            if key != part:
                part, marks, found = key, [], None
            if doc is None:
                marks.append(block)
                continue
            if found is None:
                arrays = [_unpack(m, 2) for m in marks] or [[np.zeros(0, np.int64)] * 3]
                found = [np.concatenate(x) for x in zip(*arrays)]
                order = np.lexsort((found[1], found[0]))
                found, marks = [x[order] for x in found], []
            text = open_.decompress(block) if block else b""
            lo, hi = np.searchsorted(found[0], [doc, doc + 1])
            out.append((own, len(text), *cut_out(text, found[1][lo:hi].tolist(), found[2][lo:hi].tolist())))
        if out:
            cols = list(zip(*out))
            yield table({"doc_id": (cols[0], pa.int64()), "n_bytes": (cols[1], pa.int64()), "n_removed": (cols[2], pa.int64()),
                         "n_spans": (cols[3], pa.int64()), "spans": (cols[4], pa.list_(pa.int32())), "kept": (cols[5], pa.binary())})


def cut_out(text: bytes, starts: list[int], ends: list[int]) -> tuple[int, int, list[int], bytes]:
    """Bytes removed, maximal removed runs, their starts and ends in turn, bytes that stay."""
    spans: list[int] = []
    for s, e in zip(starts, ends):
        e = min(e, len(text))
        if s >= e:
            continue
        if spans and s <= spans[-1]:
            spans[-1] = max(spans[-1], e)
        else:
            spans += [s, e]
    edges = [0, *spans, len(text)]
    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
    return len(text) - len(kept), len(spans) // 2, spans, kept


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for b in slices(batches, 3, 16 << 20):
        yield table({"part": (b.column(0), pa.int32()), "key": (b.column(1), pa.int64()), "doc_id": (b.column(2), pa.int64()),
                     "block": ([press.compress(t) if t else b"" for t in utf8(b.column(3))], pa.binary())})


BUCKET_BYTES, PART_BYTES = 128 << 20, 64 << 20      # sent to a bucket (of SUB parts), texts of a part


def keyed(texts: DataFrame, repeats: int) -> tuple[DataFrame, int]:
    """(key, doc_id, text) and a shift: ``key`` is unique and ``key >> shift`` stands for the doc_id in its order.
    Without repeated doc_ids the key is the doc_id; otherwise rows are numbered (rows times ``repeats`` must stay below 2^62)."""
    if repeats < 2:
        return texts.select(F.col("doc_id").alias("key"), "doc_id", "text"), 0
    shift = (repeats - 1).bit_length()
    rows = texts.select(F.lit("").alias("grp"), "doc_id", "text", F.monotonically_increasing_id().alias("row"))
    rows = saved(positions(rows, ["doc_id"]).select("pos", "doc_id", "text"), "numbered")
    first = rows.groupBy(F.col("doc_id").alias("id")).agg(F.min("pos").alias("first"))
    key = F.shiftleft("first", shift) + F.col("pos") - F.col("first")
    return saved(rows.join(first, F.col("doc_id") == F.col("id")).select(key.alias("key"), "doc_id", "text"), "keyed"), shift


def lpf_dedup(docs: DataFrame, length: int = 50, anchor: int = 12, hot: int = 1 << 16, share: int = 64) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, spans (starts and ends of the
    removed runs in turn), kept (the remaining bytes)."""
    spark = docs.sparkSession
    texts = keyed_texts(docs)
    size, repeats = texts.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")) \
        .agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    texts, shift = keyed(texts, repeats)
    p = shuffle_partitions(spark)
    buckets, parts = max(4 * p, 4 * size // BUCKET_BYTES), max(p, size // PART_BYTES)       # about 3.4 bytes are sent for one of text
    tasks = max(p, buckets // 4)
    sent_texts = texts.select(F.col("key").alias("doc_id"), "text")
    slots = hot_slots(sent_texts, length, anchor, hot, share)
    sent = sent_texts.mapInArrow(_send(length, anchor, buckets, parts, slots, shift), SENT)
    marks = sent.repartition(tasks, "bucket").sortWithinPartitions("bucket") \
        .mapInArrow(_search(length, parts, shift), "part int, block binary")
    blocks = texts.select(F.pmod("key", F.lit(parts)).cast("int").alias("part"), "key", "doc_id", "text") \
        .mapInArrow(_compressed, "part int, key long, doc_id long, block binary")
    none = F.lit(None).cast("long")
    meeting = marks.select("part", none.alias("key"), none.alias("doc_id"), "block").unionByName(blocks)
    return meeting.repartition(parts, "part").sortWithinPartitions("part", F.col("key").asc_nulls_first()) \
        .mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<int>, kept binary")


def digest_rows(cut: DataFrame) -> DataFrame:
    """The kept bytes as their SHA-256 only."""
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


