"""Language-model scoring by Katz backoff of word pairs.

P(w | v) = d(c) c(v w) / c(v) where the pair was seen in training, else alpha(v) P(w);
P(w) = d(c) c(w) / N where the word was seen, else the mass that Good-Turing takes from seen words.
d(c) is Katz's discount from the counts of counts (1 above ``K_LARGE``); where the counts of counts give no
discount in (0, 1], it is 1, and a context none of whose words is discounted divides by one more
than its count, so every context keeps mass for unseen words.  alpha(v) is exact:
what the seen words of v leave, over what they leave of the unigrams.  All words of a
context, the unknown word included, sum to 1.

The counts are never gathered anywhere; they stay in three partitioned tables, and texts are scored by
requests to them:

1. *Slices.*  Texts are cut into slices of about ``SLICE`` bytes (a longer text is one of its own), stored as
   numbers into the slice's own list of words.
2. *Words.*  Each slice sends its words with their training counts to buckets by a hash of the word;
   a bucket sums and sorts them by count.  Words are numbered by descending count over all buckets,
   so a word's number tells its count through the histogram of counts.  Distinct counts add up to at most N, so
   the histogram has at most sqrt(2 N) rows: it is the only thing that is broadcast.
3. *Pairs.*  Each slice sends its distinct pairs of known words; a bucket sums them and answers with the
   counts.  A pair's bucket is a hash of its first word, for words above ``hot`` occurrences of both, so a
   word that a third of all pairs begin with is spread evenly.
4. *Contexts.*  Pair buckets send sums by first word to context buckets, which compute alpha and answer the slices.
5. Each slice looks its tokens up in its answers and adds the logarithms by document.

Requests and answers are packed numbers (sorted, byte planes, zstd) of one (slice, bucket); all groups are bounded by a
slice or a bucket, and buckets grow in number with the tokens.

Defined cases: a null or empty text has the end token only; rows without doc_id take no part;
rows that repeat a doc_id are scored one by one; without training rows every token is unknown with
probability 1; an empty table gives an empty result; further columns are ignored.  Logarithms are added in
extended precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from parcelwise.llm.common import keyed_texts, mixed, saved, shuffle_partitions, slices, table, word_hash

END = "\n"                  # no word holds white space
K_LARGE = 5                 # counts above it are not discounted
SLICE = 8 << 20             # bytes of text
WORDS_A_BUCKET, PAIRS_A_BUCKET = 1 << 21, 1 << 21      # tokens for each bucket


# --- packed numbers ---

def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit numbers as one compressed value, byte plane by byte plane."""
    parts = [np.array([len(a) for a in arrays], "<i8").tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a, "<f8" if a.dtype.kind == "f" else "<i8")
        parts.append(a.view(np.uint8).reshape(-1, 8).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes, kinds: str) -> list[np.ndarray]:
    """The arrays of ``pack``; ``kinds``: i or f for each."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes, at, out = np.frombuffer(raw, "<i8", len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds):
        planes = np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n)
        out.append(np.ascontiguousarray(planes.T).view("<f8" if kind == "f" else "<i8").reshape(n))
        at += 8 * n
    return out


# --- the model's numbers ---

def discounts(n: dict[int, int], k: int = K_LARGE) -> np.ndarray:
    """Katz's Good-Turing discounts of the counts 0 to k + 1 (the last: all larger ones) from counts of counts."""
    d = np.ones(k + 2)
    first = n.get(1, 0)
    rest = (k + 1) * n.get(k + 1, 0) / first if first else 1.0
    if rest < 1:
        for r in range(1, k + 1):
            if n.get(r, 0):
                x = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - rest) / (1 - rest)
                if 0 < x <= 1:
                    d[r] = x
    return d


def discounted(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    return d[np.minimum(c, len(d) - 1)] * c


@dataclass
class Words:
    """Unigrams by number: 0 is any unknown word, 1, 2, ... the words by descending count, ``start`` the context before a text."""

    counts: np.ndarray        # distinct counts, descending
    firsts: np.ndarray        # number of the first word with that count
    size: int                 # distinct words
    total: int                # training tokens
    texts: int                # training documents
    d: np.ndarray

    @classmethod
    def of(cls, histogram: dict[int, int], texts: int) -> Words:
        c = np.array(sorted(histogram, reverse=True), np.int64)
        n = np.array([histogram[x] for x in c.tolist()], np.int64)
        return cls(c, 1 + np.cumsum(n) - n, int(n.sum()), int((c * n).sum()), texts, discounts(histogram))

    @property
    def start(self) -> int:
        return self.size + 1

    def count(self, ids: np.ndarray) -> np.ndarray:
        """Training occurrences: as a context for ``start``."""
        if not len(self.counts):
            return np.zeros(len(ids), np.int64)
        c = self.counts[np.searchsorted(self.firsts, np.maximum(ids, 1), side="right") - 1]
        return np.where(ids == 0, 0, np.where(ids == self.start, self.texts, c))

    def masses(self) -> tuple[float, float]:
        """(denominator of the unigrams, probability of an unknown word)."""
        n = np.diff(np.r_[self.firsts, self.size + 1])
        kept = float((discounted(self.d, self.counts) * n).sum())
        den = self.total if kept < self.total else self.total + 1
        return float(den), (den - kept) / den

    def probability(self, ids: np.ndarray) -> np.ndarray:
        den, unknown = self.masses()
        return np.where(ids == 0, unknown, discounted(self.d, self.count(ids)) / den)


def context(total: np.ndarray, kept: np.ndarray, seen: np.ndarray, unknown: float) -> tuple[np.ndarray, np.ndarray]:
    """(denominator, alpha) of contexts with ``total`` occurrences, ``kept`` discounted counts and
    unigram mass ``seen`` of the words that were seen after them."""
    den = np.where(kept < total, total, total + 1).astype(np.float64)
    return den, (den - kept) / den / np.maximum(1 - seen, unknown)


# --- slices ---

SLICES = "docs binary, held binary, sizes binary, tokens binary, words array<string>, n binary"


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(tokens of each text with its end, numbers of all tokens one after another, words) of a string column."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    words = lists.flatten()
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    parent = pc.list_parent_indices(lists).to_numpy()[full]
    numbers = words.filter(pa.array(full)).dictionary_encode()
    sizes = np.bincount(parent, minlength=len(column)) + 1
    out = np.full(int(sizes.sum()), len(numbers.dictionary), np.int64)
    out[np.arange(len(parent)) + parent] = numbers.indices.to_numpy()
    return sizes, out, pa.concat_arrays([numbers.dictionary, pa.array([END], numbers.dictionary.type)])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in gathered(slices(batches, 1, SLICE)):
        held = b.column("held").to_numpy(zero_copy_only=False).astype(np.int64)
        sizes, tokens, words = tokens_of(b.column("text"))
        by_count = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")     # small numbers for frequent words
        place = np.empty(len(words), np.int64)
        place[by_count] = np.arange(len(words))
        tokens = place[tokens]
        n = np.bincount(tokens[np.repeat(held == 0, sizes)], minlength=len(words))
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([pack(x)], pa.binary()) for x in (b.column("doc_id").to_numpy(), held, sizes, tokens)),
             lists_of([words.take(pa.array(by_count))]), pa.array([pack(n)], pa.binary())], names=["docs", "held", "sizes", "tokens", "words", "n"])


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join small batches until they hold about a slice."""
    waiting, size = [], 0
    for b in batches:
        if waiting and size + b.nbytes > SLICE:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting, size = [], 0
        waiting.append(b)
        size += b.nbytes
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def lists_of(arrays: list[pa.Array]) -> pa.ListArray:
    """One list of words a row."""
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(arrays).cast(pa.string()) if arrays else pa.array([], pa.string()))


def list_at(column: pa.ListArray, i: int) -> pa.Array:
    start, end = column.offsets[i].as_py(), column.offsets[i + 1].as_py()
    return column.values.slice(start, end - start)


# --- requests to buckets ---

ROWS = "bucket long, slice long, kind int, data binary, words array<string>"


def batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (bucket, slice, kind, data) or (bucket, slice, kind, data, words)."""
    bucket, slice_, kind, data = ([r[i] for r in rows] for i in range(4))
    words = lists_of([r[4] for r in rows]) if rows and len(rows[0]) > 4 else pa.nulls(len(rows), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(slice_, pa.int64()), pa.array(kind, pa.int32()),
                                       pa.array(data, pa.binary()), words], names=["bucket", "slice", "kind", "data", "words"])


def in_buckets(requests: DataFrame, buckets: int, run) -> DataFrame:
    """``run(bucket, slices, kinds, data, words)`` for each bucket, its rows in order of kind and slice; batches that it yields."""
    def call(bucket: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        words = [list_at(c, i) for c in t["words"].chunks if c.null_count == 0 for i in range(len(c))]
        return run(bucket, t["slice"].to_pylist(), t["kind"].to_pylist(), t["data"].to_pylist(), words)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts = None, []
        for b in batches:
            keys = b.column("bucket").to_numpy()
            edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
            for start, end in zip(edges, np.r_[edges[1:], len(keys)] if len(keys) else []):
                if parts and keys[start] != bucket:
                    yield from call(bucket, parts)
                    parts = []
                bucket = int(keys[start])
                parts.append(b.slice(start, end - start))
        if parts:
            yield from call(bucket, parts)
    return requests.repartition(buckets, "bucket") \
        .sortWithinPartitions("bucket", "kind", "slice").mapInArrow(task, ROWS)


def by_slice(answers: DataFrame, name: str) -> DataFrame:
    """All answers of a slice, in order of bucket."""
    return answers.groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("bucket", "data"))).alias(name))


def dealt(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places) of an array of buckets."""
    order = np.argsort(keys, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(keys[order]) != 0]) if len(keys) else np.zeros(0, np.int64)
    for a, b in zip(edges, np.r_[edges[1:], len(keys)]):
        yield int(keys[order[a]]), order[a:b]


def answered(keys: np.ndarray, answers: list[dict] | None, kinds: str) -> list[np.ndarray]:
    """The answers to a slice's requests in the order of its own keys."""
    given = {a["bucket"]: a["data"] for a in answers or []}
    out = [np.zeros(len(keys), np.float64 if k == "f" else np.int64) for k in kinds]
    for bucket, at in dealt(keys):
        for o, values in zip(out, unpack(given[bucket], kinds)):
            o[at] = values
    return out


# --- words ---

def _ask_words(buckets: int):
    def run(batches):
        for b in batches:
            for i, (s, n) in enumerate(zip(*(b.column(c).to_pylist() for c in ("slice", "n")))):
                words, (n,) = list_at(b.column("words"), i), unpack(n, "i")
                yield batch([(bucket, s, 0, pack(n[at]), words.take(pa.array(at))) for bucket, at in dealt(word_hash(words) % buckets)])
    return run


def _count_words(bucket, slices_, kinds, data, words):
    """Kind 1: the bucket's words by descending count; kind 2: for each slice the places of its words, -1 if never in training."""
    coded = pa.concat_arrays(words).dictionary_encode()
    at = coded.indices.to_numpy()
    counts = np.bincount(at, weights=np.concatenate([unpack(x, "i")[0] for x in data]), minlength=len(coded.dictionary)).astype(np.int64)
    order = np.argsort(-counts, kind="stable")[:int((counts > 0).sum())]
    place = np.full(len(counts), -1, np.int64)
    place[order] = np.arange(len(order))
    yield batch([(bucket, None, 1, pack(counts[order]), coded.dictionary.take(pa.array(order)))])
    ends = np.cumsum([len(w) for w in words])
    yield batch([(bucket, s, 2, pack(x)) for s, x in zip(slices_, np.split(place[at], ends[:-1]))])


def _count_runs(batches):
    """(bucket, count, words) of the buckets' word lists."""
    for b in batches:
        out = []
        for bucket, data in zip(*(b.column(c).to_pylist() for c in ("bucket", "data"))):
            c, n = np.unique(unpack(data, "i")[0], return_counts=True)
            out += [(bucket, x, y) for x, y in zip(c.tolist(), n.tolist())]
        bucket, c, n = zip(*out) if out else ([],) * 3
        yield table({"bucket": (bucket, pa.int64()), "c": (c, pa.int64()), "n": (n, pa.int64())})


def _number_words(shared):
    """Kind 2 rows with the runs of their bucket to (slice, bucket, numbers of the words)."""
    def run(batches):
        words = shared.value
        for b in batches:
            out = []
            for s, bucket, data, runs in zip(*(b.column(c).to_pylist() for c in ("slice", "bucket", "data", "runs"))):
                (at,) = unpack(data, "i")
                runs = sorted(runs or [], key=lambda r: -r["c"])
                n = np.array([r["n"] for r in runs], np.int64)
                ends = np.cumsum(n)
                # the number of a run's first word, less its place in the bucket
                first = np.array([words.firsts[np.searchsorted(-words.counts, -r["c"])] + r["ahead"] for r in runs], np.int64) - (ends - n)
                ids = np.zeros(len(at), np.int64)
                known = at >= 0
                if known.any():
                    ids[known] = first[np.searchsorted(ends, at[known], side="right")] + at[known]
                out.append((s, bucket, pack(ids)))
            s, bucket, data = zip(*out) if out else ([],) * 3
            yield table({"slice": (s, pa.int64()), "bucket": (bucket, pa.int64()), "data": (data, pa.binary())})
    return run


NUMBERED = "slice long, docs binary, held binary, sizes binary, tokens binary, ids binary"


def _place_words(buckets: int):
    """A slice with the answers to its words to one with their numbers in its own order."""
    def run(batches):
        for b in batches:
            ids = [pack(answered(word_hash(list_at(b.column("words"), i)) % buckets, given, "i")[0])
                   for i, given in enumerate(b.column("word_ids").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("slice", "docs", "held", "sizes", "tokens")), pa.array(ids, pa.binary())],
                                             names=["slice", "docs", "held", "sizes", "tokens", "ids"])
    return run


# --- pairs and contexts ---

def pair_bucket(first: np.ndarray, second: np.ndarray, counts: np.ndarray, hot: int, buckets: int) -> np.ndarray:
    """By the first word alone unless it has more than ``hot`` occurrences."""
    h = mixed(first)
    return np.where(counts > hot, mixed(h ^ second), h) % buckets


@dataclass
class Slice:
    """A slice with the numbers of its words."""

    docs: np.ndarray
    held: np.ndarray
    sizes: np.ndarray
    first: np.ndarray         # of each token the word before it, and the word itself, as places in ``ids``
    second: np.ndarray
    ids: np.ndarray           # numbers of the slice's words; the last is the start

    @classmethod
    def of(cls, r: dict, words: Words) -> Slice:
        docs, held, sizes, tokens, ids = (unpack(r[c], "i")[0] for c in ("docs", "held", "sizes", "tokens", "ids"))
        first = np.r_[np.int64(0), tokens[:-1]]
        first[np.cumsum(sizes) - sizes] = len(ids)
        return cls(docs, held, sizes, first, tokens, np.r_[ids, words.start])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the first and second words of the distinct pairs, the pair of each token, and which pairs are of known words."""
        wide = len(self.ids)
        distinct, which = np.unique(self.first * wide + self.second, return_inverse=True)
        a, b = distinct // wide, distinct % wide
        return a, b, which, np.flatnonzero((self.ids[a] > 0) & (self.ids[b] > 0))

    def known(self) -> np.ndarray:
        """Places of the words that can be contexts."""
        return np.flatnonzero(self.ids > 0)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _ask_pairs(shared, buckets: int, hot: int):
    """Kind 0: distinct pairs of known words with their training counts."""
    def run(batches):
        words = shared.value
        for r in rows_of(batches):
            s = Slice.of(r, words)
            a, b, which, known = s.pairs()
            n = np.bincount(which[np.repeat(s.held == 0, s.sizes)], minlength=len(a))[known]
            a, b = s.ids[a[known]], s.ids[b[known]]
            yield batch([(bucket, r["slice"], 0, pack(a[at], b[at], n[at]))
                         for bucket, at in dealt(pair_bucket(a, b, words.count(a), hot, buckets))])
    return run


def _count_pairs(bucket, slices_, kinds, data, _):
    """Kind 1: the bucket's pairs with their counts, in order; kind 2: for each slice the counts of its pairs."""
    asked = [unpack(x, "iii") for x in data]
    a, b, n = (np.concatenate(x) for x in zip(*asked))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    which = np.cumsum(new) - 1
    c = np.bincount(which, weights=n[order]).astype(np.int64)
    seen = np.flatnonzero(new)[c > 0]
    yield batch([(bucket, None, 1, pack(np.diff(a[seen], prepend=0), b[seen], c[c > 0]))])
    answers = np.empty(len(a), np.int64)
    answers[order] = c[which]
    yield batch([(bucket, s, 2, pack(x)) for s, x in zip(slices_, np.split(answers, np.cumsum([len(x) for x, _, _ in asked])[:-1]))])


def _count_counts(batches):
    """(c, n): pairs with counts 1 to K_LARGE + 1."""
    n = np.zeros(K_LARGE + 2, np.int64)
    for b in batches:
        for data in b.column("data").to_pylist():
            c = unpack(data, "iii")[2]
            n += np.bincount(c[c <= K_LARGE + 1], minlength=K_LARGE + 2)
    yield table({"c": (range(K_LARGE + 2), pa.int64()), "n": (n, pa.int64())})


def _sum_contexts(shared, d: np.ndarray, buckets: int):
    """Kind 1 rows of pairs to kind 0 rows of context buckets: first words, discounted counts, unigram mass of the seconds."""
    def run(batches):
        words = shared.value
        for b in batches:
            out = []
            for source, data in zip(*(b.column(c).to_pylist() for c in ("bucket", "data"))):
                a, w, c = unpack(data, "iii")
                if not len(a):
                    continue
                a = np.cumsum(a)
                starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
                kept, seen = np.add.reduceat(discounted(d, c), starts), np.add.reduceat(words.probability(w), starts)
                a = a[starts]
                out += [(bucket, source, 0, pack(np.diff(a[at], prepend=0), kept[at], seen[at])) for bucket, at in dealt(mixed(a) % buckets)]
            yield batch(out)
    return run


def _ask_contexts(shared, buckets: int):
    """Kind 1: the known words of a slice."""
    def run(batches):
        words = shared.value
        for b in batches:
            for s, ids in zip(*(b.column(c).to_pylist() for c in ("slice", "ids"))):
                a = np.r_[unpack(ids, "i")[0], words.start]
                a = a[a > 0]
                yield batch([(bucket, s, 1, pack(a[at])) for bucket, at in dealt(mixed(a) % buckets)])
    return run


def _answer_contexts(shared):
    """Kind 2: denominators and alphas of the slices' words (0 and 1: never seen before another word)."""
    def run(bucket, slices_, kinds, data, _):
        words = shared.value
        sums = [unpack(x, "iff") for x, kind in zip(data, kinds) if kind == 0]
        a, kept, seen = (np.concatenate(x) for x in zip(*[(np.cumsum(x), y, z) for x, y, z in sums])) if sums else (np.zeros(0, np.int64),) * 3
        order = np.argsort(a, kind="stable")
        a = a[order]
        if len(a):
            starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            kept, seen, a = np.add.reduceat(kept[order], starts), np.add.reduceat(seen[order], starts), a[starts]
        den, alpha = context(words.count(a), kept, seen, words.masses()[1])
        den, alpha, a = np.r_[den, 0.0], np.r_[alpha, 1.0], np.r_[a, np.int64(1 << 62)]
        out = []
        for s, x in ((s, unpack(x, "i")[0]) for s, x, kind in zip(slices_, data, kinds) if kind == 1):
            at = np.searchsorted(a, x)
            at[a[at] != x] = len(a) - 1
            out.append((bucket, s, 2, pack(den[at], alpha[at])))
        yield batch(out)
    return run


# --- scores ---

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _sums(logs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.add.reduceat(logs.astype(np.longdouble), np.cumsum(sizes) - sizes).astype(np.float64)


def _score(shared, d: np.ndarray, buckets: int, context_buckets: int, hot: int):
    def run(batches):
        words = shared.value
        for r in rows_of(batches):
            s = Slice.of(r, words)
            a, b, which, known = s.pairs()
            first, second = s.ids[a[known]], s.ids[b[known]]
            c = np.zeros(len(a), np.int64)
            c[known] = answered(pair_bucket(first, second, words.count(first), hot, buckets), r["pair_counts"], "i")[0]
            at = s.known()
            den, alpha = np.zeros(len(s.ids)), np.ones(len(s.ids))
            den[at], alpha[at] = answered(mixed(s.ids[at]) % context_buckets, r["contexts"], "ff")
            # the pair where it was seen, else back off to the word, else to the unknown word
            p = np.where(c > 0, discounted(d, c) / np.maximum(den[a], 1), alpha[a] * words.probability(s.ids)[b])
            base = (words.count(s.ids[:-1]) + 0.1) / (words.total + 0.1 * (words.size + 1))
            n_known = np.add.reduceat((s.ids > 0)[s.second].astype(np.int64), np.cumsum(s.sizes) - s.sizes)
            yield table({"doc_id": (s.docs, pa.int64()), "held_out": (s.held == 1, pa.bool_()), "n_tokens": (s.sizes, pa.int64()),
                         "n_known": (n_known, pa.int64()), "train_tokens": (np.full(len(s.docs), words.total), pa.int64()),
                         "base_score": (_sums(np.log10(base)[s.second], s.sizes), pa.float64()),
                         "score": (_sums(np.log10(p)[which], s.sizes), pa.float64())})
    return run


def held_out(key: Column) -> Column:
    """Documents that are not learned from: crc32 of the id as text, modulo 10, is 0."""
    return F.crc32(key.cast("string").cast("binary")) % 10 == 0


@dataclass
class Model:
    """The partitioned tables: words and pairs with their counts by bucket, and sums by context."""

    words: DataFrame          # bucket, data (counts), words
    pairs: DataFrame          # bucket, data (first words, second words, counts)
    contexts: DataFrame       # bucket, data (first words, discounted counts, unigram mass)
    unigrams: Words
    d: np.ndarray


def score(docs: DataFrame, held: Column | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return train_and_score(docs, held, key, text)[1]


def train_and_score(docs: DataFrame, held: Column | None = None, key: str = "doc_id", text: str = "text") -> tuple[Model, DataFrame]:
    """The model of the documents where ``held`` (a Column over the key) does not hold, and the scores of all."""
    spark = docs.sparkSession
    held = held_out(F.col(key)) if held is None else held
    rows = keyed_texts(docs, key, text).select(F.col(key).alias("doc_id"), F.col(text).alias("text"), held.alias("held"))
    cut = saved(rows.mapInArrow(_cut, SLICES).withColumn("slice", F.monotonically_increasing_id()), "slices", compression="none")
    sizes = cut.select("n", "sizes", "held").mapInArrow(_totals, "tokens long, texts long").agg(F.sum("tokens"), F.sum("texts")).first()
    tokens, texts = sizes[0] or 0, sizes[1] or 0
    p = shuffle_partitions(spark)
    word_buckets, buckets = max(p, tokens // WORDS_A_BUCKET), max(p, tokens // PAIRS_A_BUCKET)
    hot = max(1, tokens // (4 * buckets))

    counted = saved(in_buckets(cut.select("slice", "words", "n").mapInArrow(_ask_words(word_buckets), ROWS), word_buckets, _count_words), "words")
    vocabulary = counted.where("kind = 1")
    runs = saved(vocabulary.select("bucket", "data").mapInArrow(_count_runs, "bucket long, c long, n long"), "runs")
    histogram = {r["c"]: r["n"] for r in runs.groupBy("c").agg(F.sum("n").alias("n")).collect()}      # at most sqrt(2 N) rows
    shared = spark.sparkContext.broadcast(Words.of(histogram, texts))
    before = Window.partitionBy("c").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)         # one row a bucket
    runs = runs.select("bucket", "c", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")) \
        .groupBy("bucket").agg(F.collect_list(F.struct("c", "n", "ahead")).alias("runs"))
    ids = counted.where("kind = 2").select("slice", "bucket", "data").join(runs, "bucket", "left") \
        .mapInArrow(_number_words(shared), "slice long, bucket long, data binary")
    numbered = cut.drop("n").join(by_slice(ids, "word_ids"), "slice", "left").mapInArrow(_place_words(word_buckets), NUMBERED)
    numbered = saved(numbered, "numbered", compression="none")

    asked = numbered.mapInArrow(_ask_pairs(shared, buckets, hot), ROWS)
    pairs = saved(in_buckets(asked, buckets, _count_pairs), "pairs", compression="none")
    listed = pairs.where("kind = 1")
    n = {r["c"]: r["n"] for r in listed.select("data").mapInArrow(_count_counts, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()}
    d = discounts(n)
    context_buckets = word_buckets
    sums = saved(listed.select("bucket", "data").mapInArrow(_sum_contexts(shared, d, context_buckets), ROWS), "contexts")
    asked = numbered.select("slice", "ids").mapInArrow(_ask_contexts(shared, context_buckets), ROWS)
    contexts = in_buckets(sums.unionByName(asked), context_buckets, _answer_contexts(shared))
    scored = numbered.join(by_slice(pairs.where("kind = 2"), "pair_counts"), "slice", "left") \
        .join(by_slice(contexts, "contexts"), "slice", "left") \
        .mapInArrow(_score(shared, d, buckets, context_buckets, hot), SCORES)
    return Model(vocabulary, listed, sums, shared.value, d), scored


def _totals(batches):
    tokens = texts = 0
    for b in batches:
        tokens += sum(int(unpack(x, "i")[0].sum()) for x in b.column("sizes").to_pylist())
        texts += sum(int((unpack(x, "i")[0] == 0).sum()) for x in b.column("held").to_pylist())
    yield table({"tokens": ([tokens], pa.int64()), "texts": ([texts], pa.int64())})
