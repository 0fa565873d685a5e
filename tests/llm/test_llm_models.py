"""Merkle manifest, Katz backoff scores and hard negatives against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwise.llm import hard_negatives as N
from parcelwise.llm import katz as K
from parcelwise.llm import merkle as M
from parcelwise.llm import queries

from conftest import SMALL
from llm.conftest import docs_of


# --- Merkle manifest ---

def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i:i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 3 * 3:i // 3 * 3 + 3]
        out.append(("".join(run[:i % 3]), "".join(run[i % 3 + 1:])))
        i //= 3
    return out


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by = defaultdict(list)
    for d in rows:
        text = d[4]
        if d[0] is not None and text is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0:
            text = text.replace("\n", "")
        by[d[1]].append((d[0] is not None, d[0] or 0, leaf(d), leaf((*d[:4], text)), d[0]))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s])]) for s in names}
    top = tree([trees[s][-1][0] for s in names]) if names else []
    out = []
    for j, s in enumerate(names):
        for i, (_, _, own, altered, doc) in enumerate(sorted(by[s])):
            path = siblings(trees[s], i) + siblings(top, j)
            node = altered
            for a, b in path:
                node = H(a + node + b)
            out.append((doc, own, trees[s][-1][0], top[-1][0], H("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return sorted(out, key=str)


def manifest(docs):
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    out = M.manifest(docs, {"text": text}).drop("path")
    return sorted((tuple(r) for r in out.collect()), key=str)


FULL = "doc_id long, source string, lang string, n_chars long, text string, node string, pos int"


def full(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], FULL).repartition(parts)


def test_manifest_odd_rows(spark):
    rows = [(1, "b", "en", 3, "a\nb"), (2, "b", None, None, None), (3, "b", "", 0, ""), (None, "b", "en", 1, "no\nid"), (None, None, None, None, None),
            (7, "é", "fr", 1, "é\n"), (7, "é", "fr", 1, "other"), (7, "é", "fr", 1, "é\n"), (9, "", "en", 1, "x" * 100_000 + "\n"),
            (4, "z", "en", 1, "\n\n"), (5, "z", "en", 1, "-"), (6, "z", "en", 1, "1:-"), (8, "z", "en", 1, "ü")]
    assert manifest(full(spark, rows)) == brute_manifest(rows)


def test_manifest_many_rounds(spark, monkeypatch):
    """Blocks of three leaves: the recursion over block roots goes several rounds, sources of one block and of many mix."""
    monkeypatch.setattr(M, "DEPTH", 1)
    monkeypatch.setattr(M, "BLOCK", 3)
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", "en", i, f"text {i}\n" if i % 2 else f"text {i}") for i in range(150)]
    assert manifest(full(spark, rows)) == brute_manifest(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 243, 244, 730])
def test_manifest_sizes(spark, n):
    rows = [(i, "one", "en", 1, f"t{i}\n") for i in range(n)]
    assert manifest(full(spark, rows)) == brute_manifest(rows)


def test_manifest_empty(spark):
    assert M.manifest(full(spark, [])).collect() == []


# --- Katz backoff ---

def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\n"]


def brute_discounts(counts):
    n, out = Counter(counts.values()), {}
    rest = 6 * n[6] / n[1] if n[1] else 1
    for r in range(1, 6):
        if rest < 1 and n[r]:
            x = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest)
            if 0 < x <= 1:
                out[r] = x
    return lambda c: out.get(c, 1.0) * c


def brute_model(docs):
    """(unigrams, probability of a word after a word or None) of training token lists."""
    one = Counter(w for d in docs for w in d)
    two = Counter(x for d in docs for x in zip([None, *d], d))
    total, kept1, kept2 = sum(one.values()), brute_discounts(one), brute_discounts(two)
    kept = math.fsum(map(kept1, one.values()))
    den = total if kept < total else total + 1
    after = defaultdict(list)
    for (v, w), c in two.items():
        after[v].append((w, c))

    def p1(w):
        return kept1(one[w]) / den if w in one else (den - kept) / den

    context = {}
    for v, seen in after.items():
        n, k = sum(c for _, c in seen), math.fsum(kept2(c) for _, c in seen)
        d = n if k < n else n + 1
        context[v] = d, (d - k) / d / (1 - math.fsum(p1(w) for w, _ in seen))

    def p2(v, w):
        return kept2(two[v, w]) / context[v][0] if (v, w) in two else (context[v][1] if v in context else 1) * p1(w)

    return one, p1, p2


def brute_scores(rows, held):
    docs = [words(t) for _, t in rows]
    one, _, p2 = brute_model([d for d, h in zip(docs, held) if not h])
    total = sum(one.values())
    return sorted((i, h, len(d), sum(w in one for w in d), total, sum(math.log10((one[w] + 0.1) / (total + 0.1 * (len(one) + 1))) for w in d),
                   sum(math.log10(p2(v, w)) for v, w in zip([None, *d], d))) for (i, _), d, h in zip(rows, docs, held))


def close(got, want):
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def is_held(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


def test_katz_odd_rows(odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect() if r["doc_id"] is not None]
    close(sorted(map(tuple, K.score(odd_docs).collect())), brute_scores(rows, [is_held(i) for i, _ in rows]))


def test_katz_many_slices_and_hot_words(spark, monkeypatch):
    """Small slices and buckets; a third of all words are one word, one text is far longer than a slice."""
    monkeypatch.setattr(K, "SLICE", 2000)
    monkeypatch.setattr(K, "PAIRS_A_BUCKET", 500)
    monkeypatch.setattr(K, "WORDS_A_BUCKET", 500)
    rng = random.Random(3)
    rows = [(i, " ".join("the" if rng.random() < 0.35 else f"w{int(rng.paretovariate(0.6)) % 4000}" for _ in range(rng.randrange(40)))) for i in range(300)]
    rows.append((1000, " ".join(f"w{rng.randrange(30)}" for _ in range(20_000))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    # workers import the module anew: the sizes that matter there go through the plan, slices stay whole tasks
    close(sorted(map(tuple, K.score(docs).collect())), brute_scores(rows, [is_held(i) for i, _ in rows]))


def test_katz_sums_to_one():
    """All words after any context, the unknown word included, have probability one."""
    rng = random.Random(5)
    docs = [[f"w{int(rng.paretovariate(1.1)) % 50}" for _ in range(rng.randrange(12))] + ["\n"] for _ in range(200)]
    one, p1, p2 = brute_model(docs)
    assert math.fsum(p1(w) for w in [*one, "unknown word"]) == pytest.approx(1, abs=1e-12)
    for v in [None, *one]:
        assert math.fsum(p2(v, w) for w in [*one, "unknown word"]) == pytest.approx(1, abs=1e-12)


def test_katz_without_training_rows(spark, no_docs):
    assert K.score(no_docs).collect() == []
    docs = docs_of(spark, ["a b", None])
    got = K.score(docs, F.lit(True)).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got) == [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]


def test_katz_tables_grow_with_the_corpus(spark):
    """The stored tables hold every training word and pair."""
    rows = [(i, f"a{i} b{i} c{i % 7}") for i in range(200)]
    model, _ = K.train_and_score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False))
    assert sum(len(r["words"]) for r in model.words.collect()) == 200 * 2 + 7 + 1
    assert sum(len(K.unpack(r["data"], "iii")[2]) for r in model.pairs.collect()) == 200 * 3 + 7
    assert model.unigrams.total == 800


def test_packed_numbers():
    a, b = np.array([1, -5, 1 << 62]), np.array([0.5, -1e300])
    x, y = K.unpack(K.pack(a, b), "if")
    assert x.tolist() == a.tolist() and y.tolist() == b.tolist()
    assert [len(v) for v in K.unpack(K.pack(a[:0], b[:0]), "if")] == [0, 0]


# --- hard negatives ---

def brute_negatives(rows, positives=5, negatives=5):
    """rows: (vec_id, label, vector)."""
    ok = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, label, v in rows
          if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, label, a in ok:
        if i % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a, v)), j, k) for j, k, v in ok if j != i))
        for p, pid in [(-s, j) for s, j, k in scored if k == label][:positives]:
            near = [(j, -s) for s, j, k in scored if k != label and 80 * p <= -100 * s <= 100 * p]
            out += [(i, pid, r, j, p, n) for r, (j, n) in enumerate(near[:negatives], 1)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<float>, row string, v int"


def mined(df, **options):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in N.hard_negatives(df, F.col("id") % 100 == 0, label, **options).collect())


@pytest.mark.parametrize("options", [{}, {"shard_rows": 97, "words": 3, "sample": 50}])
def test_hard_negatives_odd_rows(spark, options):
    rng = random.Random(7)
    rows = [(i, rng.randrange(4), [rng.choice([-1, 1]) * rng.random() + (0.5 if d < 2 else 0) for d in range(7)]) for i in range(600)]
    rows += [(None, 1, [0.1] * 7), (700, None, [0.1] * 7), (701, 1, None), (702, 1, [None] * 7), (703, 1, [float("nan")] * 7), (704, 1, [float("inf")] * 7),
             (800, 1, []), (801, 1, [0.9]), (900, 9, [0.3] * 7)]                            # a short vector, a label of its own
    rows += [(1000 + i, i % 4, [0.25, 0.5, 0.25, 0.0, 0.0, 0.0, 0.0]) for i in range(200)]   # ties: two hundred equal vectors
    rows += [(300, 2, [0.6] * 7), (301, 2, [0.6] * 7), (301, 2, [0.6] * 7)]                 # repeated ids, an anchor among them
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], VECTORS).repartition(5)
    assert mined(df, **options) == brute_negatives(rows)


def test_hard_negatives_large_numbers(spark):
    """Products beyond 2^53 are taken in integers."""
    rows = [(i, i % 2, [1e5 + i, 3e4 - i, 7.0 + i]) for i in range(120)]
    assert mined(spark.createDataFrame([(*r, "", 1) for r in rows], VECTORS)) == brute_negatives(rows)


def test_hard_negatives_empty(spark):
    assert mined(spark.createDataFrame([], VECTORS)) == []


def test_multi_index_stops_early():
    """On vectors in clusters the certified windows leave most cells unvisited."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, (16, 8))
    m = (centres[rng.integers(0, 16, 4000)] + rng.integers(-3, 4, (4000, 8))).astype(np.int64)
    books = N.codebook(m[:, :4], 16), N.codebook(m[:, 4:], 16)
    index = N.MultiIndex(np.arange(4000), np.zeros(4000, np.int64), m, books)
    visited = []
    cells = index.cells
    index.cells = lambda a: (visited.append(1) or c for c in cells(a))
    (ids, scores), = index.search(m[0], np.ones(4000, bool), [(-np.inf, np.inf)], 5)
    exact = m @ m[0]
    best = np.lexsort((np.arange(4000), -exact))[:5]
    assert ids.tolist() == best.tolist() and scores.tolist() == exact[best].tolist()
    assert len(visited) < 0.3 * len(list(cells(m[0])))


def test_new_queries_are_registered():
    for name in ("op11_merkle", "op12_katz", "op13_hard_negatives"):
        assert name in queries.QUERIES and name in queries.ORACLE
