"""Exact dedup, SimHash near-dedup, components and repeated passages against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from parcelwise.llm import exact_dedup as X
from parcelwise.llm import lpf_dedup as L
from parcelwise.llm import simhash as S
from parcelwise.llm.components import components

from conftest import SMALL
from llm.conftest import ODD, docs_of


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# --- exact dedup ---

def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    return sorted((i, max(groups[lower(t)]), len(groups[lower(t)]), i == max(groups[lower(t)]),
                   hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("heavy", [None, 2])
def test_exact_dedup_odd_rows(spark, odd_docs, heavy):
    got = sorted(tuple(r) for r in X.exact_dedup(odd_docs, heavy).collect())
    assert got == brute_exact([(i, t) for i, t in enumerate(ODD)] + [(5, ODD[5])])


def test_exact_dedup_hot_group_is_settled_by_broadcast(spark):
    rows = [(i, "Hot" if i % 3 == 0 else f"text {i // 2}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(tuple(r) for r in X.exact_dedup(docs).collect()) == brute_exact(rows)
    digests = docs.mapInArrow(X._digest, X.DIGESTS)
    hot = X.heavy_digests(digests, 3000, 4).collect()
    assert [(r["keep_id"], r["group_size"]) for r in hot] == [(2997, 1000)]


def test_exact_dedup_empty(no_docs):
    assert X.exact_dedup(no_docs).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=300), st.integers(1, 8))
def test_misra_gries_bound(values, counters):
    summary = Counter()
    for i in range(0, len(values), 17):
        summary.update(values[i:i + 17])
        summary = X.trim(summary, counters)
    assert len(summary) <= counters
    for v, n in Counter(values).items():
        assert n - len(values) / (counters + 1) <= summary[v] <= n


# --- simhash ---

def brute_fingerprint(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, distance=2):
    """fps: list of (id, fingerprint)."""
    parent = {i: i for i, _ in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for k, (i, a) in enumerate(fps):
        for j, b in fps[:k]:
            if (a ^ b).bit_count() <= distance:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in fps}


def test_simhash_odd_rows(spark, odd_docs):
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in S.simhash_dedup(odd_docs).collect()}
    fps = [(i, brute_fingerprint(t)) for i, t in enumerate(ODD)]
    want = brute_components(fps)
    assert got == {(i, f"{f:016x}", want[i]) for i, f in fps}


def test_simhash_empty(no_docs):
    assert S.simhash_dedup(no_docs).collect() == []


@pytest.mark.parametrize("dense", [0, 2, 32])
@pytest.mark.parametrize("distance", [1, 2])
def test_simhash_links_equal_brute_force(spark, dense, distance):
    """Families of fingerprints a few bits apart, chains of links included, and far ones."""
    rnd = random.Random(dense * 10 + distance)
    fps = {0}
    for _ in range(12):
        base = rnd.getrandbits(64)
        for _ in range(25):
            base ^= 1 << rnd.randrange(64)
            if rnd.random() < 0.5:
                base ^= 1 << rnd.randrange(64)
            fps.add(base)
    rows = list(enumerate(sorted(fps)))
    reps = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in rows], "fp long, rep long")
    found = {r["id"]: r["component"] for r in components(S.links(reps, distance, dense)).collect()}
    want = brute_components(rows, distance)
    assert {i: found.get(i, i) for i, _ in rows} == want


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), min_size=0, max_size=2))
def test_close_fingerprints_share_a_cell(fp, flips):
    other = fp
    for b in flips:
        other ^= 1 << b
    cells = [set(S.cells_within_one_step(np.array([x], np.uint64))[1].tolist()) for x in (fp, other)]
    assert cells[0] & cells[1]


def test_components_chain_and_star(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


# --- repeated passages ---

def brute_passages(rows, length):
    """rows: (doc_id, bytes); {doc_id: (n_bytes, n_removed, n_spans, kept)}."""
    first = {}
    for d, b in rows:
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            first[w] = min(first.get(w, d), d)
    out = {}
    for d, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < d:
                gone[p:p + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g))
    return out


def lpf(docs, **kw):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in L.lpf_dedup(docs, **kw).collect()}


def test_passages_odd_rows(spark, odd_docs):
    rows = [(i, (t or "").encode()) for i, t in enumerate(ODD)]
    assert lpf(odd_docs) == brute_passages(rows, 50)
    assert lpf(odd_docs, length=9, anchor=4) == brute_passages(rows, 9)


def test_passages_empty(no_docs):
    assert L.lpf_dedup(no_docs).collect() == []


def test_passages_shared_copied_and_periodic(spark, monkeypatch):
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choices("abcdé \n", k=n))
    passage, hot = text(130), text(60)
    texts = [text(400) + passage + text(50), passage[10:100] + text(80), text(30) + passage[:49], "ab" * 200, text(20) + "ab" * 90,
             hot * 2, *[text(rnd.randrange(80)) + hot + text(rnd.randrange(80)) for _ in range(60)]]
    texts += [texts[0], texts[0][:200] + "CHANGED" + texts[0][200:], text(5000)]
    rnd.shuffle(texts)
    docs = docs_of(spark, texts).repartition(5)
    want = brute_passages([(i, t.encode()) for i, t in enumerate(texts)], 50)
    assert lpf(docs) == want
    assert sum(v[1] for v in want.values()) > 4000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=90).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6), st.integers(4, 12))
def test_bucket_search_equals_brute_force(texts, length):
    """Map and reduce sides of one chunk, over a three-letter alphabet full of repeats (zero bytes included)."""
    chunk = list(enumerate(texts))
    data, runs = L.runs_of(chunk, length, 3)
    want = {d: v[1] for d, v in brute_passages(chunk, length).items()}
    gone = {d: set() for d, _ in chunk}
    if runs is not None:
        _, docs, pos, at, count = runs
        packed = data[L.ranges(at, count + length - 1)]
        for d, s, e in zip(*L.repeated_in_bucket(docs, pos, count, packed, length)):
            gone[int(d)].update(range(s, e))
    assert {d: len(x) for d, x in gone.items()} == want


def test_hot_anchor_is_dealt_over_buckets(spark, monkeypatch):
    """A passage in varying texts: its edges are spread by whole prefixes, its inside is sent once a chunk, results as before."""
    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choices("abcdefghij", k=n))
    passage, short = text(120), text(30)
    texts = [text(100) + (passage if i % 3 else short) + text(100) for i in range(300)] + ["ab" * 300, None, ""]
    want = brute_passages([(i, (t or "").encode()) for i, t in enumerate(texts)], 50)
    docs = docs_of(spark, texts).repartition(3)
    slots = L.hot_slots(docs.select("doc_id", "text"), 50, 12, 100, 1)
    assert 0 < len(slots) < 20
    assert lpf(docs, hot=100, share=1) == lpf(docs, hot=1, share=1) == want

    batch = L.table({"doc_id": (list(range(300)), L.pa.int64()), "text": (texts[:300], L.pa.string())})
    monkeypatch.setattr(L, "SLICE", 1000)

    def load(slots):        # bytes sent to each part of a bucket, without compression
        out = {}
        for b in L._send(50, 12, 16, 4, slots)(iter([batch])):
            for r in b.to_pylist():
                for i, blob in enumerate(r["bytes"] or []):
                    out[r["bucket"], i] = out.get((r["bucket"], i), 0) + (len(L.zstandard.ZstdDecompressor().decompress(blob)) if blob else 0)
        return max(out.values()) / (sum(out.values()) / len(out))
    assert load(slots) < 2 < 4 < load(slots[:0])


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(L, "PIECE", 64)
    a = "".join(random.Random(1).choices("abcdef", k=900))
    chunk = [p for p in L._pieces(L.table({"doc_id": ([1], L.pa.int64()), "text": ([a], L.pa.string())}), 50)]
    assert sum(len(t) - 49 for _, _, t in chunk) == 900 - 49 and all(a[at:at + len(t)].encode() == t for _, at, t in chunk)


def test_registered_passages_equal_brute_force(spark):
    import parcelwise.llm.queries as Q
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in Q.documents(spark, SMALL).collect()]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in Q.QUERIES["op9_lpf_dedup"](spark, SMALL).collect()}
    assert got == {d: (*v[:3], hashlib.sha256(v[3]).hexdigest()) for d, v in brute_passages(rows, 50).items()}


def test_registered_simhash_equals_brute_force(spark):
    import parcelwise.llm.queries as Q
    fps = [(r["doc_id"], brute_fingerprint(r["text"])) for r in Q.documents(spark, SMALL).collect()]
    want = brute_components(fps)
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in Q.QUERIES["op5_simhash"](spark, SMALL).collect()}
    assert got == {(i, f"{f:016x}", want[i]) for i, f in fps}


# --- what joins may broadcast ---

def broadcast_sources(df):
    """The plan below each broadcast of a table, line by line."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [re.search(r"\w", x).start() if re.search(r"\w", x) else 0 for x in lines]
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            yield "\n".join(lines[i + 1:end])


@pytest.mark.parametrize("distance", [1, 2])
def test_cells_and_points_are_not_broadcast_by_the_size_before_they_are_made(spark, tmp_path, distance):
    spark.range(2000).selectExpr("xxhash64(id) as fp", "id as rep").write.parquet(str(tmp_path / "reps"))
    plan = S.links(spark.read.parquet(str(tmp_path / "reps")), distance)
    assert not [x for x in broadcast_sources(plan) if "MapInArrow" in x]


def test_tables_read_back_are_not_broadcast_by_their_file_size(spark, tmp_path, monkeypatch):
    from parcelwise.llm import components as C
    from parcelwise.llm import mixing as M
    seen, real = [], C.saved

    def watched(df, name, **options):
        seen.append((name, list(broadcast_sources(df))))
        return real(df, name, **options)
    monkeypatch.setattr(C, "saved", watched)
    path = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, i) for i in range(21, 40)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(path).collect()}
    assert got == {i: 0 for i in range(10)} | {i: 20 for i in range(20, 40)}
    assert len(seen) > 2 and not [x for _, found in seen for x in found if "hashpartitioning" not in x]
    docs = docs_of(spark, [f"w{i} w{i % 7} same same" for i in range(60)])
    for df in (S.simhash_dedup(docs), S.simhash_dedup(docs).where("doc_id = component_id"),
               M.mix(docs, M.Mixture(weights={"source": {"*": 1}}, numerator=1, denominator=2, epochs=1, seed="s"), docs["source"])):
        unmeasured = [x for x in broadcast_sources(df) if "hashpartitioning" not in x]
        assert not [x for x in unmeasured if "[doc_id" in x or "slot#" in x or "[fp" in x]
