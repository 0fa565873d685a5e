"""Token files, packing, archives and vector search against brute force and round trips."""

import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import parcelwise.llm.queries as Q
from parcelwise.llm import packing as K
from parcelwise.llm import token_orc as O
from parcelwise.llm import topk as V
from parcelwise.llm import warc as A
from parcelwise.llm.common import scratch
from parcelwise.llm.encoding import ChunkEncoder
from parcelwise.plans import check

from conftest import SMALL
from llm.conftest import ODD

FILES = {"word": "word_bpe_49k.json", "byte": "byte_bpe_50k.json"}


def brute_ids(kind, text, end):
    t = Tokenizer.from_file(Q.tokenizer(FILES[kind]))
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


# --- encoding ---

@pytest.fixture(scope="module", params=["word", "byte"])
def encoders(request):
    path = Q.tokenizer(FILES[request.param])
    return ChunkEncoder(path, request.param, remembered=2000), Tokenizer.from_file(path)


@settings(max_examples=300, deadline=None)
@given(text=st.lists(st.sampled_from(list("aB \n\t'.,1é́Σß½\x1c\xa0🙂st<|") + ["'s", "<|endoftext|>", "  ", "Ω"]), max_size=60).map("".join))
def test_chunks_give_the_ids_of_the_text(encoders, text):
    import pyarrow as pa
    own, whole = encoders
    want = np.array(whole.encode(text, add_special_tokens=False).ids, "<u4")
    assert own.encode([text])[0] == want.tobytes()
    flat, ends = own.encode_column(pa.array([text, None, "plain words, here."]))
    assert flat[ends[0]:ends[1]].tolist() == want.tolist() and ends[1] == ends[2]


# --- ORC ---

def test_token_index_odd_rows(spark, odd_docs):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(5, ODD[5])]
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = brute_ids("word", t, 2)
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = O.token_output(odd_docs, Q.tokenizer(FILES["word"])).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_token_files(spark, odd_docs):
    """Ids come back whole, files ascend in doc_id, a lookup pushes its filter to the files' metadata."""
    target = scratch(spark, "tokens")
    O.write_token_orc(odd_docs, target, Q.tokenizer(FILES["word"]), "word", 2)
    back = O.read_token_orc(spark, target)
    for i, t in enumerate(ODD):
        assert back.where(F.col("doc_id") == i).first()["ids"] == brute_ids("word", t, 2).tolist()
    ends = back.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).collect()
    ends = sorted((r["a"], r["b"]) for r in ends)
    assert all(x[1] < y[0] for x, y in zip(ends, ends[1:]))
    assert "EqualTo(doc_id,3)" in back.where("doc_id = 3")._jdf.queryExecution().toString()


def test_tokens_empty(no_docs):
    assert O.token_output(no_docs, Q.tokenizer(FILES["word"])).collect() == []


# --- packing ---

def naive_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit)[1]] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms), sorted(rooms)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=120))
def test_best_fit_equals_piece_by_piece(lengths):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    plan, bins = K.best_fit_decreasing(histogram, 24)
    rooms, seen = [24] * bins, {n: [] for n in histogram}
    for n, first, last, b, per, offset in plan:
        seen[n] += range(first, last)
        for j in range(last - first):
            assert offset + j % per * n == 24 - rooms[b + j // per]
            rooms[b + j // per] -= n
    assert all(sorted(x) == list(range(histogram[n])) for n, x in seen.items())
    assert (bins, sorted(rooms)) == naive_best_fit(lengths, 24)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 37)), st.integers(0, 37))
def test_capacity_tree(rooms, least):
    tree = K.CapacityTree(37)
    for r in range(38):
        tree.mark(r, True)
    for r in range(38):
        tree.mark(r, r in rooms)
    assert tree.tightest(least) == min((r for r in rooms if r >= least), default=None)


def assert_packed(rows, texts, capacity=2048):
    """rows: packed pieces; texts: (doc_id, text), no repeated ids."""
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == {i for i, _ in texts}
    for i, t in texts:
        ids, at = brute_ids("byte", t, 0), 0
        for n, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (n, at) and (n == 0 or r["length"] == capacity)
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids) and (len(ids) > capacity or len(by_doc[i]) == 1)
    for rs in by_bin.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_bin)


def test_pack_registered(spark):
    rows = Q.QUERIES["op10_packing"](spark, SMALL).collect()
    texts = [(r["doc_id"], r["text"]) for r in Q.documents(spark, SMALL).collect()]
    bins = assert_packed(rows, texts)
    total = sum(r["length"] for r in rows)
    assert bins == naive_best_fit([r["length"] for r in rows], 2048)[0] and bins <= 1.1 * total / 2048 + 1


def test_pack_odd_rows(spark, odd_docs):
    rows = K.pack(odd_docs.where("doc_id <> 5 or doc_id is null"), Q.tokenizer(FILES["byte"]), capacity=64).collect()
    assert_packed(rows, [(i, t) for i, t in enumerate(ODD) if i != 5], 64)
    assert len(K.pack(odd_docs.where("doc_id = 5"), Q.tokenizer(FILES["byte"])).collect()) == 2    # repeated rows stay


def test_pack_empty(no_docs):
    assert K.pack(no_docs, Q.tokenizer(FILES["byte"])).collect() == []


# --- archives ---

def test_arc_versions_and_hostile_payloads():
    body = b"HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\nContent-Length: 30\r\n\r\nhttp://x 1 2 text/html 5\n\nWARC/1.1\n"
    for version in (1, 2):
        raw = b"\n".join([A.arc_version_block(version, "f.arc", "20240101000000"),
                          A.arc_header(version, "http://a/", "1.2.3.4", "20240203040506", "text/html", len(body)) + b"\n" + body,
                          A.arc_header(version, "dns:a", "1.2.3.4", "20240203040506", "text/dns", 4) + b"\nabcd", b""])
        (f, got), (g, dns) = A.parse_arc(io.BytesIO(raw))
        assert got == body and f["URL"] == "http://a/" and f["Archive-date"] == "20240203040506" and dns == b"abcd"
        assert ("Result-code" in f) == (version == 2) and g["Content-type"] == "text/dns"
    with pytest.raises(ValueError):
        list(A.parse_arc(io.BytesIO(raw[:-4])))
    assert A.iso("20240203040506") == "2024-02-03T04:05:06Z"
    assert A.record_id("u", "s", 1) == A.record_id("u", "s", 1) != A.record_id("u", "s", 2)


def test_warc_round_trip_odd_rows(spark):
    long = "é" * 60
    rows = [(1, "http://a/", long), (2, "http://b/ x\ny", long), (3, None, None), (4, "http://d/", ""), (5, "http://e/", "short"),
            (6, "http://f/", "short"), (7, "http://日本/", "\r\n\r\nWARC/1.1\r\n" * 20), (8, "http://h/", long), (None, "http://i/", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = {r["page_id"]: r for r in A.warc_round_trip(pages).collect()}
    assert set(got) == set(range(1, 9))
    for i, _, html in rows[:-1]:
        data = (html or "").encode()
        r = got[i]
        revisit = i in (2, 8)
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 1) if revisit else ("response", None))
        assert bytes(r["payload"]) == (b"" if revisit else data)
        assert r["refers_to_id"] == (got[1]["record_id"] if revisit else None)
    assert len({r["record_id"] for r in got.values()}) == 8


def test_arc_header_lines_with_spaces_or_without_length():
    for version in (1, 2):
        head = A.arc_version_block(version, "f.arc", "20240101000000") + b"\n"
        raw = head + A.arc_header(version, "http://a/b  c d", "1.2.3.4", "20240203040506", "text/html", 4) + b"\nabcd\n"
        (f, got), = A.parse_arc(io.BytesIO(raw))
        assert (f["URL"], f["IP-address"], f["Archive-length"], got) == ("http://a/b  c d", "1.2.3.4", "4", b"abcd")
        for bad in (b"http://a/ 4\nabcd", b"http://a/ 1.2.3.4 2024 text/html x\nabcd"):
            with pytest.raises(ValueError):
                list(A.parse_arc(io.BytesIO(head + bad)))
    (row,) = next(A._from_arc(iter([A.table({"content": ([gzip.compress(raw)], A.pa.binary())})]))).to_pylist()
    assert row["url"] == "http://a/b%20%20c%20d" and row["payload"] == b"abcd"


def test_archives_are_cut_by_bytes(spark):
    """Each archive begins with its own first record and holds a bounded number of blocks; no record is lost, and a payload
    that a third of the pages share has one response."""
    rows = [(i, f"http://a/{i}", "same page " * 30 if i % 3 == 0 else f"page {i} " * (2000 if i == 100 else 40)) for i in range(1, 301)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    A.write_arc(pages, arc, block_bytes=2000, blocks=3)
    A.convert(spark, arc, warc, block_bytes=2000, blocks=3)
    for path, first in ((arc, b"filedesc://"), (warc, b"WARC/1.1\r\nWARC-Type: warcinfo")):
        files = [gzip.decompress(bytes(r["content"])) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()]
        assert len(files) > 10 and all(f.startswith(first) for f in files)
        assert sorted(map(len, files))[-2] < 20_000 < max(map(len, files))
    names = [r["url"] for r in A.read_arc(spark, arc).collect()]
    assert sorted(names) == sorted(u for _, u, _ in rows)
    got = {r["page_id"]: r for r in A.read_warc(spark, warc).collect()}
    assert {i: r["refers_to"] for i, r in got.items()} == {i: 3 if i % 3 == 0 and i != 3 else None for i, _, _ in rows}


def test_warc_empty(spark):
    assert A.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_archives_are_gzip(spark):
    target = scratch(spark, "arc")
    A.write_arc(spark.createDataFrame([(1, "http://a/", "x")], "page_id long, url string, html string"), target)
    files = [bytes(r["content"]) for r in spark.read.format("binaryFile").load(target).collect()]
    assert any(gzip.decompress(f).startswith(b"filedesc://") for f in files)


# --- vector search ---

def test_topk_odd_vectors(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(20)]) for i in range(300)]
    rows += [(300, None), (301, [None] * 20), (302, [float("nan")] * 20), (303, [float("inf")] * 20), (304, []), (305, [0.5] * 3),
             (None, [0.1] * 20), (306, rows[0][1]), (307, rows[0][1]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).repartition(5)
    ok = [(i, np.floor(1024 * np.array(v)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(
        x is not None and np.isfinite(x) for x in v)]
    wide = {k: np.r_[v, np.zeros(20 - len(v), np.int64)] for k, (i, v) in enumerate(ok)}
    want = []
    for q in sorted({i for i, _ in ok if i % 100 == 0 or i == 304}):
        mine = next(wide[k] for k, (i, _) in enumerate(ok) if i == q)
        best = sorted((-int(mine @ wide[k]), i) for k, (i, _) in enumerate(ok) if i != q)[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    got = V.top_k(df, (F.col("id") % 100 == 0) | (F.col("id") == 304), group_rows=64).collect()
    assert sorted(tuple(r) for r in got) == want


def test_topk_fewer_than_k_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in V.top_k(df, F.col("id") == 0).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert V.top_k(df.where("vec_id > 9"), F.col("id") == 0).collect() == []


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_registered_queries_equal_sql(spark, name):
    ok, message = check.compare(Q.QUERIES[name](spark, SMALL), check.duck(SMALL), Q.ORACLE[name])
    assert ok, message
