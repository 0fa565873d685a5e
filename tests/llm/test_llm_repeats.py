"""Rows that share an id with other texts or vectors; longest previous factors; the encoder's memory; kept documents."""

import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from parcelwise.llm import langid as G
from parcelwise.llm import lpf_dedup as L
from parcelwise.llm import queries as Q
from parcelwise.llm import token_orc as O
from parcelwise.llm import topk as V
from parcelwise.llm.encoding import ChunkEncoder

from conftest import SMALL
from llm.conftest import docs_of


def rows_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", "src1", "clash") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, pos string").repartition(parts)


# --- op4: files number their rows ---

def test_token_index_follows_the_files(spark):
    rows = [(5, "one two three four"), (5, "a"), (5, "seven eight nine ten eleven twelve"), (2, "x y"), (9, ""), (5, None), (5, "a")]
    docs = rows_of(spark, rows)
    from parcelwise.llm.common import scratch
    target = scratch(spark, "tokens")
    O.write_token_orc(docs, target, Q.tokenizer("word_bpe_49k.json"), "word", 2)
    files = sorted(spark.read.schema(O.SCHEMA).orc(target).collect(), key=lambda r: (r["part"], r["row"]))
    start, want = 0, []
    for r in files:
        want.append((r["doc_id"], start, len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes())))
        start += len(r["ids"])
    assert [w[0] for w in want] == [2, 5, 5, 5, 5, 5, 9]
    assert sorted(map(tuple, O.token_index(spark, target).collect())) == sorted(want)


# --- op7: each row is a query ---

def test_topk_repeated_query_rows(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(6)]) for i in range(150)]
    rows += [(100, [rnd.uniform(-1, 1) for _ in range(6)]), (7, rows[7][1]), (7, [0.9] * 6)]
    vec = [(i, np.floor(1024 * np.array(v)).astype(np.int64)) for i, v in rows]
    want = []
    for q, a in vec:
        if q % 100 == 0:
            best = sorted((-int(a @ b), i) for i, b in vec if i != q)[:10]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert sorted(map(tuple, V.top_k(df, F.col("id") % 100 == 0, group_rows=40).collect())) == sorted(want)


# --- op9: longest previous factors, rows with one id ---

def brute_lpf(texts, length):
    """For each suffix of ``length`` bytes the longest prefix shared with a suffix of a smaller document."""
    out = []
    for d, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            best = 0
            for e, u in enumerate(texts[:d]):
                for q in range(len(u) - length + 1):
                    n = 0
                    while n < length and t[p + n] == u[q + n]:
                        n += 1
                    best = max(best, n)
            out.append(best)
    return out


@settings(max_examples=120, deadline=None)
@given(st.lists(st.binary(max_size=24).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=5), st.integers(1, 19))
def test_longest_previous_factors_equal_brute_force(texts, length):
    data = np.frombuffer(b"".join(texts) + bytes(length), np.uint8)
    begin = np.cumsum([0, *map(len, texts)])[:-1]
    places = np.array([b + p for b, t in zip(begin, texts) for p in range(len(t) - length + 1)], np.int64)
    docs = np.array([d for d, t in enumerate(texts) for _ in range(len(t) - length + 1)], np.int64)
    assert L.longest_previous_factors(L.prefix_words(data, places, length), docs, length).tolist() == brute_lpf(texts, length)


def test_passages_of_rows_that_share_an_id(spark):
    rnd = random.Random(6)
    text = lambda n: "".join(rnd.choices("abcdef", k=n))
    passage, own = text(90), text(80)
    rows = [(1, text(30) + passage), (4, own), (4, passage + text(20)), (4, text(10) + passage), (3, "é" * 60), (6, own), (6, own), (6, "é" * 70)]
    first = {}
    for d, t in rows:
        b = t.encode()
        for p in range(len(b) - 49):
            first[b[p:p + 50]] = min(first.get(b[p:p + 50], d), d)
    want = []
    for d, t in rows:
        b, gone = t.encode(), set()
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < d:
                gone.update(range(p, p + 50))
        want.append((d, len(b), len(gone), bytes(x for i, x in enumerate(b) if i not in gone)))
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in L.lpf_dedup(rows_of(spark, rows)).collect()]
    assert sorted(got) == sorted(want)
    assert (4, 80, 0, own.encode()) in got


# --- encoder ---

def test_frequent_chunks_stay_in_memory():
    """A small memory turns over many times; what is used all the time is learnt once."""
    own = ChunkEncoder(Q.tokenizer("byte_bpe_50k.json"), "byte", remembered=20_000)
    learnt, learn = [], own._learn
    own._learn = lambda new, lead, plain: learnt.extend(new) or learn(new, lead, plain)
    for i in range(200):
        own.encode_column(pa.array([f"head always here {' '.join(f'w{i}x{j}' for j in range(30))}"]))
        assert own.known.young.nbytes < 60_000 and own.known.old.nbytes < 60_000
    assert learnt.count("always") == 1 and learnt.count("here") == 1


def test_other_tokenizer_files_are_not_cut(tmp_path):
    """A file with another pre-tokeniser gives the library's ids."""
    spec = json.load(open(Q.tokenizer("byte_bpe_50k.json")))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    path = str(tmp_path / "other.json")
    json.dump(spec, open(path, "w"))
    own, whole = ChunkEncoder(path, "byte"), Tokenizer.from_file(path)
    texts = ["Plain words, here.", "  two  spaces", None, ""]
    flat, ends = own.encode_column(pa.array(texts))
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


# --- language: exact sample, kept documents ---

def test_language_is_fitted_on_an_exact_sample(spark):
    """More rows hash alike than the sample holds: the fit does not depend on the partitions."""
    rows = [(7, f"text number {i} of one id" if i % 2 else f"texte nombre {i} du meme") for i in range(400)]
    docs = spark.createDataFrame([(i, t, "en" if k % 2 else "fr") for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string")
    models = [G.train(docs.repartition(n), sample=40) for n in (2, 5)]
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].temperature == models[1].temperature


def test_language_model_keeps_few_rows(spark):
    docs = Q.documents(spark, SMALL).where("lang is not null")
    model = G.train(docs.select("doc_id", "text", "lang"))
    assert 1 < len(model.weights) < G.BUCKETS // 4 and np.all(np.any(model.weights[1:] != 0, axis=1))


def brute_prediction(model, text):
    """A plain loop over all buckets of a text."""
    where, counts = G.ngram_counts(text or "")
    if not len(where):
        return "und"
    x = [(1 + np.log(c)) * model.idf[w] for w, c in zip(where, counts)]
    norm = sum(v * v for v in x) ** 0.5
    logits = model.weights[model.row[G.BUCKETS]].copy()
    for w, v in zip(where, x):
        if model.row[w]:
            logits += v / norm * model.weights[model.row[w]]
    return model.classes[int(np.argmax(logits))]


def test_kept_languages_equal_a_plain_loop(spark):
    docs = Q.documents(spark, SMALL)
    held = docs.where(~G.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = G.train(held.select("doc_id", "text", "lang"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = {i: brute_prediction(model, t) for i, t in rows}
    assert {r["doc_id"]: r["lang_pred"] for r in G.language_id(docs).collect()} == found
    assert {r["doc_id"] for r in C.language(spark, docs, SMALL).collect()} == {i for i, t in rows if any(map(str.isalpha, t or ""))}
    some = model.classes[:1]
    assert {r["doc_id"] for r in G.keep_languages(docs, some).collect()} == {i for i, x in found.items() if x in some}


def test_pipeline_keeps_documents_without_labels(spark):
    docs = docs_of(spark, ["a text without a label", "un autre texte", "123 456", None, "x"], lang=None)
    assert {r["doc_id"] for r in C.language(spark, docs, SMALL).collect()} == {0, 1, 4}


# --- pipeline: decisions fall on rows ---

def kept(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_pipeline_stages_decide_rows(spark):
    rows = [(5, "A text"), (5, "B text"), (9, "b TEXT"), (11, "C"), (11, "C"), (2, "a text"), (None, "gone")]
    docs = rows_of(spark, rows)
    out = C.exact(spark, docs, SMALL)
    assert kept(out) == [(5, "A text"), (9, "b TEXT"), (11, "C")] and out.columns == docs.columns
    rnd = random.Random(1)
    long = [" ".join(f"w{rnd.randrange(5000)}" for _ in range(200)) for _ in range(4)]
    rows = [(3, long[0]), (9, long[1]), (9, long[0]), (9, long[2]), (12, long[1]), (12, long[3]), (1, long[3])]
    assert kept(C.near(spark, rows_of(spark, rows), SMALL)) == sorted([(3, long[0]), (9, long[1]), (9, long[2]), (1, long[3])])


def test_pipeline_mixture_equals_a_plain_order(spark):
    """The mixing stage against budgets split in plain Python and documents in digest order."""
    import hashlib
    import re
    from llm.test_llm_text import brute_split
    docs = Q.documents(spark, SMALL)
    rows = docs.select("doc_id", Q.domain_of(docs["source"]).alias("domain"), "lang", "source", "text").where("doc_id is not null").collect()
    tokens = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    mix, leaves = C.MIXTURE, {}
    for r in rows:
        leaves.setdefault((r["domain"] or "unknown", r["lang"] or "unknown", r["source"] or "unknown"), []).append(r)
    size = {path: sum(map(tokens, rs)) for path, rs in leaves.items()}
    cap = lambda *p: mix.epochs * sum(n for path, n in size.items() if path[:len(p)] == p)
    w = lambda level, name: mix.weights[level].get(name, mix.weights[level]["*"])
    want = set()
    domains = brute_split(min(sum(size.values()) * mix.numerator // mix.denominator, cap()), {p[0]: (cap(p[0]), w("domain", p[0])) for p in leaves})
    for d, b in domains.items():
        for la, b2 in brute_split(b, {p[1]: (cap(*p[:2]), w("lang", p[1])) for p in leaves if p[0] == d}).items():
            for s, b3 in brute_split(b2, {p[2]: (cap(*p), w("source", p[2])) for p in leaves if p[:2] == (d, la)}).items():
                rs, n = leaves[d, la, s], size[d, la, s]
                whole, part = (b3 // n, b3 % n) if n else (0, 0)
                at = 0
                for r in sorted(rs, key=lambda r: hashlib.md5(f"{mix.seed}:{whole}:{r['doc_id']}".encode()).hexdigest()):
                    if whole or at < part:
                        want.add(r["doc_id"])
                    at += tokens(r)
    assert {r["doc_id"] for r in C.mixture(spark, docs, SMALL).collect()} == want


def test_pipeline_loses_no_row_without_a_reason(spark, odd_docs):
    """Odd rows through the first three stages: what goes has no letter, no id, or an equal or near text that stays."""
    rows = [r for r in odd_docs.collect() if r["doc_id"] is not None]
    letters = [(r["doc_id"], r["text"]) for r in rows if any(map(str.isalpha, r["text"] or ""))]
    docs = C.language(spark, odd_docs, SMALL)
    assert kept(docs) == sorted(letters)
    docs = C.exact(spark, docs, SMALL)
    best = {}
    for i, t in letters:
        low = "".join(c.lower() if c.isascii() else c for c in t)
        best[low] = max(best.get(low, (-1, "")), (i, t))
    assert kept(docs) == sorted(best.values())
