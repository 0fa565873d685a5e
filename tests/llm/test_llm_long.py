"""Texts longer than a task's slice, between short ones, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwise.llm import exact_dedup as X
from parcelwise.llm import langid as G
from parcelwise.llm import mixing as M
from parcelwise.llm import packing as K
from parcelwise.llm import pii as P
from parcelwise.llm import queries as Q
from parcelwise.llm import simhash as S
from parcelwise.llm import token_orc as O

from llm.conftest import docs_of
from llm.test_llm_dedup import brute_fingerprint
from llm.test_llm_output import FILES, assert_packed, brute_ids

WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    words = ["".join(rnd.choices("abcdeEéß日", k=rnd.randrange(1, 9))) for _ in range(3000)]
    long = " ".join(rnd.choices(words, k=800_000))
    assert len(long.encode()) > 4 << 20
    return ["before it", long, None, "after it, short", long[:-1], "x" * (4 << 20) + " end"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return docs_of(spark, texts).coalesce(1)


def test_token_ids_of_long_texts(docs, texts):
    rows = {r["doc_id"]: r for r in O.token_output(docs, Q.tokenizer(FILES["word"]), kind="word", end=2).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = brute_ids("word", t, 2)
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_packing_of_long_texts(docs, texts):
    assert_packed(K.pack(docs, Q.tokenizer(FILES["byte"]), kind="byte", end=0, capacity=2048).collect(), list(enumerate(texts)))


def test_fingerprints_of_long_texts(docs, texts):
    got = {r["doc_id"]: r["fingerprint"] for r in S.simhash_dedup(docs).collect()}
    assert got == {i: f"{brute_fingerprint(t):016x}" for i, t in enumerate(texts)}


def test_exact_copies_of_very_long_texts(spark):
    long = "Ab c" * (9 << 20)
    texts = ["a", long, long.lower(), long + "x", None]
    rows = {r["doc_id"]: r for r in X.exact_dedup(docs_of(spark, texts).coalesce(1)).collect()}
    assert [rows[i]["keep_id"] for i in range(5)] == [0, 2, 2, 3, 4]
    assert [rows[i]["text_sha256"] for i in range(5)] == [hashlib.sha256((t or "").lower().encode()).hexdigest() for t in texts]


def test_ngrams_of_long_texts(texts):
    """Counted in pieces: the counts of the pieces add up, the whole text among them."""
    long = texts[1]
    where, counts = G.ngram_counts(long)
    total = np.zeros(G.BUCKETS, np.int64)
    for at in range(0, len(long), G.PIECE):
        w, c = G.ngram_counts(long[at:at + G.PIECE])
        total[w] += c
    assert np.array_equal(where, np.flatnonzero(total)) and np.array_equal(counts, total[where])


def test_budgets_of_long_texts(docs, texts):
    rows = {r["doc_id"]: r for r in M.mix(docs, M.Mixture(numerator=1, denominator=2, epochs=1), F.lit("d")).collect()}
    words = [len(re.findall(WORD, t or "")) for t in texts]
    assert [rows[i]["n_tokens"] for i in range(len(texts))] == words
    taken = sum(r["taken_tokens"] for r in rows.values())
    assert taken <= sum(words) // 2 and all(r["taken_tokens"] in (0, r["n_tokens"]) or r["taken_tokens"] < r["n_tokens"] for r in rows.values())


def test_entities_of_long_texts(spark, texts):
    """Spans far inside a text keep their code points; a text of one word only costs linear time."""
    tail = " mail ä.b@example.com or +1 (743) 555-3824"
    rows = {r["doc_id"]: r for r in P.extract(docs_of(spark, [texts[1] + tail, "+a@b.c" * 200_000, texts[5]]).coalesce(1)).collect()}
    at = len(texts[1])
    assert rows[0]["spans"] == f"email:{at + 7}:{at + 21},phone:{at + 25}:{at + 42}"
    assert rows[1]["n_email"] == len(P.emails("+a@b.c" * 200_000)) and rows[2]["spans"] == ""
