"""Language ID, personal data, mixing and the pipeline."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline as C
import parcelwise.llm.queries as Q
from parcelwise.llm import langid as G
from parcelwise.llm import mixing as M
from parcelwise.llm import pii as P

from conftest import MEDIUM, SMALL
from llm.conftest import ODD, docs_of
from llm.test_llm_dedup import brute_components, brute_exact, brute_fingerprint
from llm.test_llm_output import assert_packed

# --- language ---


def test_language_held_out_accuracy(spark):
    rows = Q.QUERIES["op3_language"](spark, MEDIUM).join(Q.documents(spark, MEDIUM).select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    unseen = [r for r in rows if r["held_out"]]
    assert len(unseen) > 150 and np.mean([r["lang"] == r["lang_pred"] for r in unseen]) >= 0.98


def test_language_ignores_held_out_labels(spark):
    docs = Q.documents(spark, SMALL)
    other = docs.withColumn("lang", F.when(G.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    key = lambda df: sorted(tuple(r) for r in G.language_id(df).collect())
    assert key(docs) == key(other)


def test_language_odd_rows(spark, odd_docs, no_docs):
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in G.language_id(odd_docs).collect()}
    assert set(got) == set(range(len(ODD)))
    for i, t in enumerate(ODD):
        assert (got[i] == ("und", 0.0)) == (not any(c.isalpha() for c in t or ""))
    assert G.language_id(no_docs).collect() == []
    assert {r["lang_pred"] for r in G.language_id(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_elastic_net_and_temperature():
    rnd = np.random.default_rng(1)
    texts = [("".join(rnd.choice(list("abcde" if y else "vwxyz"), 40)), y) for y in rnd.integers(0, 2, 200)]
    rows = [(*G.ngram_counts(t), int(y)) for t, y in texts]
    sizes = []
    for l1 in (0.0, 0.05, 1e6):
        model = G.Model(["a", "b"], np.ones(G.BUCKETS))
        G.ftrl(rows, model, l1=l1)
        sizes.append(np.count_nonzero(model.weights))
    assert sizes[0] > sizes[1] > sizes[2] == 0
    model = G.Model(["a", "b"], np.ones(G.BUCKETS))
    G.ftrl(rows, model)
    noisy = [(w, c, y if i % 4 else 1 - y) for i, (w, c, y) in enumerate(rows)]      # a quarter wrong: scores must come down
    G.calibrate(noisy, model)
    scores = [G.softmax(model.logits(w, c) / model.temperature).max() for w, c, _ in noisy]
    assert abs(np.mean(scores) - 0.75) < 0.05


# --- personal data ---

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        twice = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(digits[::-1])]
        return 13 <= len(digits) <= 19 and sum(x - 9 if x > 9 else x for x in twice) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def brute_seeds(text):
    return [[m.span() for m in re.finditer(p, text) if valid(k, m[0])] for k, p in PATTERNS.items()]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a_Z0125.9@+- ()%,4", max_size=50))
def test_seed_rules_equal_the_patterns(text):
    assert P.seeds(text) == brute_seeds(text)


def test_seed_rules_on_numbers():
    for text in ("4111 1111 1111 1111, 4111-1111-1111-1112", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255", "+1 (743) 555-3824 +12 +123456789012345678",
                 "a@b.c_d@e.f x@y z..@-.-", "é@a.b 🙂a@b.co.uk."):
        assert P.seeds(text) == brute_seeds(text)
    assert P.seeds("1" * 200_000 + "a" * 200_000 + "@" * 1000) == [[], [], [], []]       # linear: returns at once


def test_contextual_discovery(spark):
    """Local phone numbers without + are found by the contexts that other phones share; clean numbers stay."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abcdefgh", k=6))
    texts = [f"{word()} please call phone +1 ({rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)} before {word()}" for _ in range(40)]
    texts += [f"{word()} please call phone 555-{rnd.randrange(1000, 9999)} before {word()}" for _ in range(5)]
    texts += [f"{word()} order {word()} 77{rnd.randrange(1000, 9999)} {word()}" for _ in range(30)] + [None, ""]
    rows = {r["doc_id"]: r for r in P.extract(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = brute_seeds(t or "")
        base = ",".join(f"{k}:{s}:{e}" for k, spans in zip(P.KINDS, want) for s, e in spans)
        r = rows[i]
        assert [r[f"n_{k}"] for k in P.KINDS] == [len(x) for x in want]
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        if 40 <= i < 45:
            at = t.index("555-")
            assert r["n_discovered"] == 1 and r["spans"] == f"phone:{at}:{at + 8}"
        else:
            assert r["n_discovered"] == 0 and r["spans"] == base


def test_candidates_are_whole_runs():
    """Identifiers written with spaces are one candidate each, with the context outside them."""
    for text, want in [("phone 0171 555 1234 now", ["0171 555 1234"]), ("phone (974) 555-3436 now", ["(974) 555-3436"]),
                       ("card 4111 1111 1111 1112, 2020 ok", ["4111 1111 1111 1112"]), ("(0171 / 555 1234)", ["0171 / 555 1234"]),
                       ("to DE89 3704 0044 0532 0130 00. In 12 days", ["DE89 3704 0044 0532 0130 00"]),
                       ("to gb29 nwbk 6016 1331 9268 19 or", ["gb29 nwbk 6016 1331 9268 19"]), ("a 12 FROM 345 b", []),
                       ("key " + "a1" * 50 + " x", ["a1" * 50]), ("0171\u00a0555\u00a01234", ["0171\u00a0555\u00a01234"]),
                       ("on 555-1234 2nd floor", ["555-1234"]), ("bob@corp 0171 555 1234", ["bob@corp", "0171 555 1234"]),
                       ("0171 555\n1234 99", ["0171 555", "1234 99"]), ("+49 171 55 (12)", ["+49 171 55 (12)"]), ("1.2 3 4", [])]:
        assert [text[s:e] for s, e in P.candidates(text, [])] == want, text
    text = "at 10.0.0.1 0171 555 1234 +1 (974) 555-3436"
    assert [text[s:e] for s, e in P.candidates(text, [(3, 11), (26, 43), (28, 30)])] == ["0171 555 1234"]
    assert P.patterns("please call phone (974) 555-3436 before", 18, 32) == ("call phone _", "phone _ before")
    assert len(P.candidates("1 " * 200_000 + "a" * 200_000 + "7" * 199_999, [])) == 2


def test_contextual_discovery_of_spaced_identifiers(spark):
    """Spaced numbers without a seed's form are found whole by the contexts that seeds taught."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefgh", k=6))
    four = lambda: str(rnd.randrange(1000, 9999))
    texts = [f"{word()} please call phone +1 ({rnd.randrange(200, 999)}) 555-{four()} before {word()}" for _ in range(60)]
    while len(texts) < 120:
        card = " ".join(four() for _ in range(4))
        texts += [f"{word()} billed to card {card} on {word()}"] if valid("card", card) else []
    bad = next(c for c in iter(lambda: " ".join(four() for _ in range(4)), None) if not valid("card", c))
    planted = [("phone", f"0171 555 {four()}"), ("phone", f"({rnd.randrange(200, 999)}) 555-{four()}"),
               ("card", bad), ("card", "DE89 3704 0044 0532 0130 00"), ("card", "GB29 NWBK 6016 1331 9268 19"), ("card", "k7" * 40)]
    texts += [f"{word()} please call phone {x} before {word()}" if k == "phone" else f"{word()} billed to card {x} on {word()}" for k, x in planted]
    texts += [f"{word()} order {word()} {four()} {four()} {word()}" for _ in range(30)]
    rows = {r["doc_id"]: r for r in P.extract(docs_of(spark, texts)).collect()}
    for i, (kind, x) in enumerate(planted, 120):
        at = texts[i].index(x)
        assert rows[i]["spans"] == f"{kind}:{at}:{at + len(x)}"
    assert sum(r["n_discovered"] for r in rows.values()) == len(planted)


def test_contexts_hold_whole_words():
    """Words of any length are one word of a pattern; a context ends with the nearest other span."""
    text = "w" * 300 + " phone 0171 by a@b.co, call 12 " + "x" * 5000 + "9"
    spans = P.candidates(text, [(s := text.index("a@b"), s + 6)], 1, 1)
    assert [text[s:e] for s, e in spans[:2]] == ["0171", "12"]
    (before, _), _, (last, around), _ = P.contexts(text, [spans[0], (s, s + 6), spans[1], spans[2]])
    assert before == f"{P.word('w' * 300)} phone _" != f"{P.word('w' * 301)} phone _"
    assert last == "a@b.co call _" and around == f"call _ {P.word('x' * 5000 + '9')}"
    assert P.contexts("a" * 99 + "1", [(99, 100)]) == [(f" {P.word('a' * 99)} _", f"{P.word('a' * 99)} _ ")]
    many = "7" + "+a@b " * 100_000 + "key=" * 100_000
    assert len(P.contexts(many, P.emails(many) + P.candidates(many, [], 1, 1))) > 100


def test_secrets():
    for text, want in [('token = "1eb9c654e721b4f8"###', ["1eb9c654e721b4f8"]), ("API_KEY: abcd1234efgh, x", ["abcd1234efgh"]),
                       ("monkey: abcd1234efgh", []), ("token: 2021-01-01", []), ("token of abcd1234efgh", []), ("password := 'hunter2000'", ["hunter2000"]),
                       ("key=key=ab12cd34", ["ab12cd34"]), ("secret=short1", []), ("key = ", []), ("", [])]:
        assert [text[s:e] for s, e in P.secrets(text)] == want, text
    assert P.secrets("key" + " " * 200_000 + "=" * 200_000) == [] and P.apart([(0, 3), (3, 5), (6, 9)], [(1, 2), (5, 6), (8, 12)]) == [(3, 5)]


def test_discovery_recall_and_precision(spark):
    """Short identifiers and unquoted secrets are found where four seeds teach their context, and nowhere else; planted recall and
    precision are both 1, whatever the partitions and with one identifier in a third of the documents."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices("abcdefgh", k=6))
    hexes = lambda: "a1" + "".join(rnd.choices("0123456789abcdef", k=14))
    texts = [f"{word()} mail {word()}.{i}@mail.example.com soon" for i in range(30)] + [f"{word()} then token = {hexes()} {word()}" for _ in range(30)]
    planted = [("mail", "@corp"), ("mail", "jd7"), ("then token =", f"'{'k1' * 3}'")] + [("mail", "@everyone")] * 60
    texts += [f"{'now' if x == '@everyone' else word()} {lead} {x} soon" for lead, x in planted] + [f"{word()} {word()} {rnd.randrange(99)} soon" for _ in range(60)]
    got = [sorted((r["doc_id"], r["n_discovered"], r["n_spans"], r["spans"]) for r in P.extract(docs_of(spark, texts).repartition(n)).collect())
           for n in (1, 7)]
    assert got[0] == got[1]
    rows = {r[0]: r for r in got[0]}
    for i, (_, x) in enumerate(planted, 60):
        assert rows[i][1:3] == (1, 1) and rows[i][3].endswith(f":{texts[i].index(x.strip(chr(39)))}:{texts[i].index(x) + len(x.rstrip(chr(39)))}")
    assert [rows[i][1] for i in range(30)] == [0] * 30 and [rows[i][3].split(":")[0] for i in range(30, 60)] == ["secret"] * 30
    assert all(rows[i][2] == 0 for i in range(60 + len(planted), len(texts)))


def test_pii_odd_rows(spark, odd_docs, no_docs):
    assert {r["doc_id"] for r in P.extract(odd_docs).collect()} == set(range(len(ODD)))
    assert P.extract(no_docs).collect() == []


def test_registered_pii_equals_brute_force(spark):
    rows = {r["doc_id"]: r for r in Q.QUERIES["op2_pii"](spark, SMALL).collect()}
    for d in Q.documents(spark, SMALL).collect():
        base = ",".join(f"{k}:{s}:{e}" for k, spans in zip(P.KINDS, brute_seeds(d["text"] or "")) for s, e in spans)
        assert rows[d["doc_id"]]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) <= set(rows[d["doc_id"]]["spans"].split(","))


# --- mixing ---

def brute_split(budget, children):
    """children: {name: (capacity, weight)}: water-filling as told in the docstring."""
    left, given = dict(children), {}
    while left:
        heavy = sum(w for _, w in left.values())
        full = sorted((c / w, n) for n, (c, w) in left.items() if c * heavy <= w * budget)
        if not full:
            return given | {n: w * budget // heavy for n, (c, w) in left.items()}
        n = min((c / w, n) for n, (c, w) in left.items())[1]
        given[n] = left.pop(n)[0]
        budget -= given[n]
    return given


@pytest.mark.parametrize("share", [(1, 10), (1, 2), (9, 10), (3, 1)])
def test_budgets_equal_brute_force(spark, share):
    rnd = random.Random(share[0])
    leaves = [(f"d{i % 3}", f"l{i % 4}", f"s{i}", rnd.choice([0, 5, 50, 500, 5000])) for i in range(40)]
    mix = M.Mixture({"domain": {"d0": 5, "*": 1}, "lang": {"l1": 3}, "source": {"s4": 9}}, *share, epochs=2)
    w = lambda level, name: mix.weights[level].get(name, mix.weights[level].get("*", 1))
    cap = lambda *path: 2 * sum(x[3] for x in leaves if x[:len(path)] == path)
    want = {}
    total = sum(x[3] for x in leaves) * share[0] // share[1]
    doms = brute_split(min(total, cap()), {d: (cap(d), w("domain", d)) for d in {x[0] for x in leaves}})
    for d, b in doms.items():
        langs = brute_split(b, {x[1]: (cap(d, x[1]), w("lang", x[1])) for x in leaves if x[0] == d})
        for la, b2 in langs.items():
            for s, b3 in brute_split(b2, {x[2]: (cap(d, la, x[2]), w("source", x[2])) for x in leaves if x[:2] == (d, la)}).items():
                want[d, la, s] = b3
    got = M.budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"), mix).collect()
    assert {(r["domain"], r["lang"], r["source"]): r["given"] for r in got} == want


def test_mix_odd_rows(spark, odd_docs, no_docs):
    rows = M.mix(odd_docs, M.Mixture(numerator=1, denominator=1, epochs=1), F.lit("d")).collect()
    assert len(rows) == len(ODD) + 1 and {r["lang"] for r in rows} == {"en", "unknown"}
    for r in rows:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", ODD[r["doc_id"]] or ""))
        assert (r["n_tokens"], r["taken_tokens"]) == (words, words)       # the whole budget is the whole table
    assert M.mix(no_docs, M.Mixture(), F.lit("d")).collect() == []


def test_mix_prefix_meets_the_budget(spark):
    docs = Q.documents(spark, SMALL)
    rows = Q.QUERIES["op1_mixing"](spark, SMALL).collect()
    total = sum(r["n_tokens"] for r in rows)
    taken = sum(r["taken_tokens"] for r in rows)
    assert total // 2 - 200 <= taken <= total // 2 and len(rows) == docs.count()


# --- pipeline ---

def test_pipeline_stages_equal_brute_force(spark):
    docs = Q.documents(spark, SMALL)
    texts = {r["doc_id"]: r for r in docs.collect()}
    out = C.language(spark, docs, SMALL)
    assert out.columns == docs.columns
    kept = {r["doc_id"] for r in out.collect()}
    assert kept >= {i for i, r in texts.items() if len(re.findall("[^\\W\\d_]", r["text"] or "")) >= 20}
    assert not kept & {i for i, r in texts.items() if not re.search("[^\\W\\d_]", r["text"] or "")}
    out = C.exact(spark, docs.where(F.col("doc_id").isin(list(kept))), SMALL)
    want = {r[0] for r in brute_exact([(i, texts[i]["text"]) for i in kept]) if r[3]}
    assert {r["doc_id"] for r in out.collect()} == want and out.columns == docs.columns
    out = C.near(spark, docs.where(F.col("doc_id").isin(list(want))), SMALL)
    comp = brute_components([(i, brute_fingerprint(texts[i]["text"])) for i in sorted(want)])
    want = {i for i, c in comp.items() if i == c}
    assert {r["doc_id"] for r in out.collect()} == want and out.columns == docs.columns
    left = docs.where(F.col("doc_id").isin(list(want)))
    out = C.mixture(spark, left, SMALL)
    want = {r["doc_id"] for r in M.mix(left, C.MIXTURE, Q.domain_of(left["source"])).collect() if r["epochs"]}
    assert {r["doc_id"] for r in out.collect()} == want and out.columns == docs.columns
    rows = C.packed(spark, docs.where(F.col("doc_id").isin(list(want))), SMALL).collect()
    assert_packed(rows, [(i, texts[i]["text"]) for i in want])
    whole = C.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in whole} == want and len(whole) == len(rows)


def test_pipeline_takes_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs.drop("n_chars")):
        for _, stage in C.STAGES:
            out = stage(spark, docs, SMALL)
            assert {r["doc_id"] for r in out.collect()} <= set(range(len(ODD)))


def test_registered(spark):
    import __spark_entry__ as E
    names = set(E.queries())
    assert set(Q.QUERIES) | {"pipeline"} <= names and set(Q.ORACLE) <= set(E.oracle_sql())
