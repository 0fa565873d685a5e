"""Registered queries of the training-data operators, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.llm import exact_dedup, hard_negatives, katz, langid, lpf_dedup, merkle, mixing, packing, pii, simhash, token_orc, topk, warc
from parcelwise.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir.rstrip("/"))
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file on this machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


# Weights of the registered mixture; documents have no domain column, so the domain is the
# number in the source's name modulo 4.
MIXTURE = mixing.Mixture(weights={"domain": {"d0": 4, "d1": 3, "d2": 2, "*": 1}, "lang": {"en": 4, "fr": 2, "*": 1},
                                  "source": {"src0": 2, "*": 1}}, numerator=1, denominator=2, epochs=2, seed="mix-1")


def domain_of(source: Column) -> Column:
    number = F.regexp_extract(source, "([0-9]+)$", 1)
    return F.when(number != "", F.concat(F.lit("d"), (number.cast("long") % 4).cast("string")))


@query("op1_mixing", r"""
WITH d AS (
  SELECT doc_id,
         CASE WHEN regexp_extract(source, '([0-9]+)$', 1) <> '' THEN 'd' || (regexp_extract(source, '([0-9]+)$', 1)::BIGINT % 4) ELSE 'unknown' END AS domain,
         coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens
  FROM documents WHERE doc_id IS NOT NULL),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, 2 * sum(n_tokens)::BIGINT AS cap FROM d GROUP BY ALL),
n1 AS (SELECT domain, sum(cap)::BIGINT AS cap, CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END AS w FROM leaf GROUP BY domain),
b1 AS (SELECT *, least((SELECT sum(tokens) FROM leaf) // 2, (SELECT sum(cap) FROM n1))::BIGINT AS budget FROM n1),
c1 AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
              sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy FROM b1 WINDOW o AS (ORDER BY cap / w, domain)),
f1 AS (SELECT *, cap * heavy <= w * (budget - spent) AS filled FROM c1),
g1 AS (SELECT domain, CASE WHEN filled THEN cap ELSE (w * (budget - (SELECT min(spent) FROM f1 WHERE NOT filled)))
              // (SELECT max(heavy) FROM f1 WHERE NOT filled) END::BIGINT AS budget FROM f1),
n2 AS (SELECT domain, lang, sum(cap)::BIGINT AS cap, CASE lang WHEN 'en' THEN 4 WHEN 'fr' THEN 2 ELSE 1 END AS w FROM leaf GROUP BY domain, lang),
c2 AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
              sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy
       FROM n2 JOIN g1 USING (domain) WINDOW o AS (PARTITION BY domain ORDER BY cap / w, lang)),
f2 AS (SELECT *, cap * heavy <= w * (budget - spent) AS filled FROM c2),
g2 AS (SELECT domain, lang, CASE WHEN filled THEN cap ELSE (w * (budget - min(spent) FILTER (NOT filled) OVER (PARTITION BY domain)))
              // (max(heavy) FILTER (NOT filled) OVER (PARTITION BY domain)) END::BIGINT AS budget FROM f2),
n3 AS (SELECT *, CASE source WHEN 'src0' THEN 2 ELSE 1 END AS w FROM leaf),
c3 AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
              sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy
       FROM n3 JOIN g2 USING (domain, lang) WINDOW o AS (PARTITION BY domain, lang ORDER BY cap / w, source)),
f3 AS (SELECT *, cap * heavy <= w * (budget - spent) AS filled FROM c3),
g3 AS (SELECT domain, lang, source, tokens,
              CASE WHEN filled THEN cap ELSE (w * (budget - min(spent) FILTER (NOT filled) OVER (PARTITION BY domain, lang)))
              // (max(heavy) FILTER (NOT filled) OVER (PARTITION BY domain, lang)) END::BIGINT AS given FROM f3),
q AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS whole,
             CASE WHEN tokens > 0 THEN given % tokens ELSE 0 END AS part FROM g3),
p AS (SELECT d.*, whole, part, md5('mix-1:' || whole || ':' || doc_id) AS place FROM d JOIN q USING (domain, lang, source)),
r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                - sum(n_tokens) OVER (PARTITION BY domain, lang, source, place) AS start FROM p)
SELECT doc_id, domain, lang, source, n_tokens, (whole + CASE WHEN start < part THEN 1 ELSE 0 END)::BIGINT AS epochs,
       (whole * n_tokens + greatest(0, least(n_tokens, part - start)))::BIGINT AS taken_tokens FROM r
""")
def op1_mixing(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return mixing.mix(docs, MIXTURE, domain_of(docs["source"]))


@query("op2_pii")
def op2_pii(spark, sf_dir):
    return pii.extract(documents(spark, sf_dir))


@query("op3_language")
def op3_language(spark, sf_dir):
    return langid.language_id(documents(spark, sf_dir))


@query("op4_token_orc")
def op4_token_orc(spark, sf_dir):
    return token_orc.token_output(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), kind="word", end=2)


@query("op5_simhash")
def op5_simhash(spark, sf_dir):
    return simhash.simhash_dedup(documents(spark, sf_dir), words=3, distance=2)


@query("op6_exact_dedup", """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
           FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM d
""")
def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


@query("op7_topk", """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             coalesce(list_sum([z[1] * z[2] for z in list_zip(q.v, c.v, true)]), 0)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""")
def op7_topk(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, F.col("id") % 100 == 0, k=10)


@query("op8_warc", """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
           FROM pages WHERE page_id IS NOT NULL),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM f
""")
def op8_warc(spark, sf_dir):
    return warc.warc_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), revisit_from=100) \
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_lpf_dedup")
def op9_lpf_dedup(spark, sf_dir):
    return lpf_dedup.digest_rows(lpf_dedup.lpf_dedup(documents(spark, sf_dir), length=50))


@query("op10_packing")
def op10_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), kind="byte", end=0, capacity=2048)


# Unsigned CRC-32 of doc_id as text, in SQL.
CRC32 = """xor(list_reduce([4294967295::BIGINT] || [ord(c)::BIGINT for c in string_split(doc_id::VARCHAR, '')],
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

# One leaf's text in SQL, `text` being the expression that stands for the text.
LEAF = """sha256(CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
  || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END
  || CASE WHEN {text} IS NULL THEN '-' ELSE strlen({text}) || ':' || {text} END)"""


@query("op11_merkle", f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {LEAF.format(text="text")} AS leaf,
         {LEAF.format(text="(CASE WHEN doc_id IS NOT NULL AND " + CRC32 + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)")} AS altered
  FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, altered) - 1 AS pos FROM d),
low(source, k, nodes) AS (
  SELECT source, 0, list(leaf ORDER BY pos) FROM l GROUP BY source
  UNION ALL
  SELECT source, k + 1, [sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], '')) for i in range((len(nodes) + 2) // 3)] FROM low WHERE len(nodes) > 1),
subroots AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS pos FROM low WHERE len(nodes) = 1),
high(k, nodes) AS (
  SELECT 0, list(subroot ORDER BY pos) FROM subroots HAVING count(*) > 0
  UNION ALL
  SELECT k + 1, [sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], '')) for i in range((len(nodes) + 2) // 3)] FROM high WHERE len(nodes) > 1),
top AS (SELECT nodes[1] AS root FROM high WHERE len(nodes) = 1),
s AS (
  SELECT l.source, l.pos, k AS step, nodes, (l.pos // (3 ** k)::BIGINT)::BIGINT AS node FROM l JOIN low ON low.source IS NOT DISTINCT FROM l.source WHERE len(nodes) > 1
  UNION ALL
  SELECT l.source, l.pos, 1000 + k, nodes, (t.pos // (3 ** k)::BIGINT)::BIGINT FROM l JOIN subroots t ON t.source IS NOT DISTINCT FROM l.source, high WHERE len(nodes) > 1),
f AS (SELECT source, pos, step, array_to_string(nodes[node - node % 3 + 1:node], '') AS lhs, array_to_string(nodes[node + 2:node - node % 3 + 3], '') AS rhs FROM s),
p AS (SELECT source, pos, list(lhs || '|' || rhs ORDER BY step) AS path, string_agg(lhs || rhs, '' ORDER BY step) AS siblings FROM f GROUP BY source, pos)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256,
       list_reduce([altered] || coalesce(path, []), lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) AS folded_root,
       folded_root = root AS verified
FROM l JOIN subroots t ON t.source IS NOT DISTINCT FROM l.source CROSS JOIN top
LEFT JOIN p ON p.source IS NOT DISTINCT FROM l.source AND p.pos = l.pos
""")
def op11_merkle(spark, sf_dir):
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    without = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(documents(spark, sf_dir), {"text": without}).drop("path")


@query("op12_katz", rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, {CRC32} % 10 = 0 AS held_out,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') || [chr(10)] AS ws
  FROM documents WHERE doc_id IS NOT NULL),
t AS (SELECT r, held_out, unnest([''] || ws[:-2]) AS v, unnest(ws) AS w FROM d),
u AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
p AS (SELECT v, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY v, w),
h AS (SELECT 1 AS level, c, count(*) AS n FROM u GROUP BY c UNION ALL SELECT 2, c, count(*) FROM p GROUP BY c),
g AS (SELECT level, coalesce(max(n) FILTER (c = 1), 0) AS n1, coalesce(max(n) FILTER (c = 6), 0) AS n6 FROM h GROUP BY level),
x AS (SELECT h.level, h.c, ((h.c + 1) * coalesce(j.n, 0) / (h.c * h.n) - 6 * n6 / n1) / (1 - 6 * n6 / n1) AS d
      FROM h JOIN g USING (level) LEFT JOIN h j ON j.level = h.level AND j.c = h.c + 1 WHERE h.c <= 5 AND n1 > 0 AND 6 * n6 < n1),
d1 AS (SELECT c, d FROM x WHERE level = 1 AND d > 0 AND d <= 1),
d2 AS (SELECT c, d FROM x WHERE level = 2 AND d > 0 AND d <= 1),
s AS (SELECT coalesce(sum(c), 0)::BIGINT AS total, count(*) AS size, coalesce(sum(c * coalesce(d, 1)), 0) AS kept FROM u LEFT JOIN d1 USING (c)),
m AS (SELECT total, size, total + CASE WHEN kept < total THEN 0 ELSE 1 END AS den, (den - kept) / den AS unknown FROM s),
u1 AS (SELECT w, c, c * coalesce(d, 1) / den AS p1 FROM u LEFT JOIN d1 USING (c), m),
a AS (SELECT v, sum(p.c) AS total, sum(p.c * coalesce(d, 1)) AS kept, sum(p1) AS seen FROM p LEFT JOIN d2 ON d2.c = p.c JOIN u1 USING (w) GROUP BY v),
b AS (SELECT v, a.total + CASE WHEN kept < a.total THEN 0 ELSE 1 END AS cden, (cden - kept) / cden / greatest(1 - seen, unknown) AS alpha FROM a, m),
q AS (SELECT r, u1.c IS NOT NULL AS known, (coalesce(u1.c, 0) + 0.1::DOUBLE) / (m.total + 0.1::DOUBLE * (size + 1)) AS base,
             CASE WHEN p.c IS NOT NULL THEN p.c * coalesce(d, 1) / cden ELSE coalesce(alpha, 1) * coalesce(p1, unknown) END AS prob
      FROM t LEFT JOIN u1 ON u1.w = t.w LEFT JOIN p ON p.v = t.v AND p.w = t.w LEFT JOIN d2 ON d2.c = p.c LEFT JOIN b ON b.v = t.v, m),
z AS (SELECT r, count(*) AS n_tokens, count(*) FILTER (known) AS n_known, fsum(log10(base)) AS base, fsum(log10(prob)) AS score FROM q GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, total AS train_tokens, round(base, 6) AS base_score, round(score, 6) AS score FROM z JOIN d USING (r), m
""")
def op12_katz(spark, sf_dir):
    """Scores rounded to six decimals, so that they compare with SQL's."""
    return katz.score(documents(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


@query("op13_hard_negatives", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
                  [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
             coalesce(list_sum([z[1] * z[2] for z in list_zip(a.v, c.v, true)]), 0)::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
r AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
             vec_id AS negative_id, positive_score, score AS negative_score
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT * FROM r WHERE rank <= 5
""")
def op13_hard_negatives(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors, F.col("id") % 100 == 0, label, scale=256)
