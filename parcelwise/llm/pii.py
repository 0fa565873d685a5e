"""Personal data by bootstrapped contextual extraction.

Seeds are the entities that four patterns find (e-mail, IP address, card number, phone
number) and, as a fifth kind, values assigned to a name like token, key or password.  Each
seed and each other identifier-like run (a digit or an at sign in it) gives lexical patterns
from the words around it: the two words before it, and the word before with the word after.
Words are whole, whatever their length (a pattern holds those of over 80 characters as a
digest); a context reaches to the nearest other span, that span included, and no further, so
contexts cost time in proportion to the text.  Patterns and instances form a bipartite graph.
Spark scores it in rounds: a pattern's score for a kind is the mean score of its instances
(plus one absent one, so that rare patterns stay weak), an instance that is no seed has the
mean score of its patterns, a seed keeps 1 for its own kind.  Scores are integers in
millionths, so that no order of summing can move one over a threshold.  Runs in a
high-confidence pattern (its score and its number of distinct seeds reach a threshold) whose
own score reaches one too are discovered entities of that kind.

Hot groups: patterns and instances with a large share of all edges, and one identifier
in one context in a large share of the documents, are dealt over tasks (``spread_join``);
everything else is aggregated before it is shuffled.

Seed rules are leftmost and non-overlapping for each kind; a match that fails its check
(IP parts over 255, card length or Luhn digit, phone length) is dropped and not tried again.
Secrets count with the spans that the method adds.  All scans are linear in the length of a text.

Defined cases: a null text is the empty text; positions are code points, ends exclusive;
discovered spans never overlap seed spans of any kind; rows without doc_id take no part;
repeated rows get the same answer; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import keyed_texts, saved, slices, table
from parcelwise.operators.windows import spread_join

KINDS = ["email", "ip", "card", "phone"]
ALL_KINDS = [*KINDS, "secret"]
SECRET = 4
UNIT = 1_000_000     # a score of 1
LONG_WORD = 80       # characters from which a pattern holds a word's digest

# The seed patterns and their character sets.
LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# The last word of a secret's name, and what their values look like.
SECRET_NAMES = {"token", "key", "apikey", "secret", "password", "passwd", "pwd", "credential", "credentials"}
NAME = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"
ASSIGN = re.compile(r"[=:]")
SECRET_VALUE = re.compile(r"[=:]?[\x20\t]*[\"']?([A-Za-z0-9+/_.~-]{8,}+)")

DIGIT_OR_AT = re.compile(r"[0-9@]")
SPACE = re.compile(r"\s")
BRACKET = re.compile(r"[()]")
GAP = re.compile(r"[)-]?[^\S\t\r\n](?:[-/\u2013][^\S\t\r\n]|([A-Za-z]{4}[^\S\t\r\n]))?[(-]?")
IBAN_HEAD = re.compile(r"[A-Za-z]{2}[0-9]{2}")
EDGES = ".,;:!?()[]{}<>\"'#$%&*=+-"
OPENING = "\"'([{<"
Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """Leftmost matches of local part, @, dotted domain, found from the @ outwards."""
    out, cur, at = [], 0, text.find("@")
    while at >= 0:
        left = text[cur:at]
        start = cur + len(left.rstrip(LOCAL_PART))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        cur = m.end() if m else at + 1
        at = text.find("@", cur)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def ips(text: str) -> list[Span]:
    return [m.span() for m in IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]


def cards(text: str) -> list[Span]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]


def secrets(text: str) -> list[Span]:
    """Values of at least 8 characters, a letter and a digit among them, that are assigned to a name of a secret."""
    out, cur = [], 0
    while sign := ASSIGN.search(text, cur):
        at = sign.start()
        left = text[cur:at].rstrip(" \t\"'")
        name = left[len(left.rstrip(NAME)):].lower()
        cur = at + 1
        m = SECRET_VALUE.match(text, cur) if re.split("[_-]", name)[-1] in SECRET_NAMES else None
        if m:
            cur = m.end()
            if any("0" <= c <= "9" for c in m[1]) and any(c.isalpha() for c in m[1]):
                out.append(m.span(1))
    return out


FIND = [emails, ips, cards, phones]


def seeds(text: str) -> list[list[Span]]:
    """The spans of each kind."""
    return [find(text) for find in FIND]


def tokens(text: str) -> Iterator[Span]:
    """Tokens between white space that have a digit or an at sign, without the punctuation at their edges."""
    cur = 0
    while m := DIGIT_OR_AT.search(text, cur):
        start = m.start()
        while start > cur and not text[start - 1].isspace():
            start -= 1
        gap = SPACE.search(text, m.start())
        cur = gap.start() if gap else len(text)
        token = text[start:cur]
        body = token.strip(EDGES)
        start += len(token) - len(token.lstrip(EDGES))
        yield start, start + len(body)


def merged(spans: list[Span]) -> list[list[int]]:
    """The stretches that ``spans`` cover."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def apart(spans: list[Span], taken: list[Span]) -> list[Span]:
    """The spans that do not overlap ``taken``."""
    covered = merged(taken)
    ends = [e for _, e in covered]
    return [(s, e) for s, e in spans if (i := bisect_right(ends, s)) == len(covered) or covered[i][0] >= e]


def joins(body: str) -> bool:
    """Whether a token can be a piece of an identifier written with spaces: no word with a digit in it (2nd, covid19)."""
    if "@" in body or not body:
        return False
    return body.upper() == body or sum("0" <= c <= "9" for c in body) >= sum(c.isalpha() for c in body)


def whole(text: str, start: int, end: int) -> Span:
    """A run with the brackets that belong to ones inside it, and a plus sign before it."""
    depth = lowest = 0
    for b in BRACKET.findall(text, start, end):
        depth += 1 if b == "(" else -1
        lowest = min(lowest, depth)
    if lowest < 0 and text[start - 1:start] == "(":
        start -= 1
    if depth > lowest and text[end:end + 1] == ")":
        end += 1
    return start - (text[start - 1:start] == "+"), end


def candidates(text: str, taken: list[Span], length: int = 6, digits: int = 5) -> list[Span]:
    """Identifier-like runs that do not overlap ``taken``: at least ``length`` characters, ``digits`` digits or an at sign.

    A run is as many tokens with digits as follow each other with a single space, bracket, hyphen or
    slash between them; after a head like that of an IBAN (GB29) also over groups of four letters."""
    runs, at = [], 0
    covered = merged(taken)
    open_, head = False, False       # the last run can go on; it has an IBAN's head
    for start, end in tokens(text):
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        if at < len(covered) and covered[at][0] < end:
            open_ = False
            continue
        body = text[start:end]
        piece = joins(body)
        between = GAP.fullmatch(text, runs[-1][1], start) if open_ and piece else None
        if between and (head or not between[1]):
            runs[-1][1] = end
        else:
            runs.append([start, end])
            head = IBAN_HEAD.fullmatch(body) is not None
        open_ = piece
    return [whole(text, s, e) for s, e in runs
            if e - s >= length and ("@" in text[s:e] or sum("0" <= c <= "9" for c in text[s:e]) >= digits)]


def word(raw: str) -> str:
    w = re.sub("[0-9]", "0", raw.strip(EDGES).lower() or raw)
    return w if len(w) <= LONG_WORD else f"#{xxhash.xxh64_hexdigest(w.encode('utf-8', 'replace'))}"


def patterns(text: str, start: int, end: int, since: int = 0, until: int | None = None) -> tuple[str, str]:
    """The two lexical patterns around a span, from the words in ``text[since:until]``."""
    before = [word(w) for w in text[since:start].rstrip(OPENING).rsplit(None, 2)[-2:]]
    after = [word(w) for w in text[end:until].lstrip(EDGES).split(None, 1)[:1]]
    before = [""] * (2 - len(before)) + before
    return f"{before[0]} {before[1]} _", f"{before[1]} _ {after[0] if after else ''}"


def contexts(text: str, spans: list[Span]) -> list[tuple[str, str]]:
    """The patterns of each span, whose contexts end with the nearest spans before and after it."""
    by_end, by_start = sorted(spans, key=lambda x: x[::-1]), sorted(spans)
    ends, starts = [e for _, e in by_end], [s for s, _ in by_start]
    out = []
    for s, e in spans:
        i, j = bisect_right(ends, s) - 1, bisect_left(starts, e)
        out.append(patterns(text, s, e, by_end[i][0] if i >= 0 else 0, by_start[j][1] if j < len(spans) else None))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{s}:{e}" for k, s, e in spans)


SCAN = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<k:int,s:int,e:int>>, "
        "occurrences array<struct<k:int,s:int,e:int,instance:long,before:string,around:string>>")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    i, s = pa.int32(), pa.string()
    span = pa.struct([("k", i), ("s", i), ("e", i)])
    occurrence = pa.struct([("k", i), ("s", i), ("e", i), ("instance", pa.int64()), ("before", s), ("around", s)])
    for b in slices(batches, 1, 4 << 20):
        docs, counts, digests, bases, found = b.column(0), [], [], [], []
        for text in b.column(1).to_pylist():
            text = text or ""
            by_kind = seeds(text)
            base = [(k, s, e) for k, spans in enumerate(by_kind) for s, e in spans]
            counts.append([len(x) for x in by_kind])
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            bases.append([{"k": k, "s": s, "e": e} for k, s, e in base])
            hidden = [(SECRET, s, e) for s, e in apart(secrets(text), [x[1:] for x in base])]
            known = base + hidden
            known += [(None, s, e) for s, e in candidates(text, [x[1:] for x in known], 1, 1)]
            occ = []
            for (k, st, en), (before, around) in zip(known, contexts(text, [x[1:] for x in known])):
                occ.append({"k": k, "s": st, "e": en, "instance": xxhash.xxh64_intdigest(text[st:en].lower().encode("utf-8", "replace")) - (1 << 63),
                            "before": before, "around": around})
            found.append(occ)
        cols = list(zip(*counts))
        yield table({"doc_id": (docs, pa.int64())} | {f"n_{k}": (c, pa.int64()) for k, c in zip(KINDS, cols)}
                    | {"base_sha256": (digests, s), "base": (bases, pa.list_(span)), "occurrences": (found, pa.list_(occurrence))})


def pattern_scores(edges: DataFrame, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """``edges`` (pattern, instance, k; k null for an instance that is no seed) to
    (pattern, k, score, seeds) and (instance, k, score) of the last round; scores in millionths."""
    seed = edges.where("k is not null").select("pattern", "instance", "k", F.lit(UNIT).cast("long").alias("s"))
    sizes = edges.groupBy("pattern").agg(F.countDistinct("instance").alias("n"))
    support = seed.groupBy("pattern", "k").agg(F.count("*").alias("seeds"))
    unseen = edges.where("k is null").select("pattern", "instance")
    degree = unseen.groupBy("instance").agg(F.count("*").alias("d"))
    scored, scores, instances = seed, None, None
    for _ in range(rounds):
        scores = saved(scored.groupBy("pattern", "k").agg(F.sum("s").alias("sum")).join(sizes, "pattern")
                       .select("pattern", "k", F.expr("sum div (n + 1)").alias("score")), "pattern_scores")
        instances = saved(spread_join(unseen, scores, "pattern", ["instance"]).groupBy("instance", "k").agg(F.sum("score").alias("sum"))
                          .join(degree, "instance").select("instance", "k", F.expr("sum div d").alias("score")), "instance_scores")
        scored = seed.unionByName(spread_join(unseen, instances, "instance", ["pattern"]).select("pattern", "instance", "k", F.col("score").alias("s")))
    return scores.join(support, ["pattern", "k"]), instances


def discovered(scan: DataFrame, confidence: float = 0.6, least_seeds: int = 4, instance_score: float = 0.4, rounds: int = 3) -> DataFrame:
    """(doc_id, k, s, e) of the secrets and of the entities found by high-confidence patterns."""
    occ = scan.select("doc_id", F.inline("occurrences"))
    both = occ.select("doc_id", "k", "s", "e", "instance", F.explode(F.array("before", "around")).alias("pattern"))
    edges = saved(both.groupBy("pattern", "instance").agg(F.max("k").alias("k")), "pattern_graph")
    scores, instances = pattern_scores(edges, rounds)
    strong = scores.where((F.col("score") >= F.lit(round(confidence * UNIT))) & (F.col("seeds") >= least_seeds)) \
        .select("pattern", F.col("k").alias("kind"), "score")
    good = instances.where(F.col("score") >= F.lit(round(instance_score * UNIT))).select("instance", F.col("k").alias("kind"))
    best = F.max(F.struct("score", (-F.col("kind")).alias("k")))
    edge = F.xxhash64("pattern", "instance")
    accepted = saved(spread_join(edges.where("k is null").drop("k"), strong, "pattern", ["instance"]).join(good, ["instance", "kind"])
                     .groupBy("pattern", "instance").agg(best.alias("best"))
                     .select(edge.alias("edge"), F.col("pattern").alias("on_pattern"), F.col("instance").alias("on_instance"), "best"), "accepted")
    hits = spread_join(both.where("k is null").withColumn("edge", edge), accepted, "edge", ["doc_id", "s"]) \
        .where("pattern = on_pattern and instance = on_instance")
    return hits.groupBy("doc_id", "s", "e").agg(F.max("best").alias("best")).select("doc_id", (-F.col("best.k")).alias("k"), "s", "e") \
        .unionByName(occ.where(F.col("k") == SECRET).select("doc_id", "k", "s", "e").distinct())


def extract(docs: DataFrame, **thresholds) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_discovered (spans that the
    method adds), n_spans (all)."""
    scan = saved(keyed_texts(docs).mapInArrow(_scan, SCAN), "pii_scan")
    more = discovered(scan, **thresholds).groupBy("doc_id").agg(F.collect_set(F.struct("k", "s", "e")).alias("more"))
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    more = more.withColumn("more", F.expr("transform(more, x -> named_struct('k', cast(x.k as int), 's', cast(x.s as int), 'e', cast(x.e as int)))"))
    rows = scan.drop("occurrences").join(more, "doc_id", "left")
    every = F.array_sort(F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more")))
    text = F.array_join(F.transform(every, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans"),
                       F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_discovered"), F.size(every).cast("long").alias("n_spans"))
