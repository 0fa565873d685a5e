"""Language identification by sparse multinomial logistic regression.

Features are character n-grams (one to three characters, lower case, everything but letters
as one space) hashed to 2^16 buckets, weighted by TF-IDF (1 + log tf, smoothed idf, unit
length).  Document frequencies and class counts come from all training documents.  The weights are
trained by follow-the-regularised-leader (FTRL-proximal) with an elastic net: the L1
part keeps weights at exactly zero until their gradients add up, the L2 part shrinks the rest.
They are fitted on a sample of at most ``sample`` documents (the same share of each class's
allowance, the first by a hash of doc_id); a fifth of it is left out of the training and sets
the temperature that divides the logits.  Only buckets with a weight other than zero are kept and sent to the tasks;
at most ``MOST_CLASSES`` languages, the most frequent ones, are learned.

Training uses text and lang of documents that are not held out; a prediction uses the text
only and covers the whole text.

Defined cases: a null text or one without a letter is ``und`` with score 0; rows without
lang are predicted but not learned from; rows without doc_id take no part; very long
texts are counted in pieces of 2^20 characters; equal probabilities go to the first class
by name; repeated rows get the same answer; without training rows everything is ``und`` (and ``keep_languages``
keeps every text with a letter, since nothing speaks against it); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelwise.llm.common import slices, table

BUCKETS = 1 << 16
PIECE = 1 << 20
MOST_CLASSES = 256


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of a text's character n-grams; empty without a letter."""
    total: np.ndarray | None = None
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[at:at + PIECE].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        is_letter = letters()[codes]
        if not is_letter.any():
            continue
        chars = np.where(is_letter, codes, np.uint32(32))
        chars = chars[np.r_[True, is_letter[1:] | is_letter[:-1]]]
        chars = np.concatenate(([32], chars, [32])).astype(np.uint32)
        a, b, c = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)   # odd multipliers
        two = chars[:-1] * a ^ chars[1:] * b
        three = two[:-1] * c ^ chars[2:] * a
        hashes = np.concatenate((chars * b, two * c, three * b)) >> np.uint32(16)
        if len(text) <= PIECE and len(hashes) < 12_000:
            where, n = np.unique(hashes, return_counts=True)
            return where.astype(np.int64), n
        counts = np.bincount(hashes, minlength=BUCKETS)
        total = counts if total is None else total + counts
    if total is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    where = np.flatnonzero(total)
    return where, total[where]


@dataclass
class Model:
    classes: list[str]
    idf: np.ndarray            # by bucket
    temperature: float = 1.0

    def __post_init__(self) -> None:
        self.set_weights(np.zeros(0, np.int64), np.zeros((0, len(self.classes))))

    def set_weights(self, buckets: np.ndarray, weights: np.ndarray) -> None:
        """Weights of some buckets (BUCKETS: the bias); rows of zeros are dropped."""
        used = np.flatnonzero(np.any(weights != 0, axis=1))
        self.row = np.zeros(BUCKETS + 1, np.int32)             # row of each bucket, 0: all zero
        self.row[buckets[used]] = np.arange(1, len(used) + 1)
        self.weights = np.concatenate([np.zeros((1, len(self.classes))), weights[used]])

    def features(self, where: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[where]
        norm = np.sqrt(x @ x)
        return x / norm if norm else x

    def logits(self, where: np.ndarray, counts: np.ndarray) -> np.ndarray:
        row = self.row[where]
        some = row > 0
        return self.features(where, counts)[some] @ self.weights[row[some]] + self.weights[self.row[BUCKETS]]

    def predict(self, text: str | None) -> tuple[str, float]:
        where, counts = ngram_counts(text) if text else (np.zeros(0, np.int64), None)
        if not len(where) or not self.classes:
            return "und", 0.0
        p = softmax(self.logits(where, counts) / self.temperature)
        best = int(p.argmax())
        return self.classes[best], float(min(p[best], 1.0))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], model: Model, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0,
         l1: float = 0.02, l2: float = 0.5) -> None:
    """Fit the model's weights on (buckets, counts, class) rows, in their order, ``epochs`` times."""
    k = len(model.classes)
    met = np.unique(np.concatenate([[BUCKETS], *(w for w, _, _ in rows)])).astype(np.int64)      # buckets of the rows, and the bias
    z, n = np.zeros((len(met), k)), np.zeros((len(met), k))

    def weights(at):
        zs = z[at]
        w = -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zs) <= l1, 0.0, w)

    prepared = [(np.searchsorted(met, np.r_[w, BUCKETS]), np.r_[model.features(w, c), 1.0], y) for w, c, y in rows]
    for _ in range(epochs):
        for at, x, y in prepared:
            w = weights(at)
            error = softmax(x @ w)
            error[y] -= 1
            g = x[:, None] * error
            squares = n[at] + g * g
            z[at] += g - (np.sqrt(squares) - np.sqrt(n[at])) / alpha * w
            n[at] = squares
    model.set_weights(met, weights(np.arange(len(met))))


def calibrate(rows: list[tuple[np.ndarray, np.ndarray, int]], model: Model) -> None:
    """Set the temperature that gives the held-back rows the largest likelihood."""
    if not rows:
        return
    logits = np.array([model.logits(w, c) for w, c, _ in rows])
    right = np.array([y for _, _, y in rows])

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), right]))

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):          # golden section
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    model.temperature = float(np.exp((low + high) / 2))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, null, documents) and (null, lang, documents) of a task."""
    seen, langs = np.zeros(BUCKETS, np.int64), {}
    for b in slices(batches, 0, 16 << 20):
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            where, _ = ngram_counts(text or "")
            if len(where):
                seen[where] += 1
                langs[lang] = langs.get(lang, 0) + 1
    at = np.flatnonzero(seen)
    yield table({"bucket": (at.tolist() + [None] * len(langs), pa.int32()), "lang": ([None] * len(at) + list(langs), pa.string()),
                 "n": (seen[at].tolist() + list(langs.values()), pa.int64())})


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1, 16 << 20):
        keys, langs, where, counts = [], [], [], []
        for key, text, lang in zip(*(c.to_pylist() for c in b.columns)):
            w, c = ngram_counts(text or "")
            if len(w):
                keys.append(key)
                langs.append(lang)
                where.append(w.astype("<i4").tobytes())
                counts.append(c.astype("<i4").tobytes())
        yield table({"key": (keys, pa.int64()), "lang": (langs, pa.string()), "buckets": (where, pa.binary()),
                     "counts": (counts, pa.binary())})


def train(labelled: DataFrame, sample: int = 4000) -> Model:
    """Fit a model to (doc_id, text, lang) rows; at most ``sample`` documents are fitted."""
    stats = labelled.select("text", "lang").mapInArrow(_frequencies, "bucket int, lang string, n long") \
        .groupBy("bucket", "lang").agg(F.sum("n").alias("n")).collect()      # one row for each bucket and class
    langs = {r["lang"]: r["n"] for r in stats if r["lang"] is not None}
    total = sum(langs.values())
    langs = dict(sorted(langs.items(), key=lambda x: (-x[1], x[0]))[:MOST_CLASSES])
    df = np.zeros(BUCKETS)
    for r in stats:
        if r["bucket"] is not None:
            df[r["bucket"]] = r["n"]
    model = Model(sorted(langs), np.log((1 + total) / (1 + df)) + 1)
    if not langs:
        return model
    key = F.xxhash64("doc_id", F.lit(7))
    share = F.lit(0.0)
    for lang, n in langs.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / len(langs) / n))).otherwise(share)
    chosen = labelled.withColumn("key", key).where(F.pmod("key", F.lit(1 << 30)) < share * (1 << 30)).select("key", "text", "lang")
    rows = chosen.mapInArrow(_sample, "key long, lang string, buckets binary, counts binary") \
        .orderBy("key", "lang", "buckets", "counts").limit(sample).collect()
    index = {c: i for i, c in enumerate(model.classes)}
    data = [(np.frombuffer(r["buckets"], "<i4").astype(np.int64), np.frombuffer(r["counts"], "<i4").astype(np.int64), index[r["lang"]], r["key"])
            for r in rows]
    ftrl([d[:3] for d in data if d[3] % 5], model)
    calibrate([d[:3] for d in data if d[3] % 5 == 0], model)
    return model


def held_out(key: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def _predict(shared):
    """Rows (text, row) to (lang_pred, score, letters, row); the text is not sent back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in slices(batches, 0, 16 << 20):
            texts = b.column(0).to_pylist()
            found = [model.predict(t) for t in texts]
            letter = [x != "und" or any(map(str.isalpha, t or "")) for t, (x, _) in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()),
                                              pa.array(letter, pa.bool_()), b.column(1)], names=["lang_pred", "score", "letters", "row"])
    return run


def predicted(docs: DataFrame, carried: Column, sample: int = 4000) -> DataFrame:
    """lang_pred, score, letters (whether the text has one) and ``row``, the struct ``carried``, of each document (doc_id, text, lang)."""
    spark = docs.sparkSession
    docs = docs.where(F.col("doc_id").isNotNull())
    key = F.col("doc_id").cast("long")
    labelled = docs.select(key.alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")) \
        .where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    shared = spark.sparkContext.broadcast(train(labelled, sample))
    rows = docs.select(F.col("text").cast("string").alias("text"), carried.alias("row"))
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                         T.StructField("letters", T.BooleanType()), T.StructField("row", rows.schema["row"].dataType)])
    return rows.mapInArrow(_predict(shared), kind)


def language_id(docs: DataFrame, sample: int = 4000) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    key = F.col("doc_id").cast("long")
    return predicted(docs, F.struct(key.alias("doc_id"), held_out(key).alias("held_out")), sample) \
        .select("row.doc_id", "row.held_out", "lang_pred", "score")


def keep_languages(docs: DataFrame, wanted: list[str] | None = None, sample: int = 4000) -> DataFrame:
    """The documents, all their columns, that nothing speaks against: the text has a letter and its
    language, where one could be learned, is a wanted one (None: any)."""
    found = predicted(docs, F.struct(*[docs[c] for c in docs.columns]), sample).where("letters")
    if wanted is not None:
        found = found.where(F.col("lang_pred").isin([*wanted, "und"]))
    return found.select("row.*")
