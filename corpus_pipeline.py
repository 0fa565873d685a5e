"""Corpus pipeline: language ID, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's ``docs``.  All stages but the last return the columns
of ``documents``; a row without doc_id goes with the first stage.  Decisions fall on rows: where doc_ids
repeat, the rows are numbered in order of doc_id and decided under these numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.llm import exact_dedup, langid, merkle, mixing, packing, queries, simhash
from parcelwise.llm.common import saved
from parcelwise.session import ship_package

MIXTURE = mixing.Mixture(weights=queries.MIXTURE.weights, numerator=3, denominator=4, epochs=1, seed="corpus-1")


def decided(docs: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``docs`` whose doc_id ``keep`` returns; ``keep`` sees unique doc_ids in the same order."""
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.join(keep(docs).select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    rows = docs.where("doc_id is not null").select(F.lit("").alias("grp"), "doc_id", F.struct(*[docs[c] for c in docs.columns]).alias("doc"),
                                                   F.monotonically_increasing_id().alias("row"))
    rows = saved(merkle.positions(rows, ["doc_id"]).select("pos", "doc"), "numbered")
    kept = keep(rows.select(F.col("pos").alias("doc_id"), "doc.text", "doc.lang", "doc.source"))
    return rows.join(kept.select(F.col("doc_id").alias("pos")), "pos", "left_semi").select("doc.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those without a letter go."""
    ship_package(spark)
    return langid.keep_languages(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    ship_package(spark)
    return decided(docs, lambda d: exact_dedup.exact_dedup(d).where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints, the smallest doc_id."""
    ship_package(spark)
    return decided(docs, lambda d: simhash.simhash_dedup(d, words=3, distance=2).where("doc_id = component_id"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the source budgets take."""
    ship_package(spark)
    return decided(docs, lambda d: mixing.mix(d, MIXTURE, queries.domain_of(d["source"])).where("epochs > 0"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences of 2048 tokens."""
    ship_package(spark)
    return packing.pack(docs, queries.tokenizer("byte_bpe_50k.json"), kind="byte", end=0, capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("exact_dedup", exact), ("simhash_dedup", near), ("mixing", mixture), ("packing", packed)]

ORACLE_SQL = None     # a trained classifier and a tokenizer are beyond SQL; tests hold the rows against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` on."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return saved(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
