"""Base-table access.

``Tables(spark, dir)`` reads each driver table lazily from parquet; Catalyst
prunes columns and pushes filters into the scan, so loaders never select or
filter eagerly.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


class Tables:
    """``streaming=True`` turns every table into a file stream with the batch schema
    (the path is a one-file glob, so new files landing next to it are not picked up)."""

    def __init__(self, spark: SparkSession, sf_dir: str, streaming: bool = False, files_per_trigger: int = 1000):
        self.files_per_trigger = files_per_trigger
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.streaming = streaming

    def read(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        if not self.streaming:
            return self.spark.read.parquet(path)
        schema = self.spark.read.parquet(path).schema
        return self.spark.readStream.schema(schema).option("maxFilesPerTrigger", self.files_per_trigger).parquet(f"{self.sf_dir}/{name}.parque[t]")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.read(name)
        raise AttributeError(name)

    @cached_property
    def views(self):
        from parcelwise.sources.views import Views
        return Views(self)
