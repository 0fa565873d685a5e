"""Tables that a stream keeps up to date without rewriting them (ST7, ST12, ST15).

A table is cut into ``BUCKETS`` by a hash of its key.  Each epoch writes the buckets it touches into
a folder of its own (``epoch=N/bucket=K``), so a replayed epoch overwrites itself and nothing that is being read is
replaced; older versions of a bucket are only dead files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 32


def bucket_of(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def _epochs(spark: SparkSession, out: str, before: int) -> list[int]:
    """Epochs of a table below ``before`` (the folder's listing through Spark's file system)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("epoch=") and int(n.split("=")[1]) < before)


def table(spark: SparkSession, out: str, before: int = 1 << 62) -> DataFrame | None:
    """All rows with their ``epoch`` and ``bucket``; None while the table is empty."""
    epochs = _epochs(spark, out, before)
    if not epochs:
        return None
    return spark.read.option("basePath", out).parquet(*[f"{out}/epoch={e}" for e in epochs])


def latest(spark: SparkSession, out: str, before: int = 1 << 62) -> DataFrame | None:
    """The current version of each bucket."""
    rows = table(spark, out, before)
    if rows is None:
        return None
    newest = rows.groupBy("bucket").agg(F.max("epoch").alias("epoch"))           # from the folders' names: a row a bucket
    return rows.join(F.broadcast(newest), ["bucket", "epoch"], "left_semi")


def touched(batch: DataFrame, bucket: Column) -> list[int]:
    return sorted(r[0] for r in batch.select(bucket.alias("b")).distinct().collect())     # at most BUCKETS


def write(rows: DataFrame, out: str, epoch: int, **options) -> None:
    rows.write.mode("overwrite").options(**options).partitionBy("bucket").parquet(f"{out}/epoch={epoch}")


# ------------------------------------------------------------------ ST7
def new_records_sink(keys: list[str]):
    """ST7: append the records of a micro-batch whose key no earlier epoch holds.  The stream has no state: the seen
    keys are the bucketed table itself (with Bloom filters), and only the buckets that the micro-batch touches are read."""
    def publish(batch: DataFrame, epoch: int, out: str) -> None:
        new = batch.select(*keys).dropDuplicates().withColumn("bucket", bucket_of(*keys)).persist()
        try:
            seen = table(batch.sparkSession, out, before=epoch)
            rows = new
            if seen is not None:
                seen = seen.filter(F.col("bucket").isin(touched(new, F.col("bucket")))).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("bucket").alias("_b"))
                same = F.col("bucket") == F.col("_b")
                for k in keys:
                    same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
                rows = new.join(seen, same, "left_anti")
            write(rows, out, epoch, **{f"parquet.bloom.filter.enabled#{k}": "true" for k in keys})
        finally:
            new.unpersist()
    return publish


# ------------------------------------------------------------------ ST15
def upsert_sink(key: str, bucket_key: Column, derive, full):
    """Keep one row per ``key`` of an update-mode stream, and in ``out/published`` what ``derive(rows)`` makes of them,
    bucket by bucket: an epoch reads and writes the buckets of its changed rows only.  ``full(batch, epoch)``: whether every
    bucket has to be derived again."""
    def publish(batch: DataFrame, epoch: int, out: str) -> None:
        spark = batch.sparkSession
        changed = batch.withColumn("bucket", bucket_key).persist()
        try:
            state, shown = f"{out}/state", f"{out}/published"
            old = latest(spark, state, before=epoch)
            everything = old is None or full(batch, epoch, old)
            buckets = list(range(BUCKETS)) if everything else touched(changed, F.col("bucket"))
            rows = changed
            if old is not None:
                kept = old.filter(F.col("bucket").isin(buckets)).drop("epoch") \
                    .join(changed.select(F.col(key).alias("_k")), F.col(key).eqNullSafe(F.col("_k")), "left_anti")
                rows = changed.unionByName(kept)
            if buckets:
                write(rows.select(*changed.columns), state, epoch)
                now = latest(spark, state, before=epoch + 1)
                write(derive(now.filter(F.col("bucket").isin(buckets)).drop("epoch"), buckets), shown, epoch)
        finally:
            changed.unpersist()
    return publish
