"""Export sinks (K1–K4): the scored feed as CSV, the client sample as JSON, the
anonymised demo as CSV, compliance reports as JSON or CSV.

Writers go to a path under the shared folder; readers use the written schema, so a
round trip is typed.  Output is written by the executors in parallel (one file per
partition) — no export is funnelled through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("csv", "json", "parquet")


def write_export(df: DataFrame, path: str, fmt: str = "csv") -> str:
    if fmt not in FORMATS:
        raise ValueError(f"unsupported export format {fmt!r} (pdf/xlsx rendering is not built)")
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
    return path


def read_export(spark: SparkSession, path: str, schema, fmt: str = "csv") -> DataFrame:
    r = spark.read.schema(schema)
    if fmt == "csv":
        return r.option("header", True).csv(path)
    if fmt == "json":
        return r.json(path)
    return r.parquet(path)


def round_trip(spark: SparkSession, df: DataFrame, path: str, fmt: str) -> DataFrame:
    """Write an export and read it back with the DataFrame's own schema."""
    write_export(df, path, fmt)
    return read_export(spark, path, df.schema, fmt)
