"""Feed sources and landed files.

Landed snapshots are read with explicit schemas (never inferred); the parcel
key is always a string.  Per-parcel "newest N" reads are computed for all
parcels at once with one window top-N.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from parcelwise.functions import rules as R
from parcelwise.operators.windows import spread_join, top_n_per_key

FEED_CSV_SCHEMA = T.StructType([
    T.StructField("bbl", T.StringType()),
    T.StructField("total_violations", T.LongType()),
    T.StructField("class_b_violations", T.LongType()),
    T.StructField("relevant_311_complaints", T.LongType()),
    T.StructField("compliance_risk_score", T.DoubleType()),
    T.StructField("data_freshness_date", T.DateType()),
    T.StructField("data_coverage_days", T.IntegerType()),
])

LEDGER_SCHEMA = T.StructType([
    T.StructField("email", T.StringType()),
    T.StructField("api_key", T.StringType()),
    T.StructField("tier", T.StringType()),
    T.StructField("requests_used", T.LongType()),
    T.StructField("month_start", T.StringType()),
])


def dataset_slice(df: DataFrame, date_col: str, since: str, limit: int | None = None) -> DataFrame:
    """S3: the whole slice since a date, newest first; ``limit`` is a caller's page size."""
    out = df.filter(F.col(date_col) >= F.lit(since).cast("date")).orderBy(
        F.desc(date_col), *[F.asc(c) for c in df.columns if c != date_col])
    return out if limit is None else out.limit(limit)


def dob_feed(violations: DataFrame, properties: DataFrame, newest: int | None = None) -> DataFrame:
    """The building-department feed projection: 8 string-ish columns per parcel.  ``newest``: only so many of a
    property's newest records, cut before the join, when no more of a parcel are wanted."""
    cat = (F.when(F.col("violation_class") == "C", "IMMEDIATELY HAZARDOUS")
           .when(F.col("violation_class") == "B", "HAZARDOUS").otherwise("NON-HAZARDOUS"))
    p = properties.select("property_id", "bbl", F.col("address").alias("respondent_name"))
    rows = violations.filter(F.col("source") == "DOB").select(
        "property_id",
        F.concat_ws("-", "order_key", "line_no").alias("violation_number"),
        F.col("violation_class").alias("violation_type"),
        F.col("issued_date").cast("string").alias("issue_date"),
        cat.alias("violation_category"),
        F.col("resolved_date").cast("string").alias("disposition_date"),
        F.when(F.col("is_resolved"), "RESOLVED").alias("disposition"),
        F.col("fine_amount").cast("string").alias("penalty_imposed"))
    if newest is not None:
        rows = top_n_per_key(rows, ["property_id"], [F.col(c).desc() if c == "issue_date" else F.col(c).asc() for c in DOB_ORDER
                                                     if c != "respondent_name"], newest, rank_col=None)
    return rows.join(p, "property_id").select(
        "bbl", "violation_number", "violation_type", "issue_date", "violation_category", "respondent_name", "disposition_date",
        "disposition", "penalty_imposed")


DOB_ORDER = ["issue_date", "violation_number", "violation_category", "penalty_imposed", "respondent_name", "disposition_date"]


def dob_violations(feed: DataFrame, limit: int = 50) -> DataFrame:
    """S4 for every parcel: reject keys that are not 10 chars, newest ``limit`` per
    parcel, date prefix, title-cased respondent, class from the category."""
    valid = feed.filter(F.length("bbl") == 10)
    order = [F.col(c).desc() if c == "issue_date" else F.col(c).asc() for c in DOB_ORDER]
    top = top_n_per_key(valid, ["bbl"], order, limit)
    return top.select(
        "bbl", "violation_number", "violation_type",
        F.substring("issue_date", 1, 10).alias("issue_date"), "violation_category",
        F.initcap("respondent_name").alias("respondent_name"),
        F.substring("disposition_date", 1, 10).alias("disposition_date"), "disposition", "penalty_imposed",
        R.classify_category("violation_category").alias("violation_class"), "rank")


def property_bundle(keys: DataFrame, feeds: dict[str, DataFrame | None], limit: int | None = None,
                    split: dict[str, str] | None = None) -> DataFrame:
    """Per parcel one array of records a feed, each with all rows of that feed, newest
    first, or a caller's newest ``limit``.  ``None`` marks a failed feed (→ empty array); feeds left out
    of ``feeds`` are absent.  With ``split`` (feed name → value of the ``feed`` column) the feed
    ``"*"`` holds several feeds, taken apart in one pass."""
    out = keys.select("bbl").distinct()
    for name, f in feeds.items():
        if f is None:
            out = out.withColumn(name, F.array())
            continue
        parts = split if name == "*" else {name: None}
        fields = ["ts"] + [c for c in f.columns if c not in ("bbl", "ts", "feed")]
        key = ["bbl", "feed"] if name == "*" else ["bbl"]
        rows = f if limit is None else top_n_per_key(
            f, key, [F.desc("ts")] + [F.asc(c) for c in fields[1:]], limit, rank_col=None)
        record = F.struct(*fields)
        packed = rows.groupBy("bbl").agg(*[
            F.sort_array(F.collect_list(record if value is None else F.when(F.col("feed") == value, record)), asc=False)
            .alias(part) for part, value in parts.items()])
        out = out.join(packed, "bbl", "left")
        for part in parts:
            out = out.withColumn(part, F.coalesce(F.col(part), F.array()))
    return out


def bundle_pages(keys: DataFrame, records: DataFrame, page_rows: int = 100) -> DataFrame:
    """S7/J7 in long form: (bbl, feed, page, records), each page at most ``page_rows`` records, newest first.

    ``keys``: (property_id, bbl); ``records``: (property_id, feed, ts, record text).  A parcel's records are numbered in two
    levels, running counts over its days and a rank inside each day, and no array holds more than a page, so
    a parcel with a third of all records is spread over its days and pages."""
    rows = spread_join(records, keys.select("property_id", "bbl"), "property_id", ["ts", "record"]).select("bbl", "feed", "ts", "record") \
        .withColumn("_day", F.to_date("ts"))
    key = ["bbl", "feed"]
    newer = Window.partitionBy(*key).orderBy(F.col("_day").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy(*key, "_day").agg(F.count(F.lit(1)).alias("_n")) \
        .select(*[F.col(c).alias(f"_{c}") for c in key], F.col("_day").alias("_at"), F.coalesce(F.sum("_n").over(newer), F.lit(0)).alias("_before"))
    same = F.col("bbl").eqNullSafe(F.col("_bbl")) & F.col("feed").eqNullSafe(F.col("_feed")) & F.col("_day").eqNullSafe(F.col("_at"))
    inside = Window.partitionBy(*key, "_day").orderBy(F.col("ts").desc_nulls_last(), "record")
    at = rows.withColumn("_rank", F.row_number().over(inside) - 1).join(days, same).withColumn("_place", F.col("_before") + F.col("_rank"))
    pages = at.groupBy(*key, F.floor(F.col("_place") / page_rows).cast("long").alias("page")).agg(
        F.count(F.lit(1)).alias("n_records"), F.sort_array(F.collect_list(F.struct("_place", "record"))).alias("records"))
    return pages.withColumn("records", F.transform("records", lambda r: r["record"]))


def read_feed_csv(spark: SparkSession, path: str, fallback: str | None = None) -> DataFrame:
    """Read the landed feed with its schema; a missing file falls back to the demo file."""
    try:
        return spark.read.schema(FEED_CSV_SCHEMA).option("header", True).csv(path)
    except Exception:  # noqa: BLE001 — path does not exist
        if fallback is None:
            raise
        return spark.read.schema(FEED_CSV_SCHEMA).option("header", True).csv(fallback)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The usage ledger; a missing file is an empty ledger."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).json(path)
    except Exception:  # noqa: BLE001
        return spark.createDataFrame([], LEDGER_SCHEMA)
