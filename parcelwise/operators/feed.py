"""The scored feed: per-parcel violation and complaint counts, joined and scored.

Plan shape (per parcel key ``bbl``):

    violations --partial agg by property_id--> shuffle --> join properties --> agg by bbl \
                                                                                   full outer join --> score
    complaints --filter types--partial agg by property_id--> ... --> agg by bbl            /

Aggregating on ``property_id`` *before* the dimension join shrinks the large
side to one row per property before any exchange; the parcel key is only
attached to the aggregate.  A hot property only inflates one partial
aggregate per map task (map-side combine), never one reducer's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from parcelwise.functions import dims as D
from parcelwise.functions import rules as R


def _keyed(df: DataFrame, properties: DataFrame) -> DataFrame:
    """Attach the parcel key; null/blank keys are dropped (never grouped as a parcel)."""
    p = properties.select("property_id", "bbl").filter(F.col("bbl").isNotNull() & (F.trim("bbl") != ""))
    return df.join(p, "property_id")


def recent_hpd(violations: DataFrame, as_of: str | None, days_back: int | None) -> DataFrame:
    """Housing violations since the cutoff, class upper-cased and trimmed."""
    v = violations.filter(F.col("source") == "HPD")
    if as_of is not None and days_back is not None:
        v = v.filter(F.col("issued_date") >= F.date_sub(F.lit(as_of).cast("date"), days_back))
    return v.withColumn("violation_class", F.upper(F.trim("violation_class")))


def hpd_violations(violations: DataFrame, as_of: str | None = None,
                   days_back: int | None = D.FEED_DAYS_BACK, classes=("A", "B", "C")) -> DataFrame:
    """Recent housing violations of class A/B/C; when that slice is empty the
    class filter is dropped (the feed's retry).  Class is upper-cased and trimmed."""
    v = recent_hpd(violations, as_of, days_back)
    wanted = F.coalesce(F.col("violation_class").isin(*classes), F.lit(False))
    some = F.coalesce(v.agg(F.max(wanted)).scalar(), F.lit(False))       # a scalar subquery: no action while building
    return v.filter(wanted | ~some)


def relevant_complaints(complaints: DataFrame, as_of: str | None = None,
                        days_back: int | None = None) -> DataFrame:
    """Heat / plumbing complaints since the cutoff."""
    c = complaints.filter(F.col("complaint_type").isin(*D.RELEVANT_311_TYPES))
    if as_of is not None and days_back is not None:
        c = c.filter(F.col("created") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days_back)} DAYS"))
    return c


def violations_agg(violations: DataFrame, properties: DataFrame) -> DataFrame:
    """J1 fused: total and class-B counts per parcel in one aggregate."""
    per_prop = violations.groupBy("property_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("violation_class") == "B").alias("nb"))
    return (_keyed(per_prop, properties).groupBy("bbl")
            .agg(F.sum("n").alias("total_violations"), F.sum("nb").alias("class_b_violations")))


def complaints_agg(complaints: DataFrame, properties: DataFrame) -> DataFrame:
    """A1: complaints per parcel."""
    per_prop = complaints.groupBy("property_id").agg(F.count(F.lit(1)).alias("n"))
    return _keyed(per_prop, properties).groupBy("bbl").agg(F.sum("n").alias("relevant_311_complaints"))


def feed_joined(v_agg: DataFrame, c_agg: DataFrame) -> DataFrame:
    """J2 + F11: full outer join on the parcel key, missing counts become 0."""
    return (v_agg.join(c_agg, "bbl", "full")
            .select("bbl",
                    F.coalesce("total_violations", F.lit(0)).alias("total_violations"),
                    F.coalesce("class_b_violations", F.lit(0)).alias("class_b_violations"),
                    F.coalesce("relevant_311_complaints", F.lit(0)).alias("relevant_311_complaints")))


def feed_scored(violations: DataFrame, complaints: DataFrame, properties: DataFrame,
                as_of: str | None = None, coverage_days: int | None = None) -> DataFrame:
    """Compliance score per parcel.  The parcel key is unique after the
    full outer join of two per-parcel aggregates, so T1's keep-first dedup is
    satisfied by construction (no extra shuffle)."""
    j = feed_joined(violations_agg(violations, properties),
                    complaints_agg(relevant_complaints(complaints), properties))
    out = j.withColumn("compliance_risk_score",
                       R.compliance_score("class_b_violations", "relevant_311_complaints", "total_violations"))
    if as_of is not None:
        out = out.withColumn("data_freshness_date", F.lit(as_of).cast("date"))
    if coverage_days is not None:
        out = out.withColumn("data_coverage_days", F.lit(int(coverage_days)))
    return out


def top_scored(scored: DataFrame, n: int) -> DataFrame:
    """Top-n by score (ties by key) — a distributed TakeOrderedAndProject."""
    return scored.orderBy(F.desc("compliance_risk_score"), F.asc("bbl")).limit(n)


def anonymised_demo(scored: DataFrame, n: int = 50) -> DataFrame:
    """K3: top-n with the parcel key replaced by SAMPLE-%04d of its rank.
    The window runs over the n rows the top-k already selected."""
    top = top_scored(scored, n)
    w = Window.orderBy(F.desc("compliance_risk_score"), F.asc("bbl"))
    return (top.withColumn("rank", F.row_number().over(w))
            .withColumn("bbl", F.format_string("SAMPLE-%04d", F.col("rank"))))


def feed_summary(scored: DataFrame) -> DataFrame:
    """Totals, counts with >0, max and mean score."""
    return scored.agg(
        F.count(F.lit(1)).alias("total_properties"),
        F.sum("total_violations").alias("sum_violations"),
        F.sum("class_b_violations").alias("sum_class_b"),
        F.sum("relevant_311_complaints").alias("sum_complaints"),
        F.count_if(F.col("total_violations") > 0).alias("with_violations"),
        F.count_if(F.col("class_b_violations") > 0).alias("with_class_b"),
        F.count_if(F.col("relevant_311_complaints") > 0).alias("with_complaints"),
        F.max("compliance_risk_score").alias("max_score"),
        F.bround(F.avg("compliance_risk_score"), 4).alias("avg_score"),
    )
