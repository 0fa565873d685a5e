"""Summaries and portfolio aggregates.

A "portfolio" is a tenant's set of properties.  Every aggregate is computed
for all tenants at once with ``groupBy(tenant_id)``; per-property aggregates
are built first (partial aggregation map-side) so the property→tenant join
only ever sees one row per property.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from parcelwise.functions import dims as D
from parcelwise.functions import rules as R


def _cnt(cond: Column) -> Column:
    return F.count_if(cond)


def avg2(col) -> Column:
    """Mean of a 2-dp score, 2 dp half-even.  Summed as integer cents so the
    result does not depend on the order partial sums are combined in."""
    c = F.col(col) if isinstance(col, str) else col
    return F.bround(F.try_divide(F.sum(F.round(c * 100).cast("long")), F.count(c)) / 100.0, 2)


def violation_summary(violations: DataFrame) -> DataFrame:
    """A2 per property; avg_days_open divides by *all* resolved (Q5)."""
    days = F.datediff("resolved_date", "issued_date")
    return violations.groupBy("property_id").agg(
        F.count(F.lit(1)).alias("total"),
        _cnt(F.coalesce(F.col("violation_class"), F.lit("A")) == "A").alias("class_a"),
        _cnt(F.col("violation_class") == "B").alias("class_b"),
        _cnt(F.col("violation_class") == "C").alias("class_c"),
        _cnt(~F.col("is_resolved")).alias("open"),
        _cnt(F.col("is_resolved")).alias("resolved"),
        F.sum(F.when(F.col("is_resolved"), days)).alias("_days"),
    ).select("*", F.coalesce(F.bround(F.try_divide(F.col("_days"), F.col("resolved")), 1), F.lit(0.0))
             .alias("avg_days_open")).drop("_days")


def property_risk_level(summary: DataFrame, properties: DataFrame) -> DataFrame:
    """R13 over A2 for every property; one without violations is CLEAN."""
    every = properties.select("property_id").join(summary, "property_id", "left") \
        .na.fill(0, ["total", "open", "class_b", "class_c"])
    return every.select("property_id", "total", "open", "class_b", "class_c",
                          R.risk_level("class_c", "class_b", "open", "total").alias("risk_level"))


def portfolio_violation_summary(properties: DataFrame, summary: DataFrame) -> DataFrame:
    """A3: sums over a tenant's properties that have a parcel key."""
    p = properties.filter(F.col("bbl").isNotNull() & (F.col("bbl") != "")).select("tenant_id", "property_id")
    j = p.join(summary, "property_id", "left")
    z = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return j.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("properties_checked"),
                                      z("total"), z("open"), z("class_a"), z("class_b"), z("class_c"))


def portfolio_era_stats(properties: DataFrame) -> DataFrame:
    """A4 per tenant; no validity range, null/0 year is modern (Q2)."""
    y = F.col("year_built")
    truthy = y.isNotNull() & (y != 0)
    pre74, pre60 = truthy & (y < D.ELEVATED_YEAR), truthy & (y < D.CRITICAL_YEAR)
    agg = properties.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("total_buildings"),
        _cnt(pre74).alias("pre1974_count"),
        _cnt(pre60).alias("pre1960_count"),
        F.sum(R.portfolio_era_multiplier(y)).alias("_m"))
    return agg.select(
        "tenant_id", "total_buildings", "pre1974_count", "pre1960_count",
        F.bround(F.col("pre1974_count") / F.col("total_buildings") * 100, 1).alias("pre1974_percentage"),
        F.bround(F.col("_m") / F.col("total_buildings"), 2).alias("average_multiplier"),
        F.col("pre1960_count").alias("high_risk_count"),
        F.when(F.col("pre1960_count") > 0, "CRITICAL").when(F.col("pre1974_count") > 0, "ELEVATED")
         .otherwise("STANDARD").alias("portfolio_risk_level"))


def portfolio_inspector_stats(properties: DataFrame) -> DataFrame:
    """A5/A6 per tenant.  The most common district ties break on the district name."""
    m = R.inspector_multiplier("bbl", "council_district")
    base = properties.select("tenant_id", "council_district", m.alias("m"))
    stats = base.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("total_buildings"),
        _cnt(F.col("m") > 1.4).alias("hotspot_count"),
        F.sum("m").alias("_m"))
    mode = (base.filter(F.col("council_district").isNotNull())
            .groupBy("tenant_id", "council_district").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("tenant_id")
            .agg(F.min_by("council_district", F.struct(-F.col("n"), F.col("council_district")))
                 .alias("highest_risk_district")))
    avg = F.col("_m") / F.col("total_buildings")
    return (stats.join(mode, "tenant_id", "left").select(
        "tenant_id", "total_buildings", "hotspot_count",
        F.bround(F.col("hotspot_count") / F.col("total_buildings") * 100, 1).alias("hotspot_percentage"),
        F.bround(avg, 2).alias("average_multiplier"),
        "highest_risk_district",
        F.when(avg > 1.5, "ELEVATED").otherwise("STANDARD").alias("portfolio_risk")))


def dashboard_metrics(properties: DataFrame, violations: DataFrame, as_of: str) -> DataFrame:
    """A9 + A10 for every tenant: two aggregations and a join."""
    p = properties.select("tenant_id", "property_id", "is_monitored")
    per_prop = violations.groupBy("property_id").agg(
        F.count(F.lit(1)).alias("n"),
        _cnt(F.col("risk_score") >= D.HIGH_RISK_VIOLATION).alias("n_high"),
        _cnt(F.col("issued_date") >= F.date_sub(F.lit(as_of).cast("date"), 30)).alias("n_30d"),
        F.sum(F.when(~F.col("is_resolved"), F.col("quantity"))).alias("q_open"),
        _cnt(~F.col("is_resolved")).alias("n_open"))
    j = p.join(per_prop, "property_id", "left")
    agg = j.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("total_properties"),
        _cnt(F.col("is_monitored")).alias("monitored_properties"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_violations"),
        _cnt(F.col("n_high") > 0).alias("high_risk_properties"),
        F.coalesce(F.sum("n_30d"), F.lit(0)).alias("violations_last_30_days"),
        F.sum("q_open").alias("_q"), F.sum("n_open").alias("_n"))
    # mean of risk_score = quantity / 5 over unresolved; quantity sums are exact.
    return agg.select("tenant_id", "total_properties", "monitored_properties", "total_violations",
                      "high_risk_properties", "violations_last_30_days",
                      F.coalesce(F.bround(F.try_divide(F.col("_q") / 5.0, F.col("_n")), 6), F.lit(0.0))
                      .alias("avg_risk_score"))


def violation_stats(properties: DataFrame, violations: DataFrame) -> DataFrame:
    """A11 per tenant."""
    per = violations.groupBy("property_id").agg(
        F.count(F.lit(1)).alias("total"),
        _cnt(F.col("is_resolved")).alias("resolved"),
        _cnt(F.col("risk_score") >= D.HIGH_RISK_VIOLATION).alias("high_risk"))
    agg = (per.join(properties.select("property_id", "tenant_id"), "property_id").groupBy("tenant_id")
           .agg(*[F.sum(c).alias(c) for c in ("total", "resolved", "high_risk")]))
    return agg.withColumn("pending", F.col("total") - F.col("resolved"))


def violations_by(properties: DataFrame, violations: DataFrame, dim: str) -> DataFrame:
    """A12 long form: (tenant, class|source, count)."""
    per = violations.groupBy("property_id", dim).agg(F.count(F.lit(1)).alias("n"))
    return (per.join(properties.select("property_id", "tenant_id"), "property_id")
            .groupBy("tenant_id", dim).agg(F.sum("n").alias("violations")))


def violations_by_map(long_form: DataFrame, dim: str) -> DataFrame:
    """A12 as the API returns it: one ``map<string,bigint>`` per tenant (≤ a handful of keys; a NULL one is left out)."""
    return long_form.filter(F.col(dim).isNotNull()).groupBy("tenant_id").agg(
        F.map_from_entries(F.collect_list(F.struct(dim, "violations"))).alias(f"by_{dim}"))


def portfolio_risk_summary(properties: DataFrame, scores: DataFrame, exposure: DataFrame) -> DataFrame:
    """A14 per tenant: units, exposure, open violations, class C, mean risk (2 dp, 0 if none)."""
    j = (properties.select("tenant_id", "property_id", "units")
         .join(scores.select("property_id", "risk_score"), "property_id", "left")
         .join(exposure, "property_id", "left"))
    z = lambda c, a: F.coalesce(F.sum(c), F.lit(0)).alias(a)
    return j.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("total_buildings"), z("units", "total_units"), z("exposure", "total_exposure"),
        z("open_violations", "total_violations"), z("class_c", "total_class_c"),
        F.coalesce(avg2("risk_score"), F.lit(0.0)).alias("avg_risk"))


def era_cohorts(properties: DataFrame, scores: DataFrame) -> DataFrame:
    """Count, share and mean risk for <1974 vs ≥1974 (unknown year separate)."""
    y = F.col("year_built")
    cohort = F.when(y.isNull(), "unknown").when(y < D.ELEVATED_YEAR, "pre1974").otherwise("1974+")
    j = properties.select("property_id", cohort.alias("cohort")).join(scores, "property_id", "left")
    agg = j.groupBy("cohort").agg(F.count(F.lit(1)).alias("buildings"),
                                  avg2("risk_score").alias("avg_risk"))
    # The share window runs over the ≤3 cohort rows only.
    total = F.sum("buildings").over(Window.partitionBy())
    return agg.select("cohort", "buildings", F.bround(F.col("buildings") / total * 100, 1).alias("share_pct"),
                      "avg_risk")


def portfolio_extremes(properties: DataFrame, scores: DataFrame, exposure: DataFrame) -> DataFrame:
    """Highest-risk and most-exposed property per tenant (ties → smaller id)."""
    j = (properties.select("tenant_id", "property_id", "address")
         .join(scores.select("property_id", "risk_score"), "property_id", "left")
         .join(exposure.select("property_id", "exposure"), "property_id", "left")
         .fillna({"risk_score": 0.0, "exposure": 0}))
    return j.groupBy("tenant_id").agg(
        F.max_by("property_id", F.struct("risk_score", -F.col("property_id"))).alias("highest_risk_property"),
        F.max("risk_score").alias("highest_risk_score"),
        F.max_by("property_id", F.struct("exposure", -F.col("property_id"))).alias("most_exposure_property"),
        F.max("exposure").alias("most_exposure"))


def outreach_summary(properties: DataFrame, scores: DataFrame) -> DataFrame:
    """A18 per tenant: high-risk (≥70) count, era counts (missing year → 2000), loss ranges."""
    y = F.coalesce(F.col("year_built"), F.lit(2000))
    j = properties.select("tenant_id", "property_id", y.alias("y")).join(scores, "property_id", "left")
    agg = j.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("total_buildings"),
        _cnt(F.coalesce(F.col("risk_score"), F.lit(0.0)) >= D.HIGH_RISK_SCORE).alias("high_risk_count"),
        _cnt(F.col("y") < D.ELEVATED_YEAR).alias("pre1974_count"),
        _cnt(F.col("y") < D.CRITICAL_YEAR).alias("pre1960_count"))
    return agg.select(
        "*",
        (F.col("pre1960_count") * D.WINTER_LOSS_PER_PRE1960).alias("winter_risk_low"),
        (F.col("pre1960_count") * D.WINTER_LOSS_PER_PRE1960 * 1.5).alias("winter_risk_high"),
        (F.col("high_risk_count") * D.ANNUAL_LOSS_PER_HIGH_RISK).alias("annual_risk_low"),
        (F.col("high_risk_count") * D.ANNUAL_LOSS_PER_HIGH_RISK * 2).alias("annual_risk_high"),
        *[(F.col("pre1960_count") * x).alias(f"page_winter_{end}") for x, end in zip(D.WINTER_TEMPLATE_RANGE, ("low", "high"))],
        *[(F.col("pre1974_count") * x).alias(f"page_annual_{end}") for x, end in zip(D.ANNUAL_TEMPLATE_RANGE, ("low", "high"))])


def business_stats(accounts: DataFrame) -> DataFrame:
    """Users per tier, MRR, 85 % profit."""
    agg = accounts.agg(F.count(F.lit(1)).alias("total_users"),
                       _cnt(F.col("tier") == "pro").alias("pro_users"),
                       _cnt(F.col("tier") == "enterprise").alias("enterprise_users"))
    mrr = F.col("pro_users") * D.TIER_PRICE["pro"] + F.col("enterprise_users") * D.TIER_PRICE["enterprise"]
    return agg.select("*", mrr.alias("mrr"), F.bround(mrr * D.PROFIT_MARGIN, 0).alias("estimated_profit"))


def heat_alert_count(properties: DataFrame, heat_counts: DataFrame, threshold: int = 3) -> DataFrame:
    """Buildings with ≥ threshold heat complaints, per tenant."""
    j = properties.select("tenant_id", "property_id").join(heat_counts, "property_id", "left")
    return j.groupBy("tenant_id").agg(
        _cnt(F.coalesce(F.col("heat_complaints"), F.lit(0)) >= threshold).alias("buildings_alerting"),
        F.count(F.lit(1)).alias("buildings"))


def high_risk_properties(properties: DataFrame, violations: DataFrame) -> DataFrame:
    """Distinct properties with a violation of risk_score ≥ 7 (left semi join)."""
    hi = violations.filter(F.col("risk_score") >= D.HIGH_RISK_VIOLATION).select("property_id").distinct()
    return properties.select("tenant_id", "property_id", "bbl").join(hi, "property_id", "left_semi")


def scan_result(targets: DataFrame, violations: DataFrame) -> DataFrame:
    """A25 per tenant: properties scanned and violations found on them."""
    per = violations.groupBy("property_id").agg(F.count(F.lit(1)).alias("n"))
    j = targets.select("tenant_id", "property_id").join(per, "property_id", "left")
    return j.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("properties_scanned"),
                                      F.coalesce(F.sum("n"), F.lit(0)).alias("violations_found"))


# FIXED VALUES — wording of the outreach message (%d: buildings, high-risk, pre-1974)
OUTREACH_TEXT = (
    "I ran your NYC property portfolio through a risk analysis.\n\n"
    "**Your Portfolio: %d Buildings**\n\n"
    "Key Findings:\n"
    "• %d HIGH-RISK buildings (violation probability ≥70%%)\n"
    "• %d PRE-1974 buildings (2.5x - 3.8x elevated risk)\n"
    "• Winter heat season = $10K-$25K Class C fine exposure\n\n"
    "**See attached detailed risk report.**\n\n"
    "Want a 7-day free trial? Just reply to this email.\n")


def outreach_email(summary: DataFrame, recipient: str | None = None) -> DataFrame:
    """R22 (summary text): one outreach message per tenant from A18's counts; ``recipient`` names
    the column of the greeted person (missing or blank: a general greeting)."""
    name = F.trim(F.col(recipient)) if recipient else F.lit(None).cast("string")
    greeting = F.when(F.length(name) > 0, F.concat(F.lit("Hi "), name, F.lit(","))).otherwise("Hello,")
    body = F.format_string(OUTREACH_TEXT, F.col("total_buildings"), F.col("high_risk_count"), F.col("pre1974_count"))
    return summary.select("tenant_id", F.concat(greeting, F.lit("\n\n"), body).alias("email"))
