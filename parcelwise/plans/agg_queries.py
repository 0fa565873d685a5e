"""Registered batch queries: summaries and portfolio aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelwise.functions import rules as R
from parcelwise.operators import aggs as A
from parcelwise.operators import scoring as S
from parcelwise.plans.more_queries import EVENT_AS_OF, PROPERTY_SCORE_SQL, VIOLATION_AS_OF
from parcelwise.plans.registry import query
from parcelwise.plans.sqlviews import inspector_sql
from parcelwise.sources.tables import Tables


def _v(spark, d):
    return Tables(spark, d).views


SUMMARY_SQL = """
SELECT property_id, CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE COALESCE(violation_class, 'A') = 'A') AS BIGINT) AS class_a,
       CAST(count(*) FILTER (WHERE violation_class = 'B') AS BIGINT) AS class_b,
       CAST(count(*) FILTER (WHERE violation_class = 'C') AS BIGINT) AS class_c,
       CAST(count(*) FILTER (WHERE NOT is_resolved) AS BIGINT) AS open,
       CAST(count(*) FILTER (WHERE is_resolved) AS BIGINT) AS resolved,
       COALESCE(round_even(sum(CASE WHEN is_resolved THEN resolved_date - issued_date END)
                / NULLIF(count(*) FILTER (WHERE is_resolved), 0), 1), 0.0::DOUBLE) AS avg_days_open
FROM violations GROUP BY property_id"""


@query("violation_summary", SUMMARY_SQL)
def q_violation_summary(spark, d):
    return A.violation_summary(_v(spark, d).violations())


@query("property_risk_level", f"""
SELECT property_id, COALESCE(total, 0) AS total, COALESCE(open, 0) AS open, COALESCE(class_b, 0) AS class_b,
       COALESCE(class_c, 0) AS class_c,
       CASE WHEN class_c > 0 THEN 'CRITICAL' WHEN class_b > 2 THEN 'HIGH' WHEN open > 5 THEN 'MEDIUM'
            WHEN total > 0 THEN 'LOW' ELSE 'CLEAN' END AS risk_level
FROM properties LEFT JOIN ({SUMMARY_SQL}) s USING (property_id)""")
def q_property_risk_level(spark, d):
    v = _v(spark, d)
    return A.property_risk_level(A.violation_summary(v.violations()), v.properties())


@query("portfolio_violation_summary", f"""
WITH s AS ({SUMMARY_SQL})
SELECT p.tenant_id, CAST(count(*) AS BIGINT) AS properties_checked,
       CAST(COALESCE(sum(total), 0) AS BIGINT) AS total, CAST(COALESCE(sum(open), 0) AS BIGINT) AS open,
       CAST(COALESCE(sum(class_a), 0) AS BIGINT) AS class_a, CAST(COALESCE(sum(class_b), 0) AS BIGINT) AS class_b,
       CAST(COALESCE(sum(class_c), 0) AS BIGINT) AS class_c
FROM properties p LEFT JOIN s ON p.property_id = s.property_id
WHERE p.bbl IS NOT NULL AND p.bbl <> ''
GROUP BY p.tenant_id""")
def q_portfolio_violation_summary(spark, d):
    v = _v(spark, d)
    return A.portfolio_violation_summary(v.properties(), A.violation_summary(v.violations()))


@query("portfolio_era_stats", """
WITH b AS (SELECT tenant_id, year_built IS NOT NULL AND year_built <> 0 AND year_built < 1974 AS p74,
                  year_built IS NOT NULL AND year_built <> 0 AND year_built < 1960 AS p60 FROM properties),
a AS (SELECT tenant_id, CAST(count(*) AS BIGINT) AS total_buildings,
             CAST(count(*) FILTER (WHERE p74) AS BIGINT) AS pre1974_count,
             CAST(count(*) FILTER (WHERE p60) AS BIGINT) AS pre1960_count,
             sum(CASE WHEN p60 THEN 3.8::DOUBLE WHEN p74 THEN 2.5::DOUBLE ELSE 1.0::DOUBLE END) AS m
      FROM b GROUP BY tenant_id)
SELECT tenant_id, total_buildings, pre1974_count, pre1960_count,
       round_even(pre1974_count / total_buildings * 100, 1) AS pre1974_percentage,
       round_even(m / total_buildings, 2) AS average_multiplier,
       pre1960_count AS high_risk_count,
       CASE WHEN pre1960_count > 0 THEN 'CRITICAL' WHEN pre1974_count > 0 THEN 'ELEVATED' ELSE 'STANDARD' END
         AS portfolio_risk_level
FROM a""")
def q_portfolio_era_stats(spark, d):
    return A.portfolio_era_stats(_v(spark, d).properties())


@query("portfolio_inspector_stats", f"""
WITH b AS (SELECT tenant_id, council_district, {inspector_sql('bbl', 'council_district')} AS m FROM properties),
s AS (SELECT tenant_id, CAST(count(*) AS BIGINT) AS total_buildings,
             CAST(count(*) FILTER (WHERE m > 1.4) AS BIGINT) AS hotspot_count, sum(m) AS sm
      FROM b GROUP BY tenant_id),
dc AS (SELECT tenant_id, council_district, count(*) AS n FROM b WHERE council_district IS NOT NULL
       GROUP BY tenant_id, council_district),
mode AS (SELECT tenant_id, council_district AS highest_risk_district FROM (
           SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY n DESC, council_district) AS rn FROM dc)
         WHERE rn = 1)
SELECT s.tenant_id, total_buildings, hotspot_count,
       round_even(hotspot_count / total_buildings * 100, 1) AS hotspot_percentage,
       round_even(sm / total_buildings, 2) AS average_multiplier, highest_risk_district,
       CASE WHEN sm / total_buildings > 1.5 THEN 'ELEVATED' ELSE 'STANDARD' END AS portfolio_risk
FROM s LEFT JOIN mode ON s.tenant_id = mode.tenant_id""")
def q_portfolio_inspector_stats(spark, d):
    return A.portfolio_inspector_stats(_v(spark, d).properties())


@query("dashboard_metrics", f"""
WITH pp AS (SELECT property_id, count(*) AS n, count(*) FILTER (WHERE risk_score >= 7.0) AS n_high,
                   count(*) FILTER (WHERE issued_date >= DATE '{VIOLATION_AS_OF}' - 30) AS n_30d,
                   sum(CASE WHEN NOT is_resolved THEN quantity END) AS q_open,
                   count(*) FILTER (WHERE NOT is_resolved) AS n_open
            FROM violations GROUP BY property_id),
a AS (SELECT p.tenant_id, CAST(count(*) AS BIGINT) AS total_properties,
             CAST(count(*) FILTER (WHERE p.is_monitored) AS BIGINT) AS monitored_properties,
             CAST(COALESCE(sum(n), 0) AS BIGINT) AS total_violations,
             CAST(count(*) FILTER (WHERE n_high > 0) AS BIGINT) AS high_risk_properties,
             CAST(COALESCE(sum(n_30d), 0) AS BIGINT) AS violations_last_30_days,
             sum(q_open) AS q, sum(n_open) AS nn
      FROM properties p LEFT JOIN pp ON p.property_id = pp.property_id GROUP BY p.tenant_id)
SELECT tenant_id, total_properties, monitored_properties, total_violations, high_risk_properties,
       violations_last_30_days, COALESCE(round_even(q / 5.0::DOUBLE / NULLIF(nn, 0), 6), 0.0::DOUBLE) AS avg_risk_score
FROM a""")
def q_dashboard_metrics(spark, d):
    v = _v(spark, d)
    return A.dashboard_metrics(v.properties(), v.violations(), VIOLATION_AS_OF)


@query("violation_stats", """
SELECT p.tenant_id, CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE is_resolved) AS BIGINT) AS resolved,
       CAST(count(*) FILTER (WHERE risk_score >= 7.0) AS BIGINT) AS high_risk,
       CAST(count(*) - count(*) FILTER (WHERE is_resolved) AS BIGINT) AS pending
FROM violations v JOIN properties p ON v.property_id = p.property_id GROUP BY p.tenant_id""")
def q_violation_stats(spark, d):
    v = _v(spark, d)
    return A.violation_stats(v.properties(), v.violations())


@query("violations_by_class", """
SELECT p.tenant_id, v.violation_class, CAST(count(*) AS BIGINT) AS violations
FROM violations v JOIN properties p ON v.property_id = p.property_id GROUP BY p.tenant_id, v.violation_class""")
def q_violations_by_class(spark, d):
    v = _v(spark, d)
    return A.violations_by(v.properties(), v.violations(), "violation_class")


@query("violations_by_source", """
SELECT p.tenant_id, v.source, CAST(count(*) AS BIGINT) AS violations
FROM violations v JOIN properties p ON v.property_id = p.property_id GROUP BY p.tenant_id, v.source""")
def q_violations_by_source(spark, d):
    v = _v(spark, d)
    return A.violations_by(v.properties(), v.violations(), "source")


def _map_sql(dim: str) -> str:
    return f"""
SELECT tenant_id, string_agg({dim} || ':' || n, ',' ORDER BY {dim}) AS counts
FROM (SELECT p.tenant_id, v.{dim}, count(*) AS n FROM violations v JOIN properties p ON v.property_id = p.property_id
      WHERE v.{dim} IS NOT NULL GROUP BY 1, 2) GROUP BY tenant_id"""


def _map_text(spark, d, dim):
    """A12 as maps, printed in key order."""
    v = _v(spark, d)
    by = A.violations_by_map(A.violations_by(v.properties(), v.violations(), dim), dim)
    entries = F.array_sort(F.map_entries(f"by_{dim}"))
    return by.select("tenant_id", F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
                     .alias("counts"))


@query("violations_by_class_map", _map_sql("violation_class"))
def q_violations_by_class_map(spark, d):
    return _map_text(spark, d, "violation_class")


@query("violations_by_source_map", _map_sql("source"))
def q_violations_by_source_map(spark, d):
    return _map_text(spark, d, "source")


EXPOSURE_SQL = """
SELECT property_id, count(*) AS open_violations, count(*) FILTER (WHERE violation_class = 'C') AS class_c,
       sum(CASE violation_class WHEN 'C' THEN 5000 WHEN 'B' THEN 2500 WHEN 'A' THEN 500 ELSE 0 END) AS exposure
FROM violations WHERE NOT is_resolved GROUP BY property_id"""


def _avg2_sql(c: str) -> str:
    return f"round_even(sum(CAST(round({c} * 100) AS BIGINT)) / count({c}) / 100.0::DOUBLE, 2)"


@query("portfolio_risk_summary", f"""
WITH s AS ({PROPERTY_SCORE_SQL}), e AS ({EXPOSURE_SQL})
SELECT p.tenant_id, CAST(count(*) AS BIGINT) AS total_buildings, CAST(COALESCE(sum(p.units), 0) AS BIGINT) AS total_units,
       CAST(COALESCE(sum(e.exposure), 0) AS BIGINT) AS total_exposure,
       CAST(COALESCE(sum(e.open_violations), 0) AS BIGINT) AS total_violations,
       CAST(COALESCE(sum(e.class_c), 0) AS BIGINT) AS total_class_c,
       COALESCE({_avg2_sql('s.risk_score')}, 0.0::DOUBLE) AS avg_risk
FROM properties p LEFT JOIN s ON p.property_id = s.property_id LEFT JOIN e ON p.property_id = e.property_id
GROUP BY p.tenant_id""")
def q_portfolio_risk_summary(spark, d):
    v = _v(spark, d)
    vio = v.violations()
    return A.portfolio_risk_summary(v.properties(), S.property_scores(vio), S.fine_exposure(vio))


@query("era_cohorts", f"""
WITH s AS ({PROPERTY_SCORE_SQL}),
j AS (SELECT CASE WHEN year_built IS NULL THEN 'unknown' WHEN year_built < 1974 THEN 'pre1974' ELSE '1974+' END
               AS cohort, s.risk_score
      FROM properties p LEFT JOIN s ON p.property_id = s.property_id),
a AS (SELECT cohort, CAST(count(*) AS BIGINT) AS buildings, {_avg2_sql('risk_score')} AS avg_risk
      FROM j GROUP BY cohort)
SELECT cohort, buildings, round_even(buildings / sum(buildings) OVER () * 100, 1) AS share_pct, avg_risk FROM a""")
def q_era_cohorts(spark, d):
    v = _v(spark, d)
    return A.era_cohorts(v.properties(), S.property_scores(v.violations()))


@query("portfolio_extremes", f"""
WITH s AS ({PROPERTY_SCORE_SQL}), e AS ({EXPOSURE_SQL}),
j AS (SELECT p.tenant_id, p.property_id, COALESCE(s.risk_score, 0.0::DOUBLE) AS risk_score,
             CAST(COALESCE(e.exposure, 0) AS BIGINT) AS exposure
      FROM properties p LEFT JOIN s ON p.property_id = s.property_id LEFT JOIN e ON p.property_id = e.property_id),
r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY risk_score DESC, property_id) AS r1,
                row_number() OVER (PARTITION BY tenant_id ORDER BY exposure DESC, property_id) AS r2 FROM j)
SELECT tenant_id,
       max(CASE WHEN r1 = 1 THEN property_id END) AS highest_risk_property, max(risk_score) AS highest_risk_score,
       max(CASE WHEN r2 = 1 THEN property_id END) AS most_exposure_property, max(exposure) AS most_exposure
FROM r GROUP BY tenant_id""")
def q_portfolio_extremes(spark, d):
    v = _v(spark, d)
    vio = v.violations()
    return A.portfolio_extremes(v.properties(), S.property_scores(vio), S.fine_exposure(vio))


OUTREACH_SQL = f"""
WITH s AS ({PROPERTY_SCORE_SQL}),
j AS (SELECT p.tenant_id, COALESCE(p.year_built, 2000) AS y, s.risk_score
      FROM properties p LEFT JOIN s ON p.property_id = s.property_id),
a AS (SELECT tenant_id, CAST(count(*) AS BIGINT) AS total_buildings,
             CAST(count(*) FILTER (WHERE COALESCE(risk_score, 0.0) >= 70) AS BIGINT) AS high_risk_count,
             CAST(count(*) FILTER (WHERE y < 1974) AS BIGINT) AS pre1974_count,
             CAST(count(*) FILTER (WHERE y < 1960) AS BIGINT) AS pre1960_count
      FROM j GROUP BY tenant_id)
SELECT *, pre1960_count * 15000 AS winter_risk_low, pre1960_count * 15000 * 1.5::DOUBLE AS winter_risk_high,
       high_risk_count * 8000 AS annual_risk_low, high_risk_count * 8000 * 2 AS annual_risk_high,
       pre1960_count * 15000 AS page_winter_low, pre1960_count * 25000 AS page_winter_high,
       pre1974_count * 5000 AS page_annual_low, pre1974_count * 15000 AS page_annual_high
FROM a"""


@query("outreach_summary", OUTREACH_SQL)
def q_outreach_summary(spark, d):
    v = _v(spark, d)
    return A.outreach_summary(v.properties(), S.property_scores(v.violations()))


@query("business_stats", """
WITH a AS (SELECT CAST(count(*) AS BIGINT) AS total_users,
                  CAST(count(*) FILTER (WHERE tier = 'pro') AS BIGINT) AS pro_users,
                  CAST(count(*) FILTER (WHERE tier = 'enterprise') AS BIGINT) AS enterprise_users FROM accounts)
SELECT *, pro_users * 297 + enterprise_users * 999 AS mrr,
       round_even((pro_users * 297 + enterprise_users * 999) * 0.85::DOUBLE, 0) AS estimated_profit
FROM a""")
def q_business_stats(spark, d):
    return A.business_stats(_v(spark, d).accounts())


@query("heat_alert_count", f"""
WITH hc AS (SELECT property_id, count(*) AS n FROM complaints
            WHERE complaint_type = 'HEAT/HOT WATER' AND created >= TIMESTAMP '{EVENT_AS_OF}' - INTERVAL 30 DAY
            GROUP BY property_id)
SELECT p.tenant_id, CAST(count(*) FILTER (WHERE COALESCE(hc.n, 0) >= 3) AS BIGINT) AS buildings_alerting,
       CAST(count(*) AS BIGINT) AS buildings
FROM properties p LEFT JOIN hc ON p.property_id = hc.property_id GROUP BY p.tenant_id""")
def q_heat_alert_count(spark, d):
    v = _v(spark, d)
    return A.heat_alert_count(v.properties(), S.complaint_counts(v.complaints(types=["HEAT/HOT WATER"]), EVENT_AS_OF, 30))


@query("high_risk_properties", """
SELECT tenant_id, property_id, bbl FROM properties p
WHERE EXISTS (SELECT 1 FROM violations v WHERE v.property_id = p.property_id AND v.risk_score >= 7.0)""")
def q_high_risk_properties(spark, d):
    v = _v(spark, d)
    return A.high_risk_properties(v.properties(), v.violations())


@query("scan_result", """
WITH pp AS (SELECT property_id, count(*) AS n FROM violations GROUP BY property_id)
SELECT p.tenant_id, CAST(count(*) AS BIGINT) AS properties_scanned, CAST(COALESCE(sum(n), 0) AS BIGINT) AS violations_found
FROM properties p LEFT JOIN pp ON p.property_id = pp.property_id WHERE p.is_monitored GROUP BY p.tenant_id""")
def q_scan_result(spark, d):
    v = _v(spark, d)
    targets = v.properties().filter(F.col("is_monitored"))
    return A.scan_result(targets, v.violations())


@query("scan_targets", "SELECT tenant_id, property_id, bbl FROM properties WHERE is_monitored")
def q_scan_targets(spark, d):
    """F6 scan_all: every monitored property (an id list is a left semi join, see portfolio_semi)."""
    return _v(spark, d).properties().filter(F.col("is_monitored")).select("tenant_id", "property_id", "bbl")


@query("outreach_email", f"""
WITH o AS ({OUTREACH_SQL})
SELECT tenant_id, CASE WHEN pre1974_count > 0 THEN 'Hi ' || tenant_id || ',' ELSE 'Hello,' END || E'\\n\\n'
       || E'I ran your NYC property portfolio through a risk analysis.\\n\\n**Your Portfolio: ' || total_buildings
       || E' Buildings**\\n\\nKey Findings:\\n• ' || high_risk_count || E' HIGH-RISK buildings (violation probability ≥70%)\\n• '
       || pre1974_count || E' PRE-1974 buildings (2.5x - 3.8x elevated risk)\\n'
       || E'• Winter heat season = $10K-$25K Class C fine exposure\\n\\n**See attached detailed risk report.**\\n\\n'
       || E'Want a 7-day free trial? Just reply to this email.\\n' AS email
FROM o""")
def q_outreach_email(spark, d):
    """The outreach message per tenant; tenants with old buildings are greeted by name."""
    v = _v(spark, d)
    summary = A.outreach_summary(v.properties(), S.property_scores(v.violations()))
    named = summary.withColumn("recipient", F.when(F.col("pre1974_count") > 0, F.col("tenant_id")))
    return A.outreach_email(named, "recipient")
