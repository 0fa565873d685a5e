"""Registered batch queries: the scored feed and its pieces (build step 2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelwise.functions import dims as D
from parcelwise.operators import feed
from parcelwise.operators import sinks as SK
from parcelwise.session import scratch_path
from parcelwise.plans.registry import query
from parcelwise.sources.tables import Tables

# Fixed clock of the driver's tables: violations end 2001-11-04, events end 2024-01-30.
VIOLATION_AS_OF = "2001-11-04"
EVENT_AS_OF = "2024-01-31"


def _v(spark, d):
    return Tables(spark, d).views


# The two feeds that are scored: housing violations of classes A to C (all classes when there are
# none of these) and heat and plumbing complaints, both of the last 90 days.
FEED_V_SQL = f"""
WITH recent AS (SELECT * EXCLUDE (violation_class), upper(trim(violation_class)) AS violation_class FROM violations
                WHERE source = 'HPD' AND issued_date >= DATE '{VIOLATION_AS_OF}' - 90),
feed_violations AS (SELECT * FROM recent WHERE violation_class IN ('A', 'B', 'C')
                    OR NOT EXISTS (SELECT 1 FROM recent WHERE violation_class IN ('A', 'B', 'C')))
SELECT p.bbl, CAST(count(*) AS BIGINT) AS total_violations,
       CAST(count(*) FILTER (WHERE v.violation_class = 'B') AS BIGINT) AS class_b_violations
FROM feed_violations v JOIN properties p ON v.property_id = p.property_id
WHERE p.bbl IS NOT NULL AND trim(p.bbl) <> ''
GROUP BY p.bbl"""

FEED_C_SQL = f"""
SELECT p.bbl, CAST(count(*) AS BIGINT) AS relevant_311_complaints
FROM complaints c JOIN properties p ON c.property_id = p.property_id
WHERE c.complaint_type IN ('HEAT/HOT WATER', 'PLUMBING') AND c.created >= TIMESTAMP '{EVENT_AS_OF}' - INTERVAL 90 DAY
  AND p.bbl IS NOT NULL AND trim(p.bbl) <> ''
GROUP BY p.bbl"""

FEED_SCORED_SQL = f"""
WITH va AS ({FEED_V_SQL}), ca AS ({FEED_C_SQL}),
j AS (
  SELECT COALESCE(va.bbl, ca.bbl) AS bbl,
         COALESCE(total_violations, 0) AS total_violations,
         COALESCE(class_b_violations, 0) AS class_b_violations,
         COALESCE(relevant_311_complaints, 0) AS relevant_311_complaints
  FROM va FULL OUTER JOIN ca ON va.bbl = ca.bbl)
SELECT *, round_even(class_b_violations * 2.0::DOUBLE + relevant_311_complaints * 1.5::DOUBLE
                     + total_violations * 0.5::DOUBLE, 2)
          AS compliance_risk_score,
       DATE '{VIOLATION_AS_OF}' AS data_freshness_date, CAST(90 AS INTEGER) AS data_coverage_days
FROM j"""


def feed_sources(v):
    """S1 and S2 of the views: the violations and complaints that the feed scores."""
    return (feed.hpd_violations(v.violations(), VIOLATION_AS_OF, D.FEED_DAYS_BACK),
            feed.relevant_complaints(v.complaints(types=D.RELEVANT_311_TYPES), EVENT_AS_OF, D.FEED_DAYS_BACK))


def scored(spark, d):
    v = _v(spark, d)
    return feed.feed_scored(*feed_sources(v), v.properties(), as_of=VIOLATION_AS_OF, coverage_days=D.FEED_DAYS_BACK)


@query("feed_scored", FEED_SCORED_SQL)
def q_feed_scored(spark, d):
    return scored(spark, d)


@query("feed_violations_agg", FEED_V_SQL)
def q_feed_violations_agg(spark, d):
    v = _v(spark, d)
    return feed.violations_agg(feed_sources(v)[0], v.properties())


@query("feed_complaints_agg", FEED_C_SQL)
def q_feed_complaints_agg(spark, d):
    v = _v(spark, d)
    return feed.complaints_agg(feed_sources(v)[1], v.properties())


@query("feed_joined", f"""
WITH va AS ({FEED_V_SQL}), ca AS ({FEED_C_SQL})
SELECT COALESCE(va.bbl, ca.bbl) AS bbl, COALESCE(total_violations, 0) AS total_violations,
       COALESCE(class_b_violations, 0) AS class_b_violations,
       COALESCE(relevant_311_complaints, 0) AS relevant_311_complaints
FROM va FULL OUTER JOIN ca ON va.bbl = ca.bbl""")
def q_feed_joined(spark, d):
    v = _v(spark, d)
    props = v.properties()
    violations, complaints = feed_sources(v)
    return feed.feed_joined(feed.violations_agg(violations, props), feed.complaints_agg(complaints, props))


@query("export_full", FEED_SCORED_SQL)
def q_export_full(spark, d):
    """K1: the full scored feed written as CSV to the shared folder and read back typed."""
    return SK.round_trip(spark, scored(spark, d), scratch_path(spark, "export-full"), "csv")


@query("export_sample", f"""
WITH s AS (SELECT * FROM ({FEED_SCORED_SQL}))
SELECT * FROM s ORDER BY compliance_risk_score DESC, bbl LIMIT 100""")
def q_export_sample(spark, d):
    """K2: top 100 by score, written as JSON records."""
    return SK.round_trip(spark, feed.top_scored(scored(spark, d), 100), scratch_path(spark, "export-sample"), "json")


@query("feed_summary", f"""
WITH s AS (SELECT * FROM ({FEED_SCORED_SQL}))
SELECT CAST(count(*) AS BIGINT) AS total_properties,
       CAST(sum(total_violations) AS BIGINT) AS sum_violations,
       CAST(sum(class_b_violations) AS BIGINT) AS sum_class_b,
       CAST(sum(relevant_311_complaints) AS BIGINT) AS sum_complaints,
       CAST(count(*) FILTER (WHERE total_violations > 0) AS BIGINT) AS with_violations,
       CAST(count(*) FILTER (WHERE class_b_violations > 0) AS BIGINT) AS with_class_b,
       CAST(count(*) FILTER (WHERE relevant_311_complaints > 0) AS BIGINT) AS with_complaints,
       max(compliance_risk_score) AS max_score,
       round_even(avg(compliance_risk_score), 4) AS avg_score
FROM s""")
def q_feed_summary(spark, d):
    return feed.feed_summary(scored(spark, d))


@query("feed_top3", f"""
WITH s AS (SELECT * FROM ({FEED_SCORED_SQL}))
SELECT bbl, compliance_risk_score, total_violations, class_b_violations, relevant_311_complaints
FROM s ORDER BY compliance_risk_score DESC, bbl LIMIT 3""")
def q_feed_top3(spark, d):
    """The three highest scores of the feed summary."""
    return feed.top_scored(scored(spark, d), 3).select("bbl", "compliance_risk_score", "total_violations",
                                                       "class_b_violations", "relevant_311_complaints")


@query("export_demo_anonymised", f"""
WITH s AS (SELECT * FROM ({FEED_SCORED_SQL})),
t AS (SELECT *, row_number() OVER (ORDER BY compliance_risk_score DESC, bbl) AS rank FROM s)
SELECT printf('SAMPLE-%04d', rank) AS bbl, total_violations, class_b_violations, relevant_311_complaints,
       compliance_risk_score, data_freshness_date, data_coverage_days, CAST(rank AS INTEGER) AS rank
FROM t WHERE rank <= 50""")
def q_export_demo(spark, d):
    """K3: top 50 with the parcel key replaced by its rank label, written as CSV."""
    return SK.round_trip(spark, feed.anonymised_demo(scored(spark, d), 50), scratch_path(spark, "export-demo"), "csv")
