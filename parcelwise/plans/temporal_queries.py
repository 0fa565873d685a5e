"""Registered batch queries: interval / as-of joins (J13, J14) and report text."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelwise.functions import dims as D
from parcelwise.operators import scoring as S
from parcelwise.operators import temporal as T
from parcelwise.plans.more_queries import ERA_KEY_SQL, PROPERTY_SCORE_SQL, VIOLATION_AS_OF, _case_map
from parcelwise.plans.registry import query
from parcelwise.plans.sqlviews import era_mult_sql
from parcelwise.sources.tables import Tables


def _v(spark, d):
    return Tables(spark, d).views


def _heat(v):
    return (v.complaints(types=["HEAT/HOT WATER"]).filter(F.col("complaint_type") == "HEAT/HOT WATER")
            .select("unique_key", "property_id", "created"))


@query("complaint_conversion", """
WITH h AS (SELECT unique_key, property_id, created FROM complaints WHERE complaint_type = 'HEAT/HOT WATER'),
f AS (SELECT h.*, (SELECT min(issued) FROM class_c_events v WHERE v.property_id = h.property_id
                   AND v.issued >= h.created) AS nxt FROM h)
SELECT unique_key, property_id, created,
       CASE WHEN nxt <= created + INTERVAL 14 DAY THEN nxt END AS first_violation,
       COALESCE(nxt <= created + INTERVAL 14 DAY, false) AS converted,
       CASE WHEN nxt <= created + INTERVAL 14 DAY
            THEN round_even((epoch_us(nxt) - epoch_us(created)) / 3600000000.0::DOUBLE, 4) END AS lag_hours
FROM f""")
def q_complaint_conversion(spark, d):
    """Heat complaint → class-C violation on the same property within 14 days."""
    v = _v(spark, d)
    return T.conversion(_heat(v), v.class_c_events(), "property_id", "created", "issued", 14)


@query("complaint_conversion_rate", """
WITH h AS (SELECT unique_key, property_id, created FROM complaints WHERE complaint_type = 'HEAT/HOT WATER'),
f AS (SELECT h.*, (SELECT min(issued) FROM class_c_events v WHERE v.property_id = h.property_id
                   AND v.issued >= h.created) AS nxt FROM h),
c AS (SELECT property_id, COALESCE(nxt <= created + INTERVAL 14 DAY, false) AS conv,
             CASE WHEN nxt <= created + INTERVAL 14 DAY THEN epoch_us(nxt) - epoch_us(created) END AS lag FROM f)
SELECT property_id, CAST(count(*) AS BIGINT) AS complaints, CAST(count(*) FILTER (WHERE conv) AS BIGINT) AS converted,
       round_even(count(*) FILTER (WHERE conv) / count(*), 4) AS conversion_rate,
       round_even(sum(lag) / count(lag) / 3600000000.0::DOUBLE, 2) AS avg_lag_hours
FROM c GROUP BY property_id""")
def q_complaint_conversion_rate(spark, d):
    """J13 summary: share of heat complaints followed by a class-C record within 14 days, and the lag."""
    v = _v(spark, d)
    conv = T.conversion(_heat(v), v.class_c_events(), "property_id", "created", "issued", 14)
    return T.conversion_summary(conv, "property_id")


@query("snapshot_asof", """
WITH h AS (SELECT unique_key, property_id, created FROM complaints WHERE complaint_type = 'HEAT/HOT WATER'),
a AS (SELECT h.*, (SELECT max(issued) FROM class_c_events v WHERE v.property_id = h.property_id
                   AND v.issued <= h.created) AS snapshot_ts FROM h)
SELECT *, epoch_us(created) - epoch_us(snapshot_ts) > 7 * 86400000000 AS is_stale FROM a""")
def q_snapshot_asof(spark, d):
    """The freshest class-C record at or before each heat complaint; stale after 7 days."""
    v = _v(spark, d)
    return T.snapshot_asof(_heat(v), v.class_c_events(), "property_id", "created", "issued", 7 * 86400)


def _lines_sql(head: str, items: list[str]) -> str:
    return "\n".join([head, *[f"  • {i}" for i in items], ""])


@query("property_report_text", f"""
WITH s AS ({PROPERTY_SCORE_SQL}),
o AS (SELECT property_id, count(*) AS n FROM violations WHERE NOT is_resolved GROUP BY property_id)
SELECT p.property_id,
       p.address || E'\\n   BBL: ' || p.bbl || E'\\n   Risk Score: ' || printf('%.1f', round_even(COALESCE(s.risk_score, 0), 1))
       || '/100' || E'\\n   Year Built: ' || COALESCE(CAST(p.year_built AS VARCHAR), 'Unknown')
       || CASE WHEN p.year_built IS NOT NULL AND p.year_built < 1960 THEN E'\\n   Era Risk: 3.8x multiplier (Pre-1960)'
               WHEN p.year_built IS NOT NULL AND p.year_built < 1974 THEN E'\\n   Era Risk: 2.5x multiplier (Pre-1974)'
               ELSE '' END
       || CASE WHEN o.n > 0 THEN E'\\n   Active Violations: ' || o.n ELSE '' END AS report
FROM properties p LEFT JOIN s ON p.property_id = s.property_id LEFT JOIN o ON p.property_id = o.property_id""")
def q_property_report_text(spark, d):
    """The per-building block of the outreach report, for every building; active violations are the open ones."""
    v = _v(spark, d)
    vio = v.violations()
    s = S.property_scores(vio).join(S.fine_exposure(vio).select("property_id", "open_violations"), "property_id", "left")
    y = F.col("year_built")
    era = (F.when(y.isNotNull() & (y < 1960), F.lit("\n   Era Risk: 3.8x multiplier (Pre-1960)"))
           .when(y.isNotNull() & (y < 1974), F.lit("\n   Era Risk: 2.5x multiplier (Pre-1974)")).otherwise(F.lit("")))
    act = F.when(F.col("open_violations") > 0,
                 F.concat(F.lit("\n   Active Violations: "), F.col("open_violations").cast("string"))).otherwise(F.lit(""))
    score = F.format_string("%.1f", F.bround(F.coalesce("risk_score", F.lit(0.0)), 1))
    return (v.properties().join(s, "property_id", "left").select(
        "property_id",
        F.concat(F.col("address"), F.lit("\n   BBL: "), F.col("bbl"), F.lit("\n   Risk Score: "), score, F.lit("/100"),
                 F.lit("\n   Year Built: "), F.coalesce(y.cast("string"), F.lit("Unknown")), era, act).alias("report")))


RULE = "-" * 70


@query("property_report", f"""
WITH e AS (SELECT *, CASE WHEN year_built IS NULL OR year_built = 0 THEN NULL ELSE {ERA_KEY_SQL} END AS era FROM properties)
SELECT property_id, concat_ws(E'\\n', 'PROPERTY RISK ASSESSMENT', '', 'PROPERTY INFORMATION', '{RULE}',
         'Address: ' || COALESCE(address, 'Unknown'), 'BBL: ' || COALESCE(bbl, 'N/A'), 'Units: ' || COALESCE(CAST(units AS VARCHAR), 'N/A'),
         'Year Built: ' || COALESCE(CAST(year_built AS VARCHAR), 'Unknown'), 'Borough: ' || COALESCE(borough, 'Unknown'), '',
         CASE WHEN era IS NOT NULL THEN concat_ws(E'\\n', 'BUILDING ERA RISK ANALYSIS', '{RULE}',
           'Era: ' || {_case_map('era', {k: v[0] for k, v in D.ERA_DETAIL.items()})},
           'Risk Multiplier: ' || {era_mult_sql('year_built')} || 'x',
           'Explanation: ' || {_case_map('era', {k: v[1] for k, v in D.ERA_DETAIL.items()})}, '',
           {_case_map('era', {k: _lines_sql('Risk Factors:', v[2]) for k, v in D.ERA_DETAIL.items() if v[2]})},
           {_case_map('era', {k: _lines_sql('Recommended Actions:', v[3]) for k, v in D.ERA_DETAIL.items() if v[3]})}) END,
         '', 'Date: ' || strftime(DATE '{VIOLATION_AS_OF}', '%B %d, %Y')) AS report
FROM e""")
def q_property_report(spark, d):
    """The single-property report (details, era, risk factors, actions) of every building."""
    return S.property_report(_v(spark, d).properties(), VIOLATION_AS_OF)
