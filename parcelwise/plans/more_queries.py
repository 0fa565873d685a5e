"""Registered batch queries: scoring jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelwise.functions import dims as D
from parcelwise.operators import scoring as S
from parcelwise.plans.registry import query
from parcelwise.plans.sqlviews import (borough_sql, complaint_risk_sql, era_mult_sql, inspector_sql,
                                       season_mult_sql, temp_risk_sql, HOTSPOT_CASE)
from parcelwise.sources.tables import Tables

VIOLATION_AS_OF = "2001-11-04"
EVENT_AS_OF = "2024-01-31"
AVG_TEMP = 50.0
SEP = " | "


def _v(spark, d):
    return Tables(spark, d).views


def _joined(col):
    return F.array_join(col, SEP)


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case_map(key: str, mapping: dict, else_sql: str = "NULL") -> str:
    def val(v):
        return _sql_str(v) if isinstance(v, str) else (f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v))
    whens = " ".join(f"WHEN {_sql_str(k)} THEN {val(v)}" for k, v in mapping.items())
    return f"CASE {key} {whens} ELSE {else_sql} END"


ERA_KEY_SQL = ("CASE WHEN year_built IS NULL OR year_built < 1800 OR year_built > 2025 THEN 'unknown' "
               "WHEN year_built >= 1974 THEN 'modern' WHEN year_built >= 1960 THEN 'elevated' ELSE 'critical' END")


# ----------------------------------------------------------------- era
@query("era_multiplier", f"""
SELECT property_id, year_built, {era_mult_sql('year_built')} AS era_multiplier,
       {_case_map(ERA_KEY_SQL, D.ERA_EXPLANATION)} AS era_explanation,
       ({ERA_KEY_SQL}) IN ('elevated', 'critical') AS is_pre1974
FROM properties""")
def q_era_multiplier(spark, d):
    return S.era_scores(_v(spark, d).properties())


@query("era_detail", f"""
SELECT property_id, year_built, {era_mult_sql('year_built')} AS multiplier,
       {_case_map(ERA_KEY_SQL, {k: v[0] for k, v in D.ERA_DETAIL.items()})} AS era,
       {_case_map(ERA_KEY_SQL, {k: v[1] for k, v in D.ERA_DETAIL.items()})} AS explanation,
       {_case_map(ERA_KEY_SQL, {k: SEP.join(v[2]) for k, v in D.ERA_DETAIL.items()})} AS risk_factors,
       {_case_map(ERA_KEY_SQL, {k: SEP.join(v[3]) for k, v in D.ERA_DETAIL.items()})} AS action_items
FROM properties""")
def q_era_detail(spark, d):
    e = S.era_detail(_v(spark, d).properties())
    return e.withColumn("risk_factors", _joined("risk_factors")).withColumn("action_items", _joined("action_items"))


@query("era_class_multiplier", """
SELECT v.order_key, v.line_no, v.property_id, v.violation_class, p.year_built,
       CASE WHEN p.year_built IS NOT NULL AND p.year_built >= 1800 AND p.year_built <= 2025 AND p.year_built < 1974
            THEN CASE v.violation_class WHEN 'C' THEN 3.8::DOUBLE WHEN 'B' THEN 3.2::DOUBLE ELSE 2.5::DOUBLE END
            ELSE 1.0::DOUBLE END AS era_class_multiplier
FROM violations v JOIN properties p ON v.property_id = p.property_id""")
def q_era_class_multiplier(spark, d):
    v = _v(spark, d)
    return S.era_class_multiplier(v.violations(), v.properties())


# ---------------------------------------------------------- inspector
@query("borough_from_bbl", f"""
SELECT property_id, bbl, {borough_sql('bbl')} AS borough FROM properties""")
def q_borough_from_bbl(spark, d):
    from parcelwise.functions import rules as R
    return _v(spark, d).properties().select("property_id", "bbl", R.borough_from_bbl("bbl").alias("borough"))


@query("inspector_multiplier", f"""
SELECT property_id, bbl, council_district, {borough_sql('bbl')} AS borough,
       {inspector_sql('bbl', 'council_district')} AS inspector_multiplier,
       {inspector_sql('bbl', 'council_district')} > 1.4 AS is_hotspot
FROM properties""")
def q_inspector_multiplier(spark, d):
    return S.inspector_scores(_v(spark, d).properties())


_LVL = "CASE WHEN m >= 2.0 THEN 'CRITICAL' WHEN m >= 1.5 THEN 'ELEVATED' ELSE 'STANDARD' END"


@query("district_hotspots", f"""
WITH per AS (SELECT council_district, CAST(count(*) AS BIGINT) AS properties,
                    COALESCE({HOTSPOT_CASE.format(d='council_district')}, 1.0::DOUBLE) AS m
             FROM properties WHERE council_district IS NOT NULL GROUP BY council_district)
SELECT council_district, properties, m AS multiplier, {_LVL} AS risk_level,
       {_case_map(_LVL, D.HOTSPOT_DESCRIPTION)} AS description,
       m > 1.0 AS is_hotspot,
       {_case_map(_LVL, {k: SEP.join(v) for k, v in D.HOTSPOT_ACTIONS.items()})} AS action_items
FROM per""")
def q_district_hotspots(spark, d):
    return S.district_hotspots(_v(spark, d).properties()).withColumn("action_items", _joined("action_items"))


_TIER = "CASE tier WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END"


@query("district_enforcement", f"""
WITH pp AS (SELECT property_id, count(*) AS n FROM violations GROUP BY property_id),
pd AS (SELECT p.council_district, CAST(count(*) AS BIGINT) AS properties,
              CAST(COALESCE(sum(pp.n), 0) AS BIGINT) AS inspections
       FROM properties p LEFT JOIN pp ON p.property_id = pp.property_id
       WHERE p.council_district IS NOT NULL GROUP BY p.council_district),
r AS (SELECT *, round_even(inspections / properties, 6) AS density FROM pd),
t AS (SELECT *, CAST(ntile(3) OVER (ORDER BY density DESC, council_district) AS INTEGER) AS tier FROM r)
SELECT council_district, properties, inspections, density, tier, {_TIER} AS enforcement_intensity,
       CASE tier WHEN 1 THEN 2.3::DOUBLE WHEN 2 THEN 1.8::DOUBLE ELSE 1.5::DOUBLE END AS multiplier
FROM t""")
def q_district_enforcement(spark, d):
    v = _v(spark, d)
    return S.district_enforcement(v.violations(), v.properties())


# --------------------------------------------------------------- heat
_NOTE_SQL = ("CASE WHEN (month(day) = 1 AND day(day) >= 15) OR month(day) = 2 OR (month(day) = 3 AND day(day) <= 15) "
             f"THEN {_sql_str(D.SEASON_NOTES['peak'])} "
             "WHEN month(day) IN (11, 12) OR (month(day) = 4 AND day(day) <= 15) "
             f"THEN {_sql_str(D.SEASON_NOTES['active'])} "
             f"WHEN month(day) >= 10 OR month(day) <= 5 THEN {_sql_str(D.SEASON_NOTES['season'])} "
             f"ELSE {_sql_str(D.SEASON_NOTES['off'])} END")


@query("heat_calendar", f"""
WITH days AS (SELECT DISTINCT issued_date AS day FROM violations)
SELECT day, month(day) >= 10 OR month(day) <= 5 AS is_heat_season,
       {season_mult_sql('day')} AS seasonal_multiplier, {_NOTE_SQL} AS seasonal_note
FROM days""")
def q_heat_calendar(spark, d):
    days = _v(spark, d).violations().select(F.col("issued_date").alias("day")).distinct()
    return S.heat_calendar(days)


def _heat_sql(as_of: str = EVENT_AS_OF, temp: float = AVG_TEMP) -> str:
    day = f"DATE '{as_of}'"
    return f"""
hc AS (SELECT property_id, count(*) AS n FROM complaints
       WHERE complaint_type = 'HEAT/HOT WATER' AND created >= TIMESTAMP '{as_of}' - INTERVAL 30 DAY
       GROUP BY property_id),
hb AS (SELECT p.property_id, p.bbl, p.council_district, p.year_built, CAST(COALESCE(hc.n, 0) AS BIGINT) AS cnt
       FROM properties p LEFT JOIN hc ON p.property_id = hc.property_id),
hr AS (SELECT *, {season_mult_sql(day)} * {temp_risk_sql(f'CAST({temp} AS DOUBLE)')} * {complaint_risk_sql('cnt')} AS raw
       FROM hb),
hf AS (SELECT property_id, bbl, council_district, year_built, cnt AS heat_complaints_30d,
              CAST({temp} AS DOUBLE) AS temperature, round_even(raw, 1) AS risk_multiplier,
              CASE WHEN raw >= 4.0 THEN 'CRITICAL' WHEN raw >= 2.5 THEN 'HIGH'
                   WHEN raw >= 1.5 THEN 'MODERATE' ELSE 'LOW' END AS urgency
       FROM hr)"""


@query("heat_forecast", f"""
WITH {_heat_sql()}
SELECT *, {_case_map('urgency', {k: v[0] for k, v in D.HEAT_URGENCY.items()})} AS days_to_violation,
       {_case_map('urgency', {k: v[1] for k, v in D.HEAT_URGENCY.items()})} AS fine_range,
       {_case_map('urgency', {k: v[2] for k, v in D.HEAT_URGENCY.items()})} AS action,
       true AS is_heat_season, {_sql_str(D.SEASON_NOTES['peak'])} AS seasonal_note
FROM hf""")
def q_heat_forecast(spark, d):
    v = _v(spark, d)
    return S.heat_forecast(v.properties(), v.complaints(types=["HEAT/HOT WATER"]), EVENT_AS_OF, AVG_TEMP)


# Dates at both sides of each season edge, temperatures at both sides of each step; texts written out, not taken from the rules' tables.
SCENARIOS = [("2024-01-10", 54.9), ("2024-01-15", 55.0), ("2024-01-31", None), ("2024-02-01", 61.9), ("2024-02-20", 62.0),
             ("2024-03-16", 40.0), ("2024-04-15", 75.0), ("2024-04-16", 50.0), ("2024-07-15", 75.0), ("2024-10-14", 58.0), ("2024-11-01", 30.0)]


@query("heat_forecast_scenarios", """
WITH s(as_of, temperature) AS (VALUES """ + ", ".join(
    f"(DATE '{d}', {'NULL' if t is None else t}::DOUBLE)" for d, t in SCENARIOS) + """),
n AS (SELECT p.property_id, s.as_of, s.temperature,
             (SELECT count(*) FROM complaints c WHERE c.property_id = p.property_id AND c.complaint_type = 'HEAT/HOT WATER'
              AND c.created >= s.as_of - INTERVAL 30 DAY) AS n, month(s.as_of) * 100 + day(s.as_of) AS md
      FROM properties p, s),
r AS (SELECT *, CASE WHEN md BETWEEN 115 AND 315 THEN 2.0::DOUBLE WHEN md BETWEEN 1101 AND 1231 OR md BETWEEN 401 AND 415 OR md >= 1015 THEN 1.5::DOUBLE
                     WHEN md >= 1001 OR md < 601 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END
             * CASE WHEN temperature < 55 THEN 2.0::DOUBLE WHEN temperature < 62 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END
             * CASE WHEN n >= 5 THEN 3.0::DOUBLE WHEN n >= 3 THEN 2.0::DOUBLE WHEN n >= 1 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS raw FROM n)
SELECT property_id, as_of, temperature, CAST(n AS BIGINT) AS heat_complaints_30d, round_even(raw, 1) AS risk_multiplier,
       CASE WHEN raw >= 4 THEN 'CRITICAL' WHEN raw >= 2.5 THEN 'HIGH' WHEN raw >= 1.5 THEN 'MODERATE' ELSE 'LOW' END AS urgency,
       CASE WHEN raw >= 4 THEN 7 WHEN raw >= 2.5 THEN 14 WHEN raw >= 1.5 THEN 21 ELSE 30 END AS days_to_violation,
       CASE WHEN raw >= 4 THEN '$10K-$25K Class C' WHEN raw >= 2.5 THEN '$5K-$15K Class B/C' WHEN raw >= 1.5 THEN '$1K-$5K Class A/B'
            ELSE 'Low risk' END AS fine_range,
       CASE WHEN raw >= 4 THEN 'IMMEDIATE HVAC inspection required. Class C violation imminent.'
            WHEN raw >= 2.5 THEN 'HVAC inspection within 7 days. Monitor complaints daily.'
            WHEN raw >= 1.5 THEN 'Schedule preventive maintenance. Review heat complaints.'
            ELSE 'Monitor weather and complaints. Standard schedule OK.' END AS action,
       md >= 1001 OR md < 601 AS is_heat_season,
       CASE WHEN md BETWEEN 115 AND 315 THEN 'PEAK HEAT SEASON: 62% of annual $10K+ fines occur in this period'
            WHEN md >= 1101 OR md BETWEEN 401 AND 415 THEN 'Active heat season: Elevated complaint and violation risk'
            WHEN md >= 1001 OR md < 601 THEN 'Heat season: Monitor temperatures and complaints'
            ELSE 'Off season: Low heat-related risk' END AS seasonal_note
FROM r""")
def q_heat_forecast_scenarios(spark, d):
    """R8, R9 at several dates and temperatures."""
    v = _v(spark, d)
    return S.heat_forecast_scenarios(v.properties(), v.complaints(types=["HEAT/HOT WATER"]), SCENARIOS)


@query("complaints_lookback", """
SELECT property_id, CAST(count(*) AS BIGINT) AS heat_complaints FROM complaints
WHERE complaint_type = 'HEAT/HOT WATER' AND created >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY
GROUP BY property_id""")
def q_complaints_lookback(spark, d):
    """Inclusive 30-day lookback per property, no upper bound."""
    return S.complaint_counts(_v(spark, d).complaints(types=["HEAT/HOT WATER"]), EVENT_AS_OF, 30)


def _winter_sql() -> str:
    rec = {k: SEP.join(v) for k, v in D.WINTER_RECOMMENDATIONS.items()}
    return f"""
WITH {_heat_sql()},
svc AS (SELECT property_id, max(resolved_date) AS last_service FROM violations
        WHERE resolved_date IS NOT NULL GROUP BY property_id),
w AS (SELECT hf.property_id, hf.year_built, hf.risk_multiplier, svc.last_service,
             CAST(CASE WHEN hf.year_built IS NOT NULL AND hf.year_built <> 0 AND hf.year_built < 1960 THEN 1.8
                  WHEN hf.year_built IS NOT NULL AND hf.year_built <> 0 AND hf.year_built < 1974 THEN 1.4
                  ELSE 1.0 END AS DOUBLE) AS age,
             CAST(CASE WHEN svc.last_service IS NULL THEN 1.5
                  WHEN DATE '{VIOLATION_AS_OF}' - svc.last_service > 365 THEN 1.6
                  WHEN DATE '{VIOLATION_AS_OF}' - svc.last_service > 180 THEN 1.3 ELSE 1.0 END AS DOUBLE) AS service
      FROM hf LEFT JOIN svc ON hf.property_id = svc.property_id),
c AS (SELECT *, risk_multiplier * age * service AS combined FROM w),
l AS (SELECT *, CASE WHEN combined >= 6.0 THEN 'CRITICAL' WHEN combined >= 4.0 THEN 'HIGH'
                     WHEN combined >= 2.0 THEN 'MODERATE' ELSE 'LOW' END AS overall_risk FROM c)
SELECT property_id, year_built, risk_multiplier, last_service, round_even(age, 1) AS age_factor,
       round_even(service, 1) AS service_factor, round_even(combined, 1) AS combined_multiplier, overall_risk,
       concat_ws('{SEP}', {_case_map('overall_risk', rec)},
                 CASE WHEN year_built IS NOT NULL AND year_built <> 0 AND year_built < 1960
                      THEN {_sql_str(D.WINTER_PRE1960_RECOMMENDATION)} END) AS recommendations
FROM l"""


def _winter(spark, d):
    v = _v(spark, d)
    f = S.heat_forecast(v.properties(), v.complaints(types=["HEAT/HOT WATER"]), EVENT_AS_OF, AVG_TEMP)
    return S.winter_risk(f, v.violations(), VIOLATION_AS_OF)


@query("winter_risk", _winter_sql())
def q_winter_risk(spark, d):
    return _winter(spark, d).withColumn("recommendations", _joined("recommendations"))


@query("winter_recommendations", f"""
SELECT property_id, combined_multiplier, overall_risk, recommendations FROM ({_winter_sql()})""")
def q_winter_recommendations(spark, d):
    return (_winter(spark, d).select("property_id", "combined_multiplier", "overall_risk",
                                     _joined("recommendations").alias("recommendations")))


@query("integrated_risk", f"""
WITH {_heat_sql()}
SELECT property_id, bbl, year_built, council_district, heat_complaints_30d,
       {era_mult_sql('year_built')} AS era_multiplier,
       {inspector_sql('bbl', 'council_district')} AS inspector_multiplier,
       risk_multiplier AS heat_multiplier,
       round_even({era_mult_sql('year_built')} * {inspector_sql('bbl', 'council_district')} * risk_multiplier, 4)
         AS integrated_risk,
       urgency
FROM hf""")
def q_integrated_risk(spark, d):
    v = _v(spark, d)
    return S.integrated_risk(v.properties(), v.complaints(types=["HEAT/HOT WATER"]), EVENT_AS_OF, AVG_TEMP)


@query("heat_probability_14d", """
WITH c AS (SELECT property_id, count(*) AS n FROM complaints
           WHERE complaint_type = 'HEAT/HOT WATER' AND created >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY
           GROUP BY property_id),
b AS (SELECT p.property_id, CAST(COALESCE(c.n, 0) AS BIGINT) AS complaints_14d
      FROM properties p LEFT JOIN c ON p.property_id = c.property_id)
SELECT property_id, complaints_14d, round_even(complaints_14d * 0.87::DOUBLE * 1.5::DOUBLE, 4) AS violation_probability,
       CASE WHEN complaints_14d * 0.87::DOUBLE * 1.5::DOUBLE > 0.7 THEN 'HIGH_RISK' ELSE 'NORMAL' END AS prediction
FROM b""")
def q_heat_probability(spark, d):
    v = _v(spark, d)
    return S.heat_probability_14d(v.properties(), v.complaints(types=["HEAT/HOT WATER"]), EVENT_AS_OF, AVG_TEMP)


# ------------------------------------------------- classes and levels
@query("classify_violations", """
SELECT doc_id,
       CASE WHEN contains(upper(COALESCE(category, '')), 'IMMEDIATELY HAZARDOUS')
              OR contains(upper(COALESCE(category, '')), 'EMERGENCY')
              OR contains(upper(COALESCE(category, '')), 'COLLAPSE')
              OR contains(upper(COALESCE(category, '')), 'STRUCTURAL') THEN 'Class C'
            WHEN contains(upper(COALESCE(category, '')), 'HAZARDOUS')
              OR contains(upper(COALESCE(category, '')), 'SAFETY')
              OR contains(upper(COALESCE(category, '')), 'FIRE')
              OR contains(upper(COALESCE(category, '')), 'ELECTRICAL')
              OR contains(upper(COALESCE(category, '')), 'PLUMBING') THEN 'Class B'
            ELSE 'Class A' END AS violation_class
FROM categories""")
def q_classify_violations(spark, d):
    return S.classify_categories(_v(spark, d).categories())


@query("fine_exposure", """
SELECT property_id, CAST(count(*) AS BIGINT) AS open_violations,
       CAST(count(*) FILTER (WHERE violation_class = 'C') AS BIGINT) AS class_c,
       CAST(sum(CASE violation_class WHEN 'C' THEN 5000 WHEN 'B' THEN 2500 WHEN 'A' THEN 500 ELSE 0 END) AS BIGINT)
         AS exposure
FROM violations WHERE NOT is_resolved GROUP BY property_id""")
def q_fine_exposure(spark, d):
    return S.fine_exposure(_v(spark, d).violations())


PROPERTY_SCORE_SQL = """
SELECT property_id,
       round_even(sum(quantity) FILTER (WHERE NOT is_resolved AND violation_class IN ('B', 'C')) * 2.0::DOUBLE
                  / NULLIF(count(*) FILTER (WHERE NOT is_resolved AND violation_class IN ('B', 'C')), 0), 2) AS risk_score,
       CAST(count(*) AS BIGINT) AS violation_count, max(issued_date) AS last_violation
FROM violations GROUP BY property_id"""


@query("property_risk_score", PROPERTY_SCORE_SQL)
def q_property_risk_score(spark, d):
    return S.property_scores(_v(spark, d).violations())


@query("risk_band", f"""
SELECT property_id, risk_score,
       CASE WHEN risk_score / 100.0 >= 0.8 THEN 'CRITICAL' WHEN risk_score / 100.0 >= 0.6 THEN 'HIGH'
            WHEN risk_score / 100.0 >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_band
FROM ({PROPERTY_SCORE_SQL})""")
def q_risk_band(spark, d):
    from parcelwise.functions import rules as R
    s = S.property_scores(_v(spark, d).violations())
    return s.select("property_id", "risk_score", R.risk_band(F.col("risk_score") / 100.0).alias("risk_band"))
