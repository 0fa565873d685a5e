"""Registered batch queries: windows, quotas and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelwise.functions import rules as R
from parcelwise.operators import scoring as S
from parcelwise.operators import usage as U
from parcelwise.operators import windows as W
from parcelwise.plans.more_queries import PROPERTY_SCORE_SQL, VIOLATION_AS_OF
from parcelwise.plans.registry import query
from parcelwise.sources.tables import Tables


def _v(spark, d):
    return Tables(spark, d).views


TIER_LIMIT_SQL = "CASE tier WHEN 'free' THEN 10 WHEN 'pro' THEN 1000 WHEN 'enterprise' THEN 10000 END"


@query("quota_admission", f"""
WITH r AS (SELECT r.request_id, r.client, r.ts, date_trunc('month', r.ts) AS month, a.tier,
                  COALESCE({TIER_LIMIT_SQL}, 0) AS quota
           FROM requests r LEFT JOIN accounts a ON r.client = a.account_key),
n AS (SELECT *, row_number() OVER (PARTITION BY client, month ORDER BY ts, request_id) AS k FROM r)
SELECT request_id, client, ts, month, tier, quota,
       CASE WHEN k <= quota THEN CAST(k AS INTEGER) END AS position, k <= quota AS admitted
FROM n""")
def q_quota_admission(spark, d):
    v = _v(spark, d)
    return U.quota_admission(v.requests(), v.accounts())


@query("usage_report", f"""
WITH per AS (SELECT client, date_trunc('month', ts) AS month, count(*) AS requests FROM requests GROUP BY 1, 2),
j AS (SELECT per.*, a.email, a.tier, COALESCE(CASE COALESCE(a.tier, 'free') WHEN 'free' THEN 10 WHEN 'pro' THEN 1000
                                           WHEN 'enterprise' THEN 10000 END, 10) AS lim
      FROM per JOIN accounts a ON per.client = a.account_key)
SELECT client, email, tier, month, CAST(requests AS BIGINT) AS requests, CAST(least(requests, lim) AS BIGINT) AS used,
       lim AS "limit", CAST(lim - least(requests, lim) AS BIGINT) AS remaining
FROM j""")
def q_usage_report(spark, d):
    v = _v(spark, d)
    return U.usage_report(v.requests(), v.accounts())


CHECKS_SQL = """
SELECT s.connection AS "user", s.seq, s.ts, p.bbl
FROM subscriptions s JOIN properties p ON s.property_id = p.property_id"""


def _checks(v):
    p = v.properties().select("property_id", "bbl")
    return (v.subscriptions().join(p, "property_id")
            .select(F.col("connection").alias("user"), "seq", "ts", "bbl"))


@query("tier_building_cap", f"""
WITH c AS ({CHECKS_SQL}),
f AS (SELECT "user", bbl, min(ts) AS first_ts FROM c GROUP BY 1, 2),
f2 AS (SELECT f."user", f.bbl, f.first_ts, min(c.seq) AS first_seq FROM f JOIN c ON f."user" = c."user"
       AND f.bbl = c.bbl AND f.first_ts = c.ts GROUP BY 1, 2, 3),
t AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY first_ts, first_seq, bbl) AS slot FROM f2),
top AS (SELECT "user", bbl, CAST(slot AS INTEGER) AS slot FROM t WHERE slot <= 3)
SELECT c."user", c.bbl, c.seq, c.ts, COALESCE(a.tier, 'free') AS tier, top.slot,
       COALESCE(a.tier, 'free') <> 'free' OR top.slot IS NOT NULL AS allowed
FROM c LEFT JOIN accounts a ON c."user" = a.account_key LEFT JOIN top ON c."user" = top."user" AND c.bbl = top.bbl""")
def q_tier_building_cap(spark, d):
    v = _v(spark, d)
    return U.tier_building_cap(_checks(v), v.accounts())


@query("tenant_property_limit", """
SELECT tenant_id, property_id, 20 AS properties_limit,
       row_number() OVER (PARTITION BY tenant_id ORDER BY property_id) <= 20 AS within_limit
FROM properties""")
def q_tenant_property_limit(spark, d):
    """The tenant's property limit (20 here: the default of 100 would cut nothing in small tables)."""
    return U.tenant_property_limit(_v(spark, d).properties(), 20)


@query("hit_rate", """
WITH r AS (SELECT *, lag(ts) OVER (PARTITION BY client, endpoint ORDER BY ts, request_id) AS prev FROM requests),
h AS (SELECT endpoint, COALESCE(ts <= prev + INTERVAL 3600 SECOND, false) AS hit FROM r)
SELECT endpoint, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS hits,
       CAST(count(*) FILTER (WHERE NOT hit) AS BIGINT) AS misses,
       COALESCE(round_even(count(*) FILTER (WHERE hit) / count(*), 4), 0.0::DOUBLE) AS hit_rate
FROM h GROUP BY endpoint""")
def q_hit_rate(spark, d):
    return U.hit_rate(_v(spark, d).requests())


@query("request_counters", """
SELECT endpoint, CASE WHEN is_error THEN '5xx' ELSE '2xx' END AS status, CAST(count(*) AS BIGINT) AS requests
FROM requests GROUP BY 1, 2""")
def q_request_counters(spark, d):
    return U.request_counters(_v(spark, d).requests())


@query("heat_complaints_30d", """
SELECT unique_key, property_id, created,
       CAST(count(*) OVER (PARTITION BY property_id ORDER BY created
                           RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS heat_complaints_30d
FROM complaints WHERE complaint_type = 'HEAT/HOT WATER'""")
def q_heat_complaints_30d(spark, d):
    c = (_v(spark, d).complaints(types=["HEAT/HOT WATER"]).filter(F.col("complaint_type") == "HEAT/HOT WATER")
         .select("unique_key", "property_id", "created"))
    return W.trailing_count(c, "property_id", "created", 30 * 86400, out="heat_complaints_30d")


@query("violation_trend_30d", f"""
WITH t AS (SELECT DISTINCT tenant_id FROM properties),
spine AS (SELECT tenant_id, CAST(day AS DATE) AS day FROM t,
          generate_series(DATE '{VIOLATION_AS_OF}' - 29, DATE '{VIOLATION_AS_OF}', INTERVAL 1 DAY) g(day)),
daily AS (SELECT p.tenant_id, v.issued_date AS day, count(*) AS n, count(*) FILTER (WHERE v.violation_class = 'C') AS c
          FROM violations v JOIN properties p ON v.property_id = p.property_id
          WHERE v.issued_date BETWEEN DATE '{VIOLATION_AS_OF}' - 29 AND DATE '{VIOLATION_AS_OF}' GROUP BY 1, 2)
SELECT s.tenant_id, s.day, CAST(COALESCE(n, 0) AS BIGINT) AS total_violations, CAST(COALESCE(c, 0) AS BIGINT) AS class_c,
       CAST(sum(COALESCE(n, 0)) OVER (PARTITION BY s.tenant_id ORDER BY s.day) AS BIGINT) AS running_total
FROM spine s LEFT JOIN daily ON s.tenant_id = daily.tenant_id AND s.day = daily.day""")
def q_violation_trend_30d(spark, d):
    """Daily totals and class C per tenant for the 30 days up to as_of, empty days included."""
    v = _v(spark, d)
    p = v.properties().select("property_id", "tenant_id")
    start = F.date_sub(F.lit(VIOLATION_AS_OF).cast("date"), 29)
    daily = (v.violations().filter(F.col("issued_date").between(start, F.lit(VIOLATION_AS_OF).cast("date")))
             .groupBy("property_id", F.col("issued_date").alias("day"))
             .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("violation_class") == "C").alias("c"))
             .join(p, "property_id").groupBy("tenant_id", "day").agg(F.sum("n").alias("n"), F.sum("c").alias("c")))
    import datetime as _dt
    first = (_dt.date.fromisoformat(VIOLATION_AS_OF) - _dt.timedelta(days=29)).isoformat()
    spine = W.date_spine(p.select("tenant_id").distinct(), first, VIOLATION_AS_OF)
    j = spine.join(daily, ["tenant_id", "day"], "left")
    from pyspark.sql import Window
    w = Window.partitionBy("tenant_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return j.select("tenant_id", "day", F.coalesce("n", F.lit(0)).alias("total_violations"),
                    F.coalesce("c", F.lit(0)).alias("class_c"),
                    F.sum(F.coalesce("n", F.lit(0))).over(w).alias("running_total"))


ERA_KEY_SQL = ("CASE WHEN year_built IS NULL OR year_built < 1800 OR year_built > 2025 THEN 'unknown' "
               "WHEN year_built >= 1974 THEN 'modern' WHEN year_built >= 1960 THEN 'elevated' ELSE 'critical' END")


@query("cohort_percentile", f"""
WITH s AS ({PROPERTY_SCORE_SQL}),
j AS (SELECT p.property_id, p.borough, {ERA_KEY_SQL} AS era, s.risk_score
      FROM properties p JOIN s ON p.property_id = s.property_id WHERE s.risk_score IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY borough, era ORDER BY risk_score) - 1 AS below,
             count(*) OVER (PARTITION BY borough, era) - 1 AS peers FROM j)
SELECT property_id, borough, era, risk_score, CAST(below AS BIGINT) AS peers_below, CAST(peers AS BIGINT) AS peers,
       round_even(below * 100.0::DOUBLE / NULLIF(peers, 0), 2) AS percentile
FROM r""")
def q_cohort_percentile(spark, d):
    """Share of the same borough and era strictly below, self excluded."""
    v = _v(spark, d)
    s = S.property_scores(v.violations())
    j = (v.properties().select("property_id", "borough", R.era_key("year_built").alias("era"))
         .join(s.select("property_id", "risk_score"), "property_id"))
    return W.strict_percentile(j, ["borough", "era"], "risk_score")
