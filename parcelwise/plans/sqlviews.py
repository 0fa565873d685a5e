"""The adapter views written as plain SQL for the DuckDB oracle.

Independent of the Spark code in ``parcelwise.sources.views``; both follow the
mapping table in FIXTURES.md §3.  ``with_views(sql, ...)`` prepends the views a
query needs as CTEs.
"""

from __future__ import annotations

import re

HOTSPOTS_SQL = ("['brooklyn_council_35','brooklyn_council_36','brooklyn_council_39','brooklyn_council_41',"
                "'manhattan_council_7','manhattan_council_9','manhattan_council_10',"
                "'queens_council_22','queens_council_25','queens_council_26',"
                "'bronx_council_8','bronx_council_14','bronx_council_15','bronx_council_17']")

BOROUGH_CASE = """CASE WHEN {b} IS NOT NULL AND length({b}) = 10 THEN
  CASE substr({b}, 1, 1) WHEN '1' THEN 'manhattan' WHEN '2' THEN 'bronx' WHEN '3' THEN 'brooklyn'
  WHEN '4' THEN 'queens' WHEN '5' THEN 'staten_island' ELSE 'unknown' END ELSE 'unknown' END"""

HOTSPOT_CASE = """CAST(CASE lower({d})
  WHEN 'brooklyn_council_35' THEN 1.9 WHEN 'brooklyn_council_36' THEN 2.3
  WHEN 'brooklyn_council_39' THEN 1.7 WHEN 'brooklyn_council_41' THEN 1.8
  WHEN 'manhattan_council_7' THEN 2.1 WHEN 'manhattan_council_9' THEN 1.9
  WHEN 'manhattan_council_10' THEN 1.6 WHEN 'queens_council_22' THEN 1.7
  WHEN 'queens_council_25' THEN 1.5 WHEN 'queens_council_26' THEN 1.6
  WHEN 'bronx_council_8' THEN 2.0 WHEN 'bronx_council_14' THEN 1.8
  WHEN 'bronx_council_15' THEN 2.2 WHEN 'bronx_council_17' THEN 1.9 END AS DOUBLE)"""

BASELINE_CASE = """CAST(CASE {b} WHEN 'brooklyn' THEN 1.2 WHEN 'manhattan' THEN 1.3 WHEN 'queens' THEN 1.1
  WHEN 'bronx' THEN 1.4 WHEN 'staten_island' THEN 0.9 END AS DOUBLE)"""


def dbl(x) -> str:
    """A double literal (DuckDB reads 1.5 as DECIMAL)."""
    return f"CAST({x} AS DOUBLE)"


def borough_sql(b: str) -> str:
    return BOROUGH_CASE.format(b=b)


def inspector_sql(bbl: str, district: str) -> str:
    return (f"COALESCE({HOTSPOT_CASE.format(d=district)}, "
            f"{BASELINE_CASE.format(b=borough_sql(bbl))}, CAST(1.0 AS DOUBLE))")


def era_mult_sql(y: str, max_year: int = 2025) -> str:
    return (f"CAST(CASE WHEN {y} IS NULL OR {y} < 1800 OR {y} > {max_year} THEN 1.0 "
            f"WHEN {y} >= 1974 THEN 1.0 WHEN {y} >= 1960 THEN 2.5 ELSE 3.8 END AS DOUBLE)")


def season_mult_sql(d: str) -> str:
    m, dd = f"month({d})", f"day({d})"
    return (f"CAST(CASE WHEN ({m} = 1 AND {dd} >= 15) OR {m} = 2 OR ({m} = 3 AND {dd} <= 15) THEN 2.0 "
            f"WHEN {m} = 12 OR ({m} = 4 AND {dd} <= 15) OR {m} = 11 OR ({m} = 10 AND {dd} >= 15) THEN 1.5 "
            f"WHEN {m} >= 10 OR {m} <= 5 THEN 1.2 ELSE 1.0 END AS DOUBLE)")


def temp_risk_sql(t: str) -> str:
    return f"CAST(CASE WHEN {t} IS NULL THEN 1.0 WHEN {t} < 55 THEN 2.0 WHEN {t} < 62 THEN 1.5 ELSE 1.0 END AS DOUBLE)"


def complaint_risk_sql(n: str) -> str:
    return f"CAST(CASE WHEN {n} >= 5 THEN 3.0 WHEN {n} >= 3 THEN 2.0 WHEN {n} >= 1 THEN 1.5 ELSE 1.0 END AS DOUBLE)"


VIEWS = {
    "properties": f"""
SELECT p_partkey AS property_id,
       CAST(1 + p_partkey % 5 AS VARCHAR) || lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '0')
         || lpad(CAST(p_size AS VARCHAR), 4, '0') AS bbl,
       CASE CAST(1 + p_partkey % 5 AS VARCHAR) WHEN '1' THEN 'manhattan' WHEN '2' THEN 'bronx'
         WHEN '3' THEN 'brooklyn' WHEN '4' THEN 'queens' ELSE 'staten_island' END AS borough,
       p_name AS address,
       p_size AS units,
       CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE CAST(1890 + (p_partkey * 7) % 137 AS INTEGER) END AS year_built,
       p_type AS building_class,
       p_brand AS tenant_id,
       p_partkey % 10 <> 0 AS is_monitored,
       CASE WHEN p_partkey % 28 < 14 THEN ({HOTSPOTS_SQL})[CAST(p_partkey % 28 AS INTEGER) + 1] END AS council_district
FROM part""",
    "violations": """
SELECT l_orderkey AS order_key, l_linenumber AS line_no, l_partkey AS property_id, l_suppkey AS supp_key,
       CASE l_returnflag WHEN 'R' THEN 'C' WHEN 'A' THEN 'B' WHEN 'N' THEN 'A' END AS violation_class,
       CASE l_suppkey % 3 WHEN 0 THEN 'DOB' WHEN 1 THEN 'HPD' ELSE 'FDNY' END AS source,
       l_linestatus = 'F' AS is_resolved,
       CAST(l_shipdate AS DATE) AS issued_date,
       CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) END AS resolved_date,
       l_quantity / 5.0 AS risk_score,
       l_extendedprice * l_discount AS fine_amount,
       l_quantity AS quantity,
       l_extendedprice AS extended_price
FROM lineitem""",
    "complaints": """
SELECT event_id AS unique_key, user_id AS property_id, ts AS created,
       CASE event_type WHEN 'error' THEN 'HEAT/HOT WATER' WHEN 'click' THEN 'PLUMBING'
         WHEN 'view' THEN 'NOISE' WHEN 'signup' THEN 'OTHER' END AS complaint_type,
       value
FROM events WHERE event_type <> 'purchase'""",
    "class_c_events": """
SELECT event_id AS violation_key, user_id AS property_id, ts AS issued
FROM events WHERE event_type = 'purchase'""",
    "requests": """
SELECT event_id AS request_id, user_id AS client, ts, event_type AS endpoint,
       event_type = 'error' AS is_error, value AS latency
FROM events""",
    "updates": """
SELECT event_id AS update_id, user_id AS property_id, event_type AS update_type,
       CASE WHEN value >= 300 THEN 'CRITICAL' WHEN value >= 200 THEN 'HIGH'
            WHEN value >= 100 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
       ts
FROM events""",
    "subscriptions": """
SELECT o_custkey AS connection, o_custkey // (1 + o_orderkey % 10) AS property_id,
       CASE WHEN o_orderstatus IN ('O', 'P') THEN 'SUBSCRIBE' WHEN o_orderstatus = 'F' THEN 'UNSUBSCRIBE' END AS action,
       o_orderdate AS ts, o_orderkey AS seq
FROM orders""",
    "protocol_messages": """
SELECT event_id AS message_id, user_id AS connection, ts,
       CASE event_type WHEN 'click' THEN 'SUBSCRIBE' WHEN 'view' THEN 'UNSUBSCRIBE' WHEN 'signup' THEN 'AUTHENTICATE' WHEN 'purchase' THEN 'PING' END AS type,
       CASE WHEN floor(value)::BIGINT % 3 <> 0 THEN 'p-' || (floor(value)::BIGINT % 7) END AS property_id
FROM events""",
    "users": """
SELECT c_custkey AS user_id, 't-' || c_nationkey AS tenant_id, lower(c_name) AS email,
       CASE WHEN c_acctbal > 5000 THEN 'admin' ELSE 'member' END AS role, c_acctbal >= 0 AS is_active
FROM customer""",
    "tenants": """
SELECT 't-' || n_nationkey AS tenant_id, n_name AS name,
       CASE n_nationkey % 3 WHEN 0 THEN 'enterprise' WHEN 1 THEN 'pro' ELSE 'free' END AS plan
FROM nation""",
    "audit_logs": """
SELECT event_id AS log_id, user_id, ts AS created_at,
       CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'update' WHEN 'signup' THEN 'create' ELSE 'other' END AS action,
       'property/' || (event_id % 500) AS resource
FROM events""",
    "api_keys": """
SELECT c_custkey AS key_id, c_custkey AS user_id, sha256('key-' || c_custkey) AS key_hash, c_custkey % 4 <> 0 AS is_active,
       CASE WHEN c_custkey % 2 = 0 THEN 1000 ELSE 100 END AS daily_limit
FROM customer""",
    "accounts": """
SELECT c_custkey AS account_key, c_name AS email,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'free'
            WHEN c_mktsegment IN ('MACHINERY', 'AUTOMOBILE') THEN 'pro' ELSE 'enterprise' END AS tier,
       c_nationkey AS nation_key
FROM customer""",
    "categories": "SELECT doc_id, text AS category FROM documents",
}


def with_views(sql: str, *names: str) -> str:
    """Prepend the named adapter views (auto-detected when none are given)."""
    if not names:
        names = tuple(n for n in VIEWS if re.search(rf"\b{n}\b", sql))
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = sql.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{body[14:].lstrip()}"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
