"""Registered batch queries: sources, listings, set operations, maintenance, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelwise.functions import dims as D
from parcelwise.operators import feed as FE
from parcelwise.operators import listing as L
from parcelwise.operators import scoring as S
from parcelwise.operators import windows as W
from parcelwise.plans.batch_queries import FEED_SCORED_SQL
from parcelwise.plans.batch_queries import scored as _scored
from parcelwise.plans.more_queries import EVENT_AS_OF, PROPERTY_SCORE_SQL, VIOLATION_AS_OF
from parcelwise.plans.registry import query
from parcelwise.session import scratch_path
from parcelwise.sources import feeds as FD
from parcelwise.sources.tables import Tables

TENANT = "Brand#23"
VORDER_SQL = ("order_key, line_no, property_id, supp_key, quantity, extended_price, violation_class, source")
VCOLS_SQL = ("order_key, line_no, property_id, supp_key, violation_class, source, is_resolved, issued_date, "
             "resolved_date, risk_score, fine_amount, quantity, extended_price")


def _v(spark, d):
    return Tables(spark, d).views


# ------------------------------------------------------------------ sources
@query("src_hpd_violations", f"""
SELECT * FROM violations
WHERE source = 'HPD' AND issued_date >= DATE '{VIOLATION_AS_OF}' - 90 AND upper(trim(violation_class)) IN ('A', 'B', 'C')""")
def q_src_hpd(spark, d):
    return FE.hpd_violations(_v(spark, d).violations(), VIOLATION_AS_OF, D.FEED_DAYS_BACK)


@query("src_311_complaints", f"""
SELECT * FROM complaints WHERE complaint_type IN ('HEAT/HOT WATER', 'PLUMBING')
  AND created >= TIMESTAMP '{EVENT_AS_OF}' - INTERVAL 90 DAY""")
def q_src_311(spark, d):
    return FE.relevant_complaints(_v(spark, d).complaints(types=D.RELEVANT_311_TYPES), EVENT_AS_OF, D.FEED_DAYS_BACK)


@query("src_dataset_slice", f"""
SELECT {VCOLS_SQL} FROM violations WHERE issued_date >= DATE '2001-01-01'
ORDER BY issued_date DESC, {VCOLS_SQL.replace('issued_date, ', '')}""")
def q_src_dataset_slice(spark, d):
    return FD.dataset_slice(_v(spark, d).violations(), "issued_date", "2001-01-01")


DOB_FEED_SQL = """
SELECT p.bbl, CAST(v.order_key AS VARCHAR) || '-' || CAST(v.line_no AS VARCHAR) AS violation_number,
       v.violation_class AS violation_type, CAST(v.issued_date AS VARCHAR) AS issue_date,
       CASE v.violation_class WHEN 'C' THEN 'IMMEDIATELY HAZARDOUS' WHEN 'B' THEN 'HAZARDOUS' ELSE 'NON-HAZARDOUS' END
         AS violation_category,
       p.address AS respondent_name, CAST(v.resolved_date AS VARCHAR) AS disposition_date,
       CASE WHEN v.is_resolved THEN 'RESOLVED' END AS disposition,
       CAST(v.fine_amount AS VARCHAR) AS penalty_imposed
FROM violations v JOIN properties p ON v.property_id = p.property_id WHERE v.source = 'DOB'"""


@query("src_dob_violations", f"""
WITH f AS ({DOB_FEED_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY bbl ORDER BY issue_date DESC, violation_number, violation_category,
                                   penalty_imposed, respondent_name, disposition_date) AS rank
      FROM f WHERE length(bbl) = 10)
SELECT bbl, violation_number, violation_type, substr(issue_date, 1, 10) AS issue_date, violation_category,
       array_to_string(list_transform(string_split(respondent_name, ' '),
                       lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS respondent_name,
       substr(disposition_date, 1, 10) AS disposition_date, disposition, penalty_imposed,
       CASE WHEN contains(violation_category, 'IMMEDIATELY HAZARDOUS') THEN 'Class C'
            WHEN contains(violation_category, 'HAZARDOUS') THEN 'Class B' ELSE 'Class A' END AS violation_class,
       CAST(rank AS INTEGER) AS rank
FROM r WHERE rank <= 50""")
def q_src_dob(spark, d):
    v = _v(spark, d)
    return FD.dob_violations(FD.dob_feed(v.violations(), v.properties(), newest=50), 50)


@query("per_property_latest_n", f"""
SELECT * EXCLUDE (rank), CAST(rank AS INTEGER) AS rank FROM (
  SELECT {VCOLS_SQL}, row_number() OVER (PARTITION BY property_id ORDER BY issued_date DESC, {VORDER_SQL}) AS rank
  FROM violations) WHERE rank <= 5""")
def q_latest_n(spark, d):
    v = _v(spark, d).violations()
    order = [F.desc("issued_date")] + [F.asc(c) for c in L.VIOLATION_ORDER_TIEBREAK]
    return W.top_n_per_key(v, ["property_id"], order, 5)


BUNDLE_SQL = f"""
WITH k AS (SELECT DISTINCT bbl FROM properties),
vf AS (SELECT p.bbl, v.source, count(*) AS n,
              string_agg(concat_ws('/', strftime(v.issued_date, '%Y-%m-%d'), v.order_key, v.line_no, v.violation_class,
                                   v.is_resolved), ','
                         ORDER BY v.issued_date DESC NULLS LAST, v.order_key DESC, v.line_no DESC) AS recs
       FROM violations v JOIN properties p ON v.property_id = p.property_id GROUP BY p.bbl, v.source),
cf AS (SELECT p.bbl, count(*) AS n,
              string_agg(concat_ws('/', strftime(c.created, '%Y-%m-%d'), c.unique_key, c.complaint_type), ','
                         ORDER BY c.created DESC NULLS LAST, c.unique_key DESC) AS recs
       FROM complaints c JOIN properties p ON c.property_id = p.property_id
       WHERE c.created >= TIMESTAMP '{EVENT_AS_OF}' - INTERVAL 30 DAY GROUP BY p.bbl)
"""


def _bundle_feeds(spark, d):
    v = _v(spark, d)
    keys = v.properties().select("property_id", "bbl")
    vio = (W.spread_join(v.violations(), keys, "property_id", ["order_key", "line_no"])
           .select("bbl", F.col("source").alias("feed"), F.col("issued_date").alias("ts"), "order_key", "line_no",
                   "violation_class", "is_resolved"))
    recent = v.complaints().filter(F.col("created") >= F.lit(EVENT_AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 30 DAYS"))
    comp = (W.spread_join(recent, keys, "property_id", ["unique_key"]).select("bbl", F.col("created").alias("ts"), "unique_key", "complaint_type"))
    return keys, vio, comp


def _records(name: str, fields: list[str]):
    """An array of records as text, record by record in its order."""
    def text(r):
        return F.concat_ws("/", F.date_format(r["ts"], "yyyy-MM-dd"), *[r[f].cast("string") for f in fields])
    return F.array_join(F.transform(name, text), ",").alias(name)


VIO_FIELDS, COMPLAINT_FIELDS = ["order_key", "line_no", "violation_class", "is_resolved"], ["unique_key", "complaint_type"]


@query("property_bundle", f"""
{BUNDLE_SQL}
SELECT k.bbl, CAST(COALESCE(d.n, 0) AS INTEGER) AS n_dob, CAST(COALESCE(h.n, 0) AS INTEGER) AS n_hpd,
       CAST(COALESCE(c.n, 0) AS INTEGER) AS n_complaints, CAST(COALESCE(f.n, 0) AS INTEGER) AS n_permits,
       COALESCE(d.recs, '') AS dob, COALESCE(h.recs, '') AS hpd, COALESCE(c.recs, '') AS complaints,
       COALESCE(f.recs, '') AS permits
FROM k LEFT JOIN vf d ON k.bbl = d.bbl AND d.source = 'DOB' LEFT JOIN vf h ON k.bbl = h.bbl AND h.source = 'HPD'
LEFT JOIN vf f ON k.bbl = f.bbl AND f.source = 'FDNY' LEFT JOIN cf c ON k.bbl = c.bbl""")
def q_property_bundle(spark, d):
    """All four feeds of every parcel, with their records."""
    keys, vio, comp = _bundle_feeds(spark, d)
    b = FD.property_bundle(keys, {"*": vio, "complaints": comp}, split={"dob": "DOB", "hpd": "HPD", "permits": "FDNY"})
    return b.select("bbl", *[F.size(c).alias(f"n_{c}") for c in ("dob", "hpd", "complaints", "permits")],
                    *[_records(c, VIO_FIELDS) for c in ("dob", "hpd", "permits")],
                    _records("complaints", COMPLAINT_FIELDS))


@query("property_bundle_partial", f"""
{BUNDLE_SQL}
SELECT k.bbl, COALESCE(d.recs, '') AS dob, 0 AS n_hpd, CAST(COALESCE(c.n, 0) AS INTEGER) AS n_complaints
FROM k LEFT JOIN vf d ON k.bbl = d.bbl AND d.source = 'DOB' LEFT JOIN cf c ON k.bbl = c.bbl""")
def q_property_bundle_partial(spark, d):
    """S7/J7 with one failed feed (hpd: empty) and one left out (permits)."""
    keys, vio, comp = _bundle_feeds(spark, d)
    dob = vio.filter(F.col("feed") == "DOB").drop("feed")
    b = FD.property_bundle(keys, {"dob": dob, "hpd": None, "complaints": comp})
    return b.select("bbl", _records("dob", VIO_FIELDS), F.size("hpd").alias("n_hpd"),
                    F.size("complaints").alias("n_complaints"))


@query("property_bundle_pages", """
WITH r AS (
  SELECT property_id, source AS feed, CAST(issued_date AS TIMESTAMP) AS ts,
         concat_ws('/', strftime(issued_date, '%Y-%m-%d'), order_key, line_no, violation_class, is_resolved) AS record FROM violations
  UNION ALL
  SELECT property_id, 'complaints', created, concat_ws('/', strftime(created, '%Y-%m-%d'), unique_key, complaint_type) FROM complaints),
n AS (SELECT p.bbl, r.feed, r.ts, r.record, row_number() OVER (PARTITION BY p.bbl, r.feed ORDER BY r.ts DESC, r.record) - 1 AS place
      FROM r JOIN properties p ON p.property_id = r.property_id)
SELECT bbl, feed, place // 25 AS page, CAST(count(*) AS BIGINT) AS n_records, string_agg(record, ',' ORDER BY place) AS records
FROM n GROUP BY bbl, feed, place // 25""")
def q_property_bundle_pages(spark, d):
    """S7/J7 as pages of 25 records: no parcel's records are ever in one place."""
    v = _v(spark, d)
    text = lambda ts, fields: F.concat_ws("/", F.date_format(ts, "yyyy-MM-dd"), *[F.col(c).cast("string") for c in fields])
    vio = v.violations().select("property_id", F.col("source").alias("feed"), F.col("issued_date").cast("timestamp_ntz").alias("ts"),
                                text("issued_date", VIO_FIELDS).alias("record"))
    comp = v.complaints().select("property_id", F.lit("complaints").alias("feed"), F.col("created").alias("ts"),
                                 text("created", COMPLAINT_FIELDS).alias("record"))
    pages = FD.bundle_pages(v.properties(), vio.unionByName(comp), 25)
    return pages.withColumn("records", F.array_join("records", ","))


@query("src_feed_csv", FEED_SCORED_SQL)
def q_src_feed_csv(spark, d):
    """K1 sink + S8 source: write the scored feed as CSV to the shared folder, read it back typed."""
    path = scratch_path(spark, "feed-csv")
    (_scored(spark, d).select([f.name for f in FD.FEED_CSV_SCHEMA.fields])
     .write.mode("overwrite").option("header", True).csv(path))
    return FD.read_feed_csv(spark, path)


@query("src_usage_ledger", """
SELECT email, 'key-' || CAST(account_key AS VARCHAR) AS api_key, tier, CAST(0 AS BIGINT) AS requests_used,
       '2024-01-01T00:00:00' AS month_start FROM accounts""")
def q_src_usage_ledger(spark, d):
    """The users ledger written as JSON and read with its schema."""
    path = scratch_path(spark, "ledger")
    (_v(spark, d).accounts().select(
        "email", F.concat(F.lit("key-"), F.col("account_key").cast("string")).alias("api_key"), "tier",
        F.lit(0).cast("long").alias("requests_used"), F.lit("2024-01-01T00:00:00").alias("month_start"))
     .write.mode("overwrite").json(path))
    return FD.read_ledger(spark, path)


# ------------------------------------------------------------------ filters
@query("tenant_scope", f"SELECT * FROM properties WHERE tenant_id = '{TENANT}'")
def q_tenant_scope(spark, d):
    return L.tenant_scope(_v(spark, d).properties(), TENANT)


@query("violations_list", f"""
SELECT {VCOLS_SQL} FROM violations WHERE source = 'HPD' AND is_resolved = false
ORDER BY issued_date DESC NULLS FIRST, {VORDER_SQL} LIMIT 50 OFFSET 100""")
def q_violations_list(spark, d):
    return L.list_violations(_v(spark, d).violations(), source="HPD", is_resolved=False, skip=100, limit=50)


@query("property_search", f"""
WITH s AS (SELECT * FROM ({FEED_SCORED_SQL}))
SELECT *, CASE substr(bbl, 1, 1) WHEN '1' THEN 'manhattan' WHEN '2' THEN 'bronx' WHEN '3' THEN 'brooklyn'
            WHEN '4' THEN 'queens' WHEN '5' THEN 'staten_island' ELSE 'unknown' END AS borough
FROM s WHERE substr(bbl, 1, 1) = '3' AND compliance_risk_score >= 20 AND compliance_risk_score <= 60
ORDER BY bbl LIMIT 100""")
def q_property_search(spark, d):
    return L.property_search(_scored(spark, d), borough="BROOKLYN", min_risk=20, max_risk=60, limit=100)


@query("property_lookup", """
SELECT * FROM properties WHERE property_id IN (SELECT property_id FROM complaints)""")
def q_property_lookup(spark, d):
    v = _v(spark, d)
    return L.property_lookup(v.properties(), v.complaints().select("property_id"))


RAW_BBL_SQL = """
SELECT property_id, CASE property_id % 4 WHEN 0 THEN bbl
         WHEN 1 THEN substr(bbl, 1, 1) || '-' || substr(bbl, 2, 5) || '-' || substr(bbl, 7, 4)
         WHEN 2 THEN ' ' || bbl || ' ' ELSE '0' || substr(bbl, 2) END AS raw_bbl FROM properties"""


@query("bbl_quality", f"""
WITH r AS ({RAW_BBL_SQL}), c AS (SELECT *, regexp_replace(trim(raw_bbl), '[-\\s]', '', 'g') AS bbl FROM r)
SELECT property_id, raw_bbl, bbl, COALESCE(regexp_full_match(bbl, '[1-5][0-9]{{9}}'), false) AS is_valid,
       CASE WHEN length(bbl) = 10 THEN COALESCE(CASE substr(bbl, 1, 1) WHEN '1' THEN 'manhattan' WHEN '2' THEN 'bronx'
              WHEN '3' THEN 'brooklyn' WHEN '4' THEN 'queens' WHEN '5' THEN 'staten_island' END, 'unknown')
            ELSE 'unknown' END AS borough
FROM c""")
def q_bbl_quality(spark, d):
    p = _v(spark, d).properties()
    b = F.col("bbl")
    raw = (F.when(F.col("property_id") % 4 == 0, b)
           .when(F.col("property_id") % 4 == 1, F.concat_ws("-", F.substring(b, 1, 1), F.substring(b, 2, 5), F.substring(b, 7, 4)))
           .when(F.col("property_id") % 4 == 2, F.concat(F.lit(" "), b, F.lit(" ")))
           .otherwise(F.concat(F.lit("0"), F.substring(b, 2, 9))))
    return L.bbl_quality(p.select("property_id", raw.alias("raw_bbl")))


@query("era_filter", """
SELECT tenant_id, CAST(count(*) FILTER (WHERE COALESCE(year_built, 2000) < 1974) AS BIGINT) AS pre1974,
       CAST(count(*) FILTER (WHERE COALESCE(year_built, 2000) < 1960) AS BIGINT) AS pre1960,
       CAST(count(*) FILTER (WHERE COALESCE(year_built, 2000) < 1974) - count(*) FILTER (WHERE COALESCE(year_built, 2000) < 1960) AS BIGINT)
         AS rent_stabilized_era
FROM properties GROUP BY tenant_id""")
def q_era_filter(spark, d):
    return L.era_filter(_v(spark, d).properties())


@query("violations_by_address", """
WITH pp AS (SELECT property_id, count(*) AS n, count(*) FILTER (WHERE NOT is_resolved) AS o FROM violations GROUP BY property_id)
SELECT p.property_id, p.address, p.bbl, CAST(COALESCE(n, 0) AS BIGINT) AS violations,
       CAST(COALESCE(o, 0) AS BIGINT) AS open_violations
FROM properties p LEFT JOIN pp ON p.property_id = pp.property_id WHERE contains(lower(p.address), 'red')""")
def q_violations_by_address(spark, d):
    v = _v(spark, d)
    return L.violations_by_address(v.properties(), v.violations(), "red")


@query("retention_split", f"""
SELECT 'violations' AS dataset, issued_date >= DATE '{VIOLATION_AS_OF}' - INTERVAL 84 MONTH AS retained,
       CAST(count(*) AS BIGINT) AS rows FROM violations GROUP BY 2
UNION ALL
SELECT 'api_logs', CAST(ts AS DATE) >= DATE '{EVENT_AS_OF}' - 90, CAST(count(*) AS BIGINT) FROM requests GROUP BY 2
UNION ALL
SELECT 'metrics', hour >= DATE '{EVENT_AS_OF}' - INTERVAL 12 MONTH, CAST(count(*) AS BIGINT)
FROM (SELECT DISTINCT date_trunc('hour', ts) AS hour, endpoint FROM requests) GROUP BY 2""")
def q_retention_split(spark, d):
    """rows inside and outside the retention of their class; the metrics are hourly request counts."""
    v = _v(spark, d)
    requests = v.requests()
    metrics = requests.groupBy(F.date_trunc("hour", "ts").alias("hour"), "endpoint").agg(F.count(F.lit(1)).alias("n"))
    parts = [L.retained_rows(v.violations(), "violations", "issued_date", VIOLATION_AS_OF),
             L.retained_rows(requests, "api_logs", "ts", EVENT_AS_OF),
             L.retained_rows(metrics, "metrics", "hour", EVENT_AS_OF)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("compliance_report", f"""
SELECT {VCOLS_SQL} FROM violations
WHERE property_id IN (SELECT property_id FROM properties WHERE tenant_id = '{TENANT}')
  AND issued_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' AND NOT is_resolved""")
def q_compliance_report(spark, d):
    v = _v(spark, d)
    ids = L.tenant_scope(v.properties(), TENANT).select("property_id")
    rep = L.compliance_report(v.violations(), ids, "1998-01-01", "1998-12-31", include_resolved=False)
    from parcelwise.operators import sinks as SK
    return SK.round_trip(spark, rep, scratch_path(spark, "report"), "json")


@query("hash_keys", """
SELECT order_key, line_no,
       md5('line_no=' || CAST(line_no AS VARCHAR) || '|order_key=' || CAST(order_key AS VARCHAR)) AS md5_key,
       sha256('line_no=' || CAST(line_no AS VARCHAR) || '|order_key=' || CAST(order_key AS VARCHAR)) AS sha256_key
FROM violations""")
def q_hash_keys(spark, d):
    return L.hash_keys(_v(spark, d).violations())


# ------------------------------------------------------------ sort / limit
@query("high_risk_topk", f"""
WITH s AS (SELECT * FROM ({FEED_SCORED_SQL})) SELECT * FROM s ORDER BY compliance_risk_score DESC, bbl LIMIT 20""")
def q_high_risk_topk(spark, d):
    return L.high_risk_topk(_scored(spark, d), 20)


@query("property_page", "SELECT * FROM properties ORDER BY property_id LIMIT 20 OFFSET 40")
def q_property_page(spark, d):
    return L.page(_v(spark, d).properties(), ["property_id"], 40, 20)


@query("outreach_top5", f"""
WITH s AS ({PROPERTY_SCORE_SQL}),
h AS (SELECT p.tenant_id, p.property_id, p.address, p.bbl, p.year_built, s.risk_score, s.violation_count
      FROM properties p JOIN s ON p.property_id = s.property_id WHERE s.risk_score >= 70),
r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY risk_score DESC, property_id) AS rank FROM h)
SELECT * EXCLUDE (rank), CAST(rank AS INTEGER) AS rank,
       CASE WHEN year_built IS NOT NULL AND year_built < 1960 THEN 'Era Risk: 3.8x multiplier (Pre-1960)'
            WHEN year_built IS NOT NULL AND year_built < 1974 THEN 'Era Risk: 2.5x multiplier (Pre-1974)' END AS era_note
FROM r WHERE rank <= 5""")
def q_outreach_top5(spark, d):
    v = _v(spark, d)
    s = S.property_scores(v.violations())
    h = (v.properties().select("tenant_id", "property_id", "address", "bbl", "year_built")
         .join(s.select("property_id", "risk_score", "violation_count"), "property_id")
         .filter(F.col("risk_score") >= D.HIGH_RISK_SCORE))
    top = W.top_n_per_key(h, ["tenant_id"], [F.desc("risk_score"), F.asc("property_id")], 5)
    y = F.col("year_built")
    return top.withColumn("era_note", F.when(y.isNotNull() & (y < 1960), "Era Risk: 3.8x multiplier (Pre-1960)")
                          .when(y.isNotNull() & (y < 1974), "Era Risk: 2.5x multiplier (Pre-1974)"))


@query("portfolio_cards", f"""
WITH s AS ({PROPERTY_SCORE_SQL})
SELECT p.tenant_id, p.property_id, p.address, p.year_built, s.risk_score
FROM properties p LEFT JOIN s ON p.property_id = s.property_id
ORDER BY p.tenant_id, s.risk_score DESC NULLS LAST, p.year_built NULLS LAST, p.property_id""")
def q_portfolio_cards(spark, d):
    """T5: display order (risk desc, then year asc).  A global sort range-partitions
    on the whole key, so one large tenant is spread over many tasks."""
    v = _v(spark, d)
    s = S.property_scores(v.violations())
    return (v.properties().join(s, "property_id", "left")
            .select("tenant_id", "property_id", "address", "year_built", "risk_score")
            .orderBy("tenant_id", F.desc_nulls_last("risk_score"), F.asc_nulls_last("year_built"), "property_id"))


# -------------------------------------------------------------- set ops
@query("canonical_violations", """
SELECT 'HPD-' || CAST(order_key AS VARCHAR) || '-' || CAST(line_no AS VARCHAR) AS external_id, property_id,
       'HPD' AS source, violation_class AS violation_type, 'HPD class ' || violation_class AS description,
       (CASE WHEN is_resolved THEN 'Close' ELSE 'Open' END) <> 'Open' AS is_resolved
FROM violations WHERE source = 'HPD'
UNION ALL
SELECT 'DOB-' || CAST(order_key AS VARCHAR) || '-' || CAST(line_no AS VARCHAR), property_id, 'DOB', violation_class,
       NULL, upper(COALESCE(CASE WHEN is_resolved THEN 'RESOLVED' END, '')) IN ('RESOLVED', 'DISMISSED', 'CLOSED')
FROM violations WHERE source = 'DOB'
UNION ALL
SELECT 'FDNY-' || CAST(order_key AS VARCHAR) || '-' || CAST(line_no AS VARCHAR), property_id, 'FDNY', violation_class,
       NULL, is_resolved
FROM violations WHERE source = 'FDNY'""")
def q_canonical(spark, d):
    return L.canonical_violations(_v(spark, d).violations())


@query("bbl_universe", """
SELECT DISTINCT p.bbl FROM violations v JOIN properties p ON v.property_id = p.property_id
UNION
SELECT DISTINCT p.bbl FROM complaints c JOIN properties p ON c.property_id = p.property_id""")
def q_bbl_universe(spark, d):
    v = _v(spark, d)
    p = v.properties().select("property_id", "bbl")
    return L.bbl_universe(v.violations().join(p, "property_id"), v.complaints().join(p, "property_id"))


@query("dedup_violations", f"""
SELECT {VCOLS_SQL} FROM (
  SELECT *, row_number() OVER (PARTITION BY order_key, line_no
      ORDER BY issued_date DESC, property_id DESC, supp_key DESC, violation_class DESC, source DESC, is_resolved DESC,
               resolved_date DESC, risk_score DESC, fine_amount DESC, quantity DESC, extended_price DESC) AS rn
  FROM violations) WHERE rn = 1""")
def q_dedup_violations(spark, d):
    v = _v(spark, d).violations()
    return L.dedup_on_key(v, ["order_key", "line_no"], ["issued_date"])


# ------------------------------------------------------------ maintenance
@query("property_insert", """
WITH inc AS (SELECT building_class AS tenant_id, bbl FROM properties
             UNION ALL
             SELECT tenant_id, bbl FROM properties WHERE property_id IN (SELECT property_id FROM complaints)),
k AS (SELECT DISTINCT tenant_id, bbl FROM inc)
SELECT tenant_id, bbl, CASE WHEN EXISTS (SELECT 1 FROM properties p WHERE p.tenant_id = k.tenant_id AND p.bbl = k.bbl)
                            THEN 'rejected' ELSE 'inserted' END AS status
FROM k""")
def q_property_insert(spark, d):
    """A registration batch — every parcel re-registered under its building-class
    portfolio (new keys) plus the parcels with complaints re-sent by their own tenant
    (duplicates, rejected)."""
    v = _v(spark, d)
    p = v.properties()
    cols = ["tenant_id", "bbl", "address", "units", "year_built"]
    inc = (p.select(F.col("building_class").alias("tenant_id"), *cols[1:])
           .unionByName(p.join(v.complaints().select("property_id"), "property_id", "left_semi").select(*cols)))
    merged, rejected = L.insert_if_absent(p.select(*cols), inc, ["tenant_id", "bbl"])
    inserted = merged.join(p.select("tenant_id", "bbl"), ["tenant_id", "bbl"], "left_anti")
    return (inserted.select("tenant_id", "bbl", F.lit("inserted").alias("status"))
            .unionByName(rejected.select("tenant_id", "bbl", F.lit("rejected").alias("status"))))


@query("property_update", """
WITH c AS (SELECT DISTINCT property_id FROM violations WHERE violation_class = 'C' AND NOT is_resolved)
SELECT p.property_id, p.tenant_id, p.bbl, p.units,
       CASE WHEN p.year_built > 2025 THEN NULL ELSE p.year_built END AS year_built,
       CASE WHEN p.property_id IN (SELECT property_id FROM c) THEN true ELSE p.is_monitored END AS is_monitored
FROM properties p""")
def q_property_update(spark, d):
    """A partial update — out-of-range years are cleared (an explicit NULL is
    applied) and properties with an open class-C violation are switched to monitored;
    no other field changes."""
    v = _v(spark, d)
    p = v.properties().select("property_id", "tenant_id", "bbl", "units", "year_built", "is_monitored")
    bad_year = (p.filter(F.col("year_built") > 2025)
                .select("property_id", F.lit(None).cast("int").alias("year_built"), F.lit(True).alias("year_built_set")))
    open_c = (v.violations().filter((F.col("violation_class") == "C") & ~F.col("is_resolved"))
              .select("property_id").distinct()
              .select("property_id", F.lit(True).alias("is_monitored"), F.lit(True).alias("is_monitored_set")))
    changes = bad_year.join(open_c, "property_id", "full")
    return L.partial_update(p, changes, "property_id", ["year_built", "is_monitored"])


@query("property_delete", """
SELECT p.* FROM properties p WHERE p.is_monitored""")
def q_property_delete(spark, d):
    """Each tenant deletes its unmonitored properties (delete keys are tenant-scoped)."""
    p = _v(spark, d).properties()
    dels = p.filter(~F.col("is_monitored")).select("tenant_id", "property_id")
    return L.delete_by_key(p, dels, ["tenant_id", "property_id"])


@query("portfolio_semi", f"""
SELECT {VCOLS_SQL} FROM violations v
WHERE EXISTS (SELECT 1 FROM properties p WHERE p.property_id = v.property_id AND p.council_district IS NOT NULL
              AND p.tenant_id = '{TENANT}')""")
def q_portfolio_semi(spark, d):
    """Violations of the tenant's properties that sit in a known district."""
    v = _v(spark, d)
    members = (L.tenant_scope(v.properties(), TENANT).filter(F.col("council_district").isNotNull())
               .select("property_id"))
    return L.semi(v.violations(), members, "property_id")


# ------------------------------------------------------- base tables
@query("src_users", "SELECT * FROM users")
def q_src_users(spark, d):
    return Tables(spark, d).views.users()


@query("src_tenants", "SELECT * FROM tenants")
def q_src_tenants(spark, d):
    return Tables(spark, d).views.tenants()


@query("src_audit_logs", "SELECT * FROM audit_logs")
def q_src_audit_logs(spark, d):
    return Tables(spark, d).views.audit_logs()


@query("src_api_keys", "SELECT * FROM api_keys")
def q_src_api_keys(spark, d):
    return Tables(spark, d).views.api_keys()
