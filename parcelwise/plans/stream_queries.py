"""Registered streaming queries.

Each callable runs a Structured Streaming job over file streams of the driver's
tables with ``trigger(availableNow=True)``, writes to parquet under the shared
checkpoint folder, and returns the written result as a DataFrame.  The DuckDB
oracle states what the stream must have emitted (for append-mode windows:
the windows closed by the final watermark = max event time − delay).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelwise.operators import limiters as LIM
from parcelwise.operators import windows as W
from parcelwise.operators import feed as FE
from parcelwise.functions import dims as D
from parcelwise.plans.batch_queries import FEED_SCORED_SQL, VIOLATION_AS_OF, feed_sources
from parcelwise.plans.registry import query
from parcelwise.sources.tables import Tables
from parcelwise.streaming import connections as C
from parcelwise.streaming import incremental as I
from parcelwise.streaming import jobs as J

SUBS_SQL = """
SELECT connection, property_id FROM (
  SELECT connection, property_id, action,
         row_number() OVER (PARTITION BY connection, property_id ORDER BY ts DESC, seq DESC) AS rn
  FROM subscriptions) WHERE rn = 1 AND action = 'SUBSCRIBE'"""

# Sliding-log and token-bucket policies used by the registered runs.
SLIDING_MAX, SLIDING_WINDOW_S = 2, 12 * 3600
BUCKET_RATE, BUCKET_PER_S = 2, 12 * 3600.0


def _b(spark, d):
    return Tables(spark, d).views


def _s(spark, d):
    return J.streaming_tables(spark, d).views


def _read(spark, path, drop=("epoch",)):
    df = spark.read.parquet(path)
    return df.drop(*[c for c in drop if c in df.columns])


def _current_subs_batch(spark, d):
    return J.current_subscriptions(J.subscription_state(_b(spark, d).subscriptions()))


# --------------------------------------------------------------- subscriptions
@query("subscriptions_current", SUBS_SQL)
def q_subscriptions_current(spark, d):
    """ST1: fold the subscription changelog in a stream (complete-mode state, table overwritten per epoch)."""
    st = J.subscription_state(_s(spark, d).subscriptions())
    out = J.run_available_now(spark, st, "subscriptions", "complete", J.overwrite_sink)
    return J.current_subscriptions(_read(spark, out))


@query("subscription_stats", f"""
WITH s AS ({SUBS_SQL})
SELECT CAST(count(DISTINCT connection) AS BIGINT) AS active_connections, CAST(count(*) AS BIGINT) AS total_subscriptions,
       CAST(count(DISTINCT property_id) AS BIGINT) AS unique_properties,
       CAST(count(DISTINCT connection) FILTER (WHERE connection IN (SELECT account_key FROM accounts)) AS BIGINT)
         AS authenticated_connections
FROM s""")
def q_subscription_stats(spark, d):
    """A21 over the current subscriptions; a connection is authenticated when it is a known account."""
    s = _current_subs_batch(spark, d)
    acc = _b(spark, d).accounts().select(F.col("account_key").alias("connection"), F.lit(True).alias("_auth"))
    j = s.join(acc, "connection", "left")
    return j.agg(F.count_distinct("connection").alias("active_connections"),
                 F.count(F.lit(1)).alias("total_subscriptions"),
                 F.count_distinct("property_id").alias("unique_properties"),
                 F.count_distinct(F.when(F.col("_auth"), F.col("connection"))).alias("authenticated_connections"))


# ------------------------------------------------------------ connection state
PING_LIMIT_S = 3 * 86_400        # registered runs: connections ping every few days in these tables

CONNECTIONS_SQL = f"""
WITH RECURSIVE m AS (SELECT *, row_number() OVER (PARTITION BY connection ORDER BY ts, message_id) AS rn FROM protocol_messages
                     WHERE ts <= (SELECT max(ts) - INTERVAL 1 DAY FROM protocol_messages)),
r AS (
  SELECT connection, rn, ts, type, property_id, ts AS last_ping, COALESCE(type = 'AUTHENTICATE', false) AS auth, 1 AS life FROM m WHERE rn = 1
  UNION ALL
  SELECT m.connection, m.rn, m.ts, m.type, m.property_id,
         CASE WHEN m.type = 'PING' OR m.ts > r.last_ping + INTERVAL {PING_LIMIT_S} SECOND THEN m.ts ELSE r.last_ping END,
         COALESCE(m.type = 'AUTHENTICATE', false) OR (r.auth AND m.ts <= r.last_ping + INTERVAL {PING_LIMIT_S} SECOND),
         r.life + CASE WHEN m.ts > r.last_ping + INTERVAL {PING_LIMIT_S} SECOND THEN 1 ELSE 0 END
  FROM r JOIN m ON m.connection = r.connection AND m.rn = r.rn + 1),
e AS (SELECT * FROM r QUALIFY rn = max(rn) OVER (PARTITION BY connection)),
alive AS (SELECT * FROM e WHERE last_ping + INTERVAL {PING_LIMIT_S} SECOND >= (SELECT max(ts) - INTERVAL 1 DAY FROM protocol_messages)),
s AS (SELECT r.connection, r.property_id, max_by(r.type, r.rn) AS type FROM r JOIN alive a ON a.connection = r.connection AND a.life = r.life
      WHERE r.property_id IS NOT NULL AND (r.type = 'UNSUBSCRIBE' OR r.type = 'SUBSCRIBE' AND r.auth) GROUP BY 1, 2)"""


def _connection_changes(spark, d, name):
    changes = C.connection_changes(_s(spark, d).protocol_messages(), PING_LIMIT_S)
    return _read(spark, J.run_available_now(spark, changes, name, keyed=True))


@query("connection_subscriptions", f"""{CONNECTIONS_SQL}
SELECT connection, property_id FROM s WHERE type = 'SUBSCRIBE'""")
def q_connection_subscriptions(spark, d):
    """ST1: subscriptions after authentication, unsubscribing and dropped connections, from the stream's changes."""
    return C.subscriptions_of(_connection_changes(spark, d, "connections"))


@query("connection_stats", f"""{CONNECTIONS_SQL}
SELECT CAST((SELECT count(*) FROM alive) AS BIGINT) AS active_connections,
       CAST((SELECT count(*) FROM alive WHERE auth) AS BIGINT) AS authenticated_connections,
       CAST(count(*) AS BIGINT) AS total_subscriptions, CAST(count(DISTINCT property_id) AS BIGINT) AS unique_properties
FROM s WHERE type = 'SUBSCRIBE'""")
def q_connection_stats(spark, d):
    """A21 from the connection state: open and authenticated connections."""
    return C.connection_stats(_connection_changes(spark, d, "connection-stats"))


@query("stream_queue", f"""
WITH s AS ({SUBS_SQL}), u AS (SELECT * FROM updates),
f AS (SELECT s.connection, u.property_id, u.update_id, u.severity, u.ts FROM u JOIN s ON u.property_id = s.property_id)
SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY connection ORDER BY ts DESC, update_id DESC) <= 100""")
def q_stream_queue(spark, d):
    """ST5 in a stream: a ring of 100 undelivered messages a connection."""
    sent = J.fanout(_s(spark, d).updates(), _current_subs_batch(spark, d)).withColumn("kind", F.lit("MESSAGE"))
    changes = _read(spark, J.run_available_now(spark, C.undelivered(sent, 100), "queue", "update", J.append_sink, keyed=True))
    return C.queue_of(changes).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_fanout", f"""
WITH s AS ({SUBS_SQL}), u AS (SELECT * FROM updates)
SELECT u.property_id, u.update_id, u.update_type, u.severity, u.ts, s.connection FROM u JOIN s ON u.property_id = s.property_id""")
def q_stream_fanout(spark, d):
    """ST2/K5: update stream ⋈ current subscriptions (static) → one row per subscriber; hot properties in slices."""
    sink = J.fanout_sink(_current_subs_batch(spark, d))
    return _read(spark, J.run_available_now(spark, _s(spark, d).updates(), "fanout", "append", sink))


@query("queue_last_100", f"""
WITH s AS ({SUBS_SQL}), u AS (SELECT * FROM updates),
f AS (SELECT u.property_id, u.update_id, u.severity, u.ts, s.connection FROM u JOIN s ON u.property_id = s.property_id),
r AS (SELECT *, row_number() OVER (PARTITION BY connection ORDER BY ts DESC, update_id DESC) AS rank FROM f)
SELECT * EXCLUDE (rank), CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 100""")
def q_queue_last_100(spark, d):
    """W7/ST5: the newest 100 undelivered messages per connection."""
    newest = [F.desc("ts"), F.desc("update_id")]
    # a connection's newest 100 are among the newest 100 of each of its properties
    updates = W.top_n_per_key(_b(spark, d).updates(), ["property_id"], newest, 100, rank_col=None)
    fan = J.fanout(updates, _current_subs_batch(spark, d)).select("property_id", "update_id", "severity", "ts", "connection")
    return W.top_n_per_key(fan, ["connection"], newest, 100)


ROUTING_SQL = f"""
WITH s AS ({SUBS_SQL}), u AS (SELECT * FROM updates),
f AS (SELECT u.property_id, u.update_id, u.severity, u.ts, s.connection FROM u JOIN s ON u.property_id = s.property_id),
j AS (SELECT f.*, a.tier FROM f JOIN accounts a ON f.connection = a.account_key),
e AS (SELECT * FROM j WHERE CASE severity WHEN 'CRITICAL' THEN true WHEN 'HIGH' THEN tier IN ('pro', 'enterprise')
                                 ELSE tier = 'enterprise' END),
c AS (SELECT e.*, hour(ts) >= 22 OR hour(ts) < 7 AS quiet, ch.channel FROM e, (VALUES ('sms'), ('email')) ch(channel))
SELECT update_id, connection, property_id, severity, ts, quiet, channel,
       CASE WHEN channel = 'sms' AND quiet THEN 'held' ELSE 'send' END AS status
FROM c"""


def _route(spark, d, name, status=None):
    settings = J.alert_settings(_b(spark, d).accounts())

    def then(sent):
        rows = J.alert_routing(sent, settings)
        return rows if status is None else rows.filter(F.col("status") == status)
    sink = J.fanout_sink(_current_subs_batch(spark, d), then)
    return _read(spark, J.run_available_now(spark, _s(spark, d).updates(), name, "append", sink))


@query("alert_routing", ROUTING_SQL)
def q_alert_routing(spark, d):
    """ST9: class toggles by plan, quiet hours 22→7 wrapping midnight (SMS held, email sent)."""
    return _route(spark, d, "routing")


@query("alert_outbox", f"SELECT * FROM ({ROUTING_SQL}) WHERE status = 'send'")
def q_alert_outbox(spark, d):
    """K6: the deliverable (event, channel, target) rows, appended per micro-batch."""
    return _route(spark, d, "outbox", "send")


# ------------------------------------------------------------------- limiters
SLIDING_SQL = f"""
WITH RECURSIVE r AS (SELECT client, request_id, ts,
                            row_number() OVER (PARTITION BY client ORDER BY ts, request_id) AS rn FROM requests),
s AS (
  SELECT client, rn, request_id, ts, {SLIDING_MAX} >= 1 AS admitted, [ts] AS log FROM r WHERE rn = 1
  UNION ALL
  SELECT r.client, r.rn, r.request_id, r.ts,
         len(list_filter(s.log, lambda x: x >= r.ts - INTERVAL {SLIDING_WINDOW_S} SECOND)) < {SLIDING_MAX},
         CASE WHEN len(list_filter(s.log, lambda x: x >= r.ts - INTERVAL {SLIDING_WINDOW_S} SECOND)) < {SLIDING_MAX}
              THEN list_append(list_filter(s.log, lambda x: x >= r.ts - INTERVAL {SLIDING_WINDOW_S} SECOND), r.ts)
              ELSE list_filter(s.log, lambda x: x >= r.ts - INTERVAL {SLIDING_WINDOW_S} SECOND) END
  FROM s JOIN r ON r.client = s.client AND r.rn = s.rn + 1)
SELECT client, request_id, ts, admitted FROM s"""

BUCKET_SQL = f"""
WITH RECURSIVE r AS (SELECT client, request_id, ts,
                            row_number() OVER (PARTITION BY client ORDER BY ts, request_id) AS rn FROM requests),
s AS (
  SELECT client, rn, request_id, ts, true AS admitted, CAST({BUCKET_RATE} AS DOUBLE) - 1.0 AS allowance FROM r WHERE rn = 1
  UNION ALL
  SELECT client, rn, request_id, ts, a >= 1.0, CASE WHEN a >= 1.0 THEN a - 1.0 ELSE a END
  FROM (SELECT r.client, r.rn, r.request_id, r.ts,
               least(s.allowance + ((epoch_us(r.ts) - epoch_us(s.ts)) / 1e6::DOUBLE)
                     * (CAST({BUCKET_RATE} AS DOUBLE) / {BUCKET_PER_S}::DOUBLE), CAST({BUCKET_RATE} AS DOUBLE)) AS a
        FROM s JOIN r ON r.client = s.client AND r.rn = s.rn + 1))
SELECT client, request_id, ts, admitted FROM s"""


@query("rate_limit_sliding", SLIDING_SQL)
def q_rate_limit_sliding(spark, d):
    """ST3 in a stream: per-client admitted log in ``applyInPandasWithState``."""
    st = J.limiter_stream(_s(spark, d).requests(), "sliding", max_messages=SLIDING_MAX,
                          window_seconds=SLIDING_WINDOW_S)
    return LIM.latest(_read(spark, J.run_available_now(spark, st, "sliding")))


@query("rate_limit_sliding_batch", SLIDING_SQL)
def q_rate_limit_sliding_batch(spark, d):
    """ST3 batch twin: fold per (client, idle-gap segment)."""
    return LIM.rate_limit_sliding(_b(spark, d).requests(), SLIDING_MAX, SLIDING_WINDOW_S)


@query("rate_limit_token_bucket", BUCKET_SQL)
def q_rate_limit_token_bucket(spark, d):
    """ST4 in a stream: (allowance, last) per client."""
    st = J.limiter_stream(_s(spark, d).requests(), "bucket", rate=BUCKET_RATE, per=BUCKET_PER_S)
    return LIM.latest(_read(spark, J.run_available_now(spark, st, "bucket")))


@query("rate_limit_token_bucket_batch", BUCKET_SQL)
def q_rate_limit_token_bucket_batch(spark, d):
    return LIM.rate_limit_token_bucket(_b(spark, d).requests(), BUCKET_RATE, BUCKET_PER_S)


# -------------------------------------------------------------- windows
@query("connection_sessions", """
WITH r AS (SELECT client, ts, lag(ts) OVER (PARTITION BY client ORDER BY ts, request_id) AS prev FROM requests),
g AS (SELECT client, ts, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
                          OVER (PARTITION BY client ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM r),
s AS (SELECT client, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end,
             CAST(count(*) AS BIGINT) AS requests, max(ts) AS last_ping,
             (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS uptime_seconds FROM g GROUP BY client, sid)
SELECT * FROM s WHERE session_end <= (SELECT max(ts) FROM requests) - INTERVAL 1 DAY""")
def q_connection_sessions(spark, d):
    """ST6: session windows (30 min gap) per client, emitted once the watermark closes them."""
    return _read(spark, J.run_available_now(spark, J.connection_sessions(_s(spark, d).requests()), "sessions"))


@query("stream_new_violations", "SELECT DISTINCT source, order_key, line_no FROM violations")
def q_stream_new_violations(spark, d):
    """ST7: records unseen by (source, external id), for all time."""
    keys = ["source", "order_key", "line_no"]
    out = J.run_available_now(spark, _s(spark, d).violations().select(*keys), "new-violations", "append", I.new_records_sink(keys))
    return I.table(spark, out).select(*keys)


HEAT_WIN_SQL = """
WITH h AS (SELECT property_id, created FROM complaints WHERE complaint_type = 'HEAT/HOT WATER'),
w AS (SELECT h.property_id, date_trunc('day', h.created) - k * INTERVAL 1 DAY AS window_start
      FROM h, range(0, 30) t(k)),
a AS (SELECT property_id, window_start, window_start + INTERVAL 30 DAY AS window_end,
             CAST(count(*) AS BIGINT) AS complaints FROM w GROUP BY 1, 2)
SELECT * FROM a WHERE complaints >= 3
  AND window_end <= (SELECT max(created) FROM h) - INTERVAL 1 DAY"""


@query("stream_heat_alerts", HEAT_WIN_SQL)
def q_stream_heat_alerts(spark, d):
    """ST8: 30-day complaint velocity per property, sliding by a day; alert at ≥ 3."""
    out = J.run_available_now(spark, J.heat_panes(_s(spark, d).complaints()), "heat-panes")
    return J.heat_alerts(_read(spark, out), J.final_watermark(spark, out))


@query("weekly_digest", """
WITH c AS (SELECT property_id, created, complaint_type,
                  TIMESTAMP '1970-01-05 09:00:00' + INTERVAL 7 DAY *
                    CAST(floor((epoch_us(created) - epoch_us(TIMESTAMP '1970-01-05 09:00:00')) / 604800000000.0) AS BIGINT)
                    AS week_start FROM complaints)
SELECT property_id, week_start, CAST(count(*) AS BIGINT) AS complaints,
       CAST(count(*) FILTER (WHERE complaint_type = 'HEAT/HOT WATER') AS BIGINT) AS heat_complaints
FROM c GROUP BY property_id, week_start
HAVING week_start + INTERVAL 7 DAY <= (SELECT max(created) FROM complaints) - INTERVAL 1 DAY""")
def q_weekly_digest(spark, d):
    """ST10: weekly per-property digest, weeks starting Monday 09:00."""
    return _read(spark, J.run_available_now(spark, J.weekly_digest(_s(spark, d).complaints()), "weekly"))


@query("webhook_match", """
WITH v AS (SELECT p.tenant_id, v.property_id, v.order_key, v.line_no, v.issued_date, v.resolved_date
           FROM violations v JOIN properties p ON v.property_id = p.property_id),
e AS (SELECT tenant_id, property_id, order_key, line_no, 'violation.new' AS event_type, issued_date AS event_date FROM v
      UNION ALL
      SELECT tenant_id, property_id, order_key, line_no, 'violation.resolved', resolved_date FROM v
      WHERE resolved_date IS NOT NULL),
h AS (SELECT DISTINCT tenant_id, 'hook-' || tenant_id AS hook_id,
             CAST(regexp_extract(tenant_id, '(\\d+)$', 1) AS INTEGER) % 2 = 0 AS all_events FROM properties)
SELECT e.*, h.hook_id FROM e JOIN h ON e.tenant_id = h.tenant_id
WHERE h.all_events OR e.event_type = 'violation.new'""")
def q_webhook_match(spark, d):
    """ST11: violation events streamed from the violation table, matched to active hooks."""
    p = _b(spark, d).properties()
    wanted = J.wanted_events(p, J.webhook_hooks(p))
    return _read(spark, J.run_available_now(spark, _s(spark, d).violations(), "webhooks", foreach_batch=J.webhook_sink(wanted)))


@query("stream_counters", """
SELECT update_type AS message_type, 'outbound' AS direction, CAST(count(*) AS BIGINT) AS messages
FROM updates GROUP BY 1""")
def q_stream_counters(spark, d):
    """ST12: running counts, complete mode, table replaced per epoch."""
    st = J.stream_counters(_s(spark, d).updates())
    return _read(spark, J.run_available_now(spark, st, "counters", "complete", J.overwrite_sink))


WIN5_SQL = """
SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, ts, is_error, latency FROM requests"""


@query("error_rate_5m", f"""
WITH w AS ({WIN5_SQL})
SELECT window_start, CAST(count(*) AS BIGINT) AS requests, CAST(count(*) FILTER (WHERE is_error) AS BIGINT) AS errors,
       round_even(count(*) FILTER (WHERE is_error) / 300.0::DOUBLE, 6) AS errors_per_second,
       count(*) FILTER (WHERE is_error) / 300.0::DOUBLE > 0.05 AS alert
FROM w GROUP BY window_start
HAVING window_start + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM requests) - INTERVAL 10 MINUTE""")
def q_error_rate_5m(spark, d):
    """ST13: 5xx per second over 5-minute windows."""
    return _read(spark, J.run_available_now(spark, J.error_rate_5m(_s(spark, d).requests()), "error-rate"))


BREACH_THRESHOLD = 150.0   # p95 latency units of the request log


@query("p95_latency_5m", f"""
WITH w AS ({WIN5_SQL})
SELECT window_start, CAST(count(*) AS BIGINT) AS requests, quantile_disc(latency, 0.95) AS p95_latency,
       quantile_disc(latency, 0.95) > {BREACH_THRESHOLD} AS alert
FROM w GROUP BY window_start
HAVING window_start + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM requests) - INTERVAL 10 MINUTE""")
def q_p95_latency_5m(spark, d):
    """ST13: the stream keeps a sketch per window; the percentile of a closed window is exact."""
    sketches = _read(spark, J.run_available_now(spark, J.latency_sketch_5m(_s(spark, d).requests()), "p95"))
    return J.p95_from_sketches(sketches, _b(spark, d).requests(), BREACH_THRESHOLD)


@query("sustained_breach", f"""
WITH w AS ({WIN5_SQL}),
p AS (SELECT window_start FROM w GROUP BY window_start HAVING quantile_disc(latency, 0.95) > {BREACH_THRESHOLD}),
g AS (SELECT window_start, CAST(epoch_us(window_start) / 300000000 AS BIGINT) - row_number() OVER (ORDER BY window_start) AS grp FROM p),
i AS (SELECT min(window_start) AS breach_start, max(window_start) + INTERVAL 300 SECOND AS breach_end,
             CAST(count(*) AS BIGINT) AS windows FROM g GROUP BY grp)
SELECT * FROM i WHERE windows >= 2""")
def q_sustained_breach(spark, d):
    """ST14: p95 latency above the threshold for ≥ 10 minutes (two consecutive 5-minute windows)."""
    r = _b(spark, d).requests()
    counts = (r.groupBy(F.window(F.col("ts").cast("timestamp"), "5 minutes"), "latency").agg(F.count(F.lit(1)).alias("requests"))
              .select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "latency", "requests"))
    return J.sustained_breach(J.p95_latency(counts, BREACH_THRESHOLD), "alert", "window_start", 300, 2)


@query("stream_sustained_breach", f"""
WITH w AS ({WIN5_SQL}),
p AS (SELECT 'p95_latency' AS rule, window_start FROM w GROUP BY window_start HAVING quantile_disc(latency, 0.95) > {BREACH_THRESHOLD}
      UNION ALL
      SELECT 'error_rate', window_start FROM w GROUP BY window_start HAVING count(*) FILTER (WHERE is_error) / 300.0::DOUBLE > 0.05),
g AS (SELECT *, CAST(epoch_us(window_start) / 300000000 AS BIGINT) - row_number() OVER (PARTITION BY rule ORDER BY window_start) AS grp FROM p),
i AS (SELECT rule, min(window_start) AS breach_start, max(window_start) + INTERVAL 300 SECOND AS breach_end,
             CAST(count(*) AS BIGINT) AS windows FROM g GROUP BY rule, grp)
SELECT * FROM i WHERE windows >= 2 AND breach_end + INTERVAL 450 SECOND <= (SELECT max(ts) FROM requests) - INTERVAL 10 MINUTE""")
def q_stream_sustained_breach(spark, d):
    """ST14 in a stream: window aggregate, then a session window for each alert rule."""
    rows = J.breach_stream(_s(spark, d).requests(), J.breach_rules(BREACH_THRESHOLD), 2)
    return _read(spark, J.run_available_now(spark, rows, "breach"))


def rescore_sink(props, complaints):
    """ST15: counts of changed properties in, the feed's buckets of their parcels out."""
    from parcelwise.functions import rules as R
    known: dict[str, bool] = {}      # whether any record has a class; until then the class filter is dropped

    def classed(rows):
        return bool(rows.agg(F.max(F.col("classed") > 0)).first()[0])

    def flips(batch, epoch, old):
        before = classed(old)
        known["some"] = before or classed(batch)
        return known["some"] != before

    def derive(rows, buckets):
        some = known.get("some", classed(rows) if "some" not in known else False)
        keyed = rows.withColumn("n", F.col("classed") if some else F.col("every")).filter("n > 0") \
            .groupBy("bbl").agg(F.sum("n").alias("total_violations"), F.sum("nb").alias("class_b_violations"))
        mine = props.filter(I.bucket_of("bbl").isin(buckets))
        return FE.feed_joined(keyed, FE.complaints_agg(complaints, mine)).withColumn(
            "compliance_risk_score", R.compliance_score("class_b_violations", "relevant_311_complaints", "total_violations")) \
            .withColumns({"data_freshness_date": F.lit(VIOLATION_AS_OF).cast("date"), "data_coverage_days": F.lit(D.FEED_DAYS_BACK),
                          "bucket": I.bucket_of("bbl")})

    upsert = I.upsert_sink("property_id", I.bucket_of("bbl"), derive, flips)

    def publish(batch, epoch, out):
        known.pop("some", None)
        upsert(batch.join(props.select("property_id", "bbl"), "property_id"), epoch, out)
    return publish


def rescore_counts(violations):
    """Per property: records of the feed's period, those with a class of A to C, and those of class B."""
    return FE.recent_hpd(violations, VIOLATION_AS_OF, D.FEED_DAYS_BACK).groupBy("property_id").agg(
        F.count(F.lit(1)).alias("every"), F.count_if(F.col("violation_class").isin("A", "B", "C")).alias("classed"),
        F.count_if(F.col("violation_class") == "B").alias("nb"))


@query("stream_rescore", FEED_SCORED_SQL)
def q_stream_rescore(spark, d):
    """ST15: the stream emits the counts of changed properties (update mode); an epoch re-scores and writes the
    buckets of their parcels only."""
    b = _b(spark, d)
    sink = rescore_sink(b.properties(), feed_sources(b)[1])
    out = J.run_available_now(spark, rescore_counts(_s(spark, d).violations()), "rescore", "update", sink)
    return I.latest(spark, f"{out}/published").drop("epoch", "bucket")


@query("stream_complaint_conversion", """
WITH h AS (SELECT unique_key, property_id, created FROM complaints WHERE complaint_type = 'HEAT/HOT WATER'),
f AS (SELECT h.*, (SELECT min(issued) FROM class_c_events v WHERE v.property_id = h.property_id
                   AND v.issued >= h.created) AS nxt FROM h),
wm AS (SELECT max(t) - INTERVAL 1 DAY AS wm FROM (SELECT created AS t FROM h UNION ALL SELECT issued FROM class_c_events))
SELECT unique_key, property_id, created,
       CASE WHEN nxt <= created + INTERVAL 14 DAY THEN nxt END AS first_violation,
       COALESCE(nxt <= created + INTERVAL 14 DAY, false) AS converted
FROM f, wm WHERE nxt IS NOT NULL OR created + INTERVAL 14 DAY < wm.wm""")
def q_stream_complaint_conversion(spark, d):
    """J13 in a stream: per-property pending complaints in state, closed by the next
    class-C record or by the watermark passing their 14-day horizon."""
    s = _s(spark, d)
    st = J.stream_conversion_state(s.complaints(), s.class_c_events(), 14)
    return J.conversion_result(_read(spark, J.run_available_now(spark, st, "conversion")))


@query("stream_conversion_join", """
WITH h AS (SELECT unique_key, property_id, created FROM complaints WHERE complaint_type = 'HEAT/HOT WATER'),
f AS (SELECT h.*, (SELECT min(issued) FROM class_c_events v WHERE v.property_id = h.property_id
                   AND v.issued >= h.created AND v.issued <= h.created + INTERVAL 14 DAY) AS first_violation FROM h),
wm AS (SELECT least((SELECT max(created) FROM h), (SELECT max(issued) FROM class_c_events)) - INTERVAL 1 DAY AS wm)
SELECT unique_key, property_id, created, first_violation, first_violation IS NOT NULL AS converted
FROM f, wm WHERE first_violation IS NOT NULL OR created + INTERVAL 14 DAY < wm.wm""")
def q_stream_conversion_join(spark, d):
    """J13 as a native stream-stream interval join; a complaint is decided by its first record or its horizon."""
    s = _s(spark, d)
    rows = J.conversion_join(s.complaints(), s.class_c_events(), 14)
    return J.conversion_result(_read(spark, J.run_available_now(spark, rows, "conversion-join")))


# ------------------------------------------------------------------ messages
def _messages(v):
    """Inbound protocol messages derived from the event log (JSON text, as received)."""
    t = F.col("event_type")
    mtype = (F.when(t == "click", "SUBSCRIBE").when(t == "view", "UNSUBSCRIBE").when(t == "signup", "AUTHENTICATE")
             .when(t == "purchase", "PING").otherwise("BROADCAST"))
    pid = F.when(F.col("value") > 50, F.concat(F.lit("p-"), F.col("user_id").cast("string"), F.lit("#")))
    body = F.to_json(F.struct(mtype.alias("type"), pid.alias("property_id"),
                              F.concat(F.lit("tok"), F.col("event_id").cast("string")).alias("token"),
                              F.lit("x").alias("debug")))
    return v.t.events.select(F.col("event_id").alias("message_id"), body.alias("raw"))


MSG_SQL = """
SELECT event_id AS message_id,
       CASE event_type WHEN 'click' THEN 'SUBSCRIBE' WHEN 'view' THEN 'UNSUBSCRIBE' WHEN 'signup' THEN 'AUTHENTICATE'
                       WHEN 'purchase' THEN 'PING' ELSE 'BROADCAST' END AS type,
       CASE WHEN value > 50 THEN 'p-' || CAST(user_id AS VARCHAR) || '#' END AS property_id
FROM events"""


@query("stream_validate", f"""
WITH m AS ({MSG_SQL})
SELECT message_id, type, property_id,
       type IN ('SUBSCRIBE', 'UNSUBSCRIBE', 'GET_STATUS', 'PING', 'AUTHENTICATE')
       AND (type NOT IN ('SUBSCRIBE', 'UNSUBSCRIBE') OR property_id IS NOT NULL) AS is_valid
FROM m""")
def q_stream_validate(spark, d):
    """parse with a schema, valid vs quarantine flag."""
    from parcelwise.streaming import messages as M
    msgs = _messages(J.streaming_tables(spark, d).views)
    return _read(spark, J.run_available_now(spark, M.validate(msgs), "validate"))


@query("stream_sanitise", f"""
WITH m AS ({MSG_SQL})
SELECT message_id, type, regexp_replace(property_id, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS property_id,
       'tok' || CAST(message_id AS VARCHAR) AS token
FROM m""")
def q_stream_sanitise(spark, d):
    """keep whitelisted fields; property ids keep letters and digits only (Unicode)."""
    from parcelwise.streaming import messages as M
    msgs = _messages(J.streaming_tables(spark, d).views)
    return _read(spark, J.run_available_now(spark, M.sanitise(msgs), "sanitise"))
