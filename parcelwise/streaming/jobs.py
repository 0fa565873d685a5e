"""Structured Streaming jobs (ST1–ST15, K5, K6, J13 stream).

Sources are file streams over the landed tables (``Tables(..., streaming=True)``);
event time is the NTZ column cast to ``timestamp`` (watermarks reject NTZ).
Every job writes to a sink under the shared checkpoint folder with its state in
a checkpoint next to it, so a restarted driver or a lost executor resumes from
the last committed batch.  ``run_available_now`` drains what is there and stops,
which is also how periodic re-scoring runs (a scheduler triggers it; no
scheduler lives here).
"""

from __future__ import annotations

import json
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.streaming.state import GroupStateTimeout

from parcelwise.functions import rules as R
from parcelwise.operators import limiters as LIM
from parcelwise.operators.windows import spread_join
from parcelwise.session import scratch_path
from parcelwise.sources.tables import Tables

WATERMARK = "1 day"


def event_time(df: DataFrame, col: str, out: str = "event_time") -> DataFrame:
    return df.withColumn(out, F.col(col).cast("timestamp"))


AUDIT = ("epoch long, input_rows long, state_rows long, dropped_by_watermark long, watermark string")


def audit_rows(progress) -> list[tuple]:
    """§2.10: per micro-batch the input, the rows in state, the rows that came behind the watermark, and the watermark."""
    return [(p["batchId"], p["numInputRows"], sum(o["numRowsTotal"] for o in p["stateOperators"]),
             sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"]), p["eventTime"].get("watermark"))
            for p in ({"eventTime": {}, **json.loads(x.json)} for x in progress)]


def audit(spark: SparkSession, out: str) -> DataFrame:
    """The audit table of a run, by its output path."""
    return spark.read.schema(AUDIT).parquet(f"{out.removesuffix('/out')}/audit")


def final_watermark(spark: SparkSession, out: str):
    """The last watermark of a run as a timestamp column value (NULL when there was none)."""
    return audit(spark, out).agg(F.max(F.to_timestamp("watermark").cast("timestamp_ntz"))).first()[0]


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """``transformWithState`` needs a state store with column families, which Spark's default one has not.  A stream
    keeps the conf it was started with, so the caller's own is put back after the start."""
    old = spark.conf.get(PROVIDER)
    if old.endswith(".HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, old)


def run_available_now(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append",
                      foreach_batch=None, base: str | None = None, keyed: bool = False) -> str:
    """Drain the stream into parquet under the checkpoint folder; return the output path.  ``base``: folder of an
    earlier run to go on from; ``keyed``: the stream holds a ``StatefulProcessor`` (``keyed_state``).  The progress of the run's micro-batches is appended to ``base/audit``."""
    base = base or scratch_path(spark, name)
    out, ckpt = f"{base}/out", f"{base}/_checkpoint"
    w = stream.writeStream.option("checkpointLocation", ckpt).outputMode(mode).trigger(availableNow=True)
    with keyed_state(spark) if keyed else nullcontext():
        if foreach_batch is not None:
            q = w.foreachBatch(lambda df, epoch: foreach_batch(df, epoch, out)).start()
        else:
            q = w.format("parquet").start(out)
    q.awaitTermination()
    spark.createDataFrame(audit_rows(q.recentProgress), AUDIT).coalesce(1).write.mode("append").parquet(f"{base}/audit")
    return out


def overwrite_sink(df: DataFrame, epoch: int, out: str) -> None:
    """Complete-mode result → replace the table (idempotent per epoch)."""
    df.write.mode("overwrite").parquet(out)


def append_sink(df: DataFrame, epoch: int, out: str) -> None:
    """Append one micro-batch as its own epoch folder, so a replayed epoch overwrites itself."""
    df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")


# ------------------------------------------------------------ subscriptions
def subscription_state(changes: DataFrame) -> DataFrame:
    """ST1: last action wins per (connection, property); ties on ts break on seq."""
    last = (changes.groupBy("connection", "property_id")
            .agg(F.max_by("action", F.struct("ts", "seq")).alias("last_action")))
    return last


def current_subscriptions(state: DataFrame) -> DataFrame:
    return state.filter(F.col("last_action") == "SUBSCRIBE").select("connection", "property_id")


def fanout(updates: DataFrame, subs: DataFrame) -> DataFrame:
    """ST2/K5: one row per (update, subscriber) — a stream-static equi-join."""
    return updates.join(subs, "property_id")


def sliced_fanout(updates: DataFrame, subs: DataFrame, rows: int = 100_000) -> DataFrame:
    """ST2/K5 of a micro-batch with hot properties spread over tasks.  A directory names the properties with more than
    ``rows`` subscribers or updates; their subscribers are cut into numbered slices and each update goes
    once to each slice, their updates are cut into numbered parts and each slice goes once to each part.  The directory has at most
    (updates + subscriptions) / rows rows, so it is broadcast."""
    pieces = lambda df, name: df.groupBy("property_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).alias(name)).filter(F.col(name) > 1)
    directory = F.broadcast(pieces(subs, "slices").join(pieces(updates, "parts"), "property_id", "full"))
    number = lambda c, n: F.pmod(F.xxhash64(c), F.coalesce(n, F.lit(1)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(n, F.lit(1)).cast("long") - 1))
    u = updates.join(directory, "property_id", "left")
    u = u.select(*updates.columns, number("update_id", F.col("parts")).alias("_part"), every(F.col("slices")).alias("_slice"))
    s = subs.join(directory, "property_id", "left")
    s = s.select(*subs.columns, number("connection", F.col("slices")).alias("_slice"), every(F.col("parts")).alias("_part"))
    return u.join(s, ["property_id", "_slice", "_part"]).drop("_slice", "_part")


def fanout_sink(subs: DataFrame, then=None, rows: int = 100_000):
    """Append the fan-out of each micro-batch (``then``: what is made of its rows)."""
    def publish(batch: DataFrame, epoch: int, out: str) -> None:
        sent = sliced_fanout(batch, subs, rows)
        append_sink(then(sent) if then else sent, epoch, out)
    return publish


# ------------------------------------------------------------------ alerts
def heat_panes(complaints: DataFrame) -> DataFrame:
    """ST8: heat complaints per property and day, one state row each, emitted once the watermark closes the day."""
    c = event_time(complaints.filter(F.col("complaint_type") == "HEAT/HOT WATER"), "created")
    agg = (c.withWatermark("event_time", WATERMARK).groupBy("property_id", F.window("event_time", "1 day"))
           .agg(F.count(F.lit(1)).alias("complaints")))
    return agg.select("property_id", F.col("window.start").cast("timestamp_ntz").alias("day"), "complaints")


def heat_alerts(panes: DataFrame, closed_until, days: int = 30, threshold: int = 3) -> DataFrame:
    """ST8: ``days``-day windows sliding by a day, combined from the panes; alert at ≥ threshold once the window is closed."""
    starts = F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("back")
    w = (panes.select("property_id", "day", "complaints", starts)
         .select("property_id", (F.col("day") - F.make_dt_interval("back")).alias("window_start"), "complaints")
         .groupBy("property_id", "window_start").agg(F.sum("complaints").alias("complaints")))
    end = F.col("window_start") + F.make_dt_interval(F.lit(days))
    return (w.filter((F.col("complaints") >= threshold) & (end <= F.lit(closed_until)))
            .select("property_id", "window_start", end.alias("window_end"), "complaints"))


def weekly_digest(complaints: DataFrame) -> DataFrame:
    """ST10: per property per week starting Monday 09:00 UTC (epoch day 0 is a Thursday)."""
    c = event_time(complaints, "created")
    agg = (c.withWatermark("event_time", WATERMARK)
           .groupBy("property_id", F.window("event_time", "7 days", "7 days", "4 days 9 hours"))
           .agg(F.count(F.lit(1)).alias("complaints"),
                F.count_if(F.col("complaint_type") == "HEAT/HOT WATER").alias("heat_complaints")))
    return agg.select("property_id", F.col("window.start").cast("timestamp_ntz").alias("week_start"),
                      "complaints", "heat_complaints")


def alert_settings(accounts: DataFrame) -> DataFrame:
    """Per-connection alert preferences by plan: class toggles, heat alerts, quiet hours 22→7."""
    t = F.col("tier")
    return accounts.select(
        F.col("account_key").alias("connection"),
        F.lit(True).alias("class_c_enabled"),
        t.isin("pro", "enterprise").alias("class_b_enabled"),
        (t == "enterprise").alias("class_a_enabled"),
        t.isin("pro", "enterprise").alias("heat_season_alerts"),
        F.lit(22).alias("quiet_hours_start"), F.lit(7).alias("quiet_hours_end"))


def alert_routing(fanned: DataFrame, settings: DataFrame) -> DataFrame:
    """ST9/K6: (update, subscriber) → channel rows.  Severity maps to class
    (CRITICAL→C, HIGH→B, else A); disabled classes are dropped; during quiet hours
    (wrapping midnight) SMS is held and email still sent."""
    cls = F.when(F.col("severity") == "CRITICAL", "C").when(F.col("severity") == "HIGH", "B").otherwise("A")
    j = fanned.join(settings, "connection")
    enabled = (F.when(cls == "C", F.col("class_c_enabled")).when(cls == "B", F.col("class_b_enabled"))
               .otherwise(F.col("class_a_enabled")))
    h = F.hour("ts")
    s, e = F.col("quiet_hours_start"), F.col("quiet_hours_end")
    quiet = F.when(s > e, (h >= s) | (h < e)).otherwise((h >= s) & (h < e))
    chans = F.explode(F.array(F.lit("sms"), F.lit("email"))).alias("channel")
    out = j.filter(enabled).select("update_id", "connection", "property_id", "severity", "ts", quiet.alias("quiet"), chans)
    return out.withColumn("status", F.when((F.col("channel") == "sms") & F.col("quiet"), "held").otherwise("send"))


def webhook_hooks(properties: DataFrame) -> DataFrame:
    """One hook per tenant: even brands subscribe to every event, odd ones to new violations only."""
    num = F.regexp_extract("tenant_id", r"(\d+)$", 1).cast("int")
    events = F.when(num % 2 == 0, R.lit_array(["violation.new", "violation.resolved", "risk.changed",
                                               "scan.completed"])).otherwise(R.lit_array(["violation.new"]))
    return (properties.select("tenant_id").distinct()
            .select(F.concat(F.lit("hook-"), F.col("tenant_id")).alias("hook_id"), "tenant_id",
                    events.alias("events"), F.lit(True).alias("is_active")))


def wanted_events(properties: DataFrame, hooks: DataFrame, shares: int = 4096) -> DataFrame:
    """ST11: (property_id, event_type, tenant_id, hook_id) of the active hooks' event lists; a tenant with a large
    share of the properties is dealt over tasks."""
    h = hooks.filter("is_active").select("hook_id", "tenant_id", F.explode("events").alias("event_type"))
    return spread_join(properties.select("property_id", "tenant_id"), h, "tenant_id", ["property_id"], shares)


def webhook_match(events: DataFrame, wanted: DataFrame, shares: int = 4096) -> DataFrame:
    """ST11: each event with the hooks that want it; a property's events of one type are dealt over tasks where they
    are a large share of all."""
    return spread_join(events, wanted, ["property_id", "event_type"], ["order_key", "line_no"], shares)


def violation_events(violations: DataFrame) -> DataFrame:
    """violation.new at issue, violation.resolved at resolution: one pass over the violations."""
    event = lambda kind, at: F.struct(F.lit(kind).alias("event_type"), F.col(at).alias("event_date"))
    both = F.array(event("violation.new", "issued_date"), event("violation.resolved", "resolved_date"))
    return violations.select("property_id", "order_key", "line_no", F.inline(both)) \
        .filter("event_type = 'violation.new' or event_date is not null")


def webhook_sink(wanted: DataFrame):
    """Append the matches of each micro-batch of violations."""
    def publish(batch: DataFrame, epoch: int, out: str) -> None:
        append_sink(webhook_match(violation_events(batch), wanted), epoch, out)
    return publish


# ------------------------------------------------------------------ monitors
def error_rate_5m(requests: DataFrame) -> DataFrame:
    """ST13: 5xx per second over tumbling 5-minute windows (alert when > 0.05)."""
    r = event_time(requests, "ts")
    agg = (r.withWatermark("event_time", "10 minutes").groupBy(F.window("event_time", "5 minutes"))
           .agg(F.count(F.lit(1)).alias("requests"), F.count_if("is_error").alias("errors")))
    rate = F.col("errors") / 300.0
    return agg.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "requests", "errors",
                      F.bround(rate, 6).alias("errors_per_second"), (rate > 0.05).alias("alert"))


def latency_histogram_5m(requests: DataFrame) -> DataFrame:
    """ST13: requests per 5-minute window and latency value, once the watermark closes the window."""
    r = event_time(requests, "ts")
    agg = (r.withWatermark("event_time", "10 minutes").groupBy(F.window("event_time", "5 minutes"), "latency")
           .agg(F.count(F.lit(1)).alias("requests")))
    return agg.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "latency", "requests")


def p95_latency(histogram: DataFrame, threshold: float) -> DataFrame:
    """ST13: exact nearest-rank p95 per window from (window_start, latency, requests) counts: the smallest
    latency that at least 95 % of the window's requests do not exceed."""
    by_window = Window.partitionBy("window_start")
    upto = by_window.orderBy("latency").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = histogram.filter(F.col("latency").isNotNull()).withColumn("_upto", F.sum("requests").over(upto)) \
        .withColumn("_all", F.sum("requests").over(by_window))
    p95 = ranked.filter(F.col("_upto") * 100 >= F.col("_all") * 95).groupBy("window_start").agg(F.min("latency").alias("p95_latency"))
    total = histogram.groupBy("window_start").agg(F.sum("requests").alias("requests"))
    return total.join(p95, "window_start", "left").select(
        "window_start", "requests", "p95_latency", (F.col("p95_latency") > threshold).alias("alert"))


def latency_sketch_5m(requests: DataFrame) -> DataFrame:
    """ST13: one KLL sketch of the latencies per 5-minute window: one state row a window."""
    r = event_time(requests, "ts")
    agg = (r.withWatermark("event_time", "10 minutes").groupBy(F.window("event_time", "5 minutes"))
           .agg(F.count(F.lit(1)).alias("requests"), F.count("latency").alias("known"),
                F.kll_sketch_agg_double(F.col("latency").cast("double")).alias("sketch")))
    return agg.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "requests", "known", "sketch")


def p95_from_sketches(sketches: DataFrame, requests: DataFrame, threshold: float, margin: float = 0.03) -> DataFrame:
    """ST13: exact nearest-rank p95 of closed windows.  The sketch names the value range that holds the rank (with
    ``margin``, above its error); one pass over the requests counts what is below the range and the values inside it.
    Windows whose rank turns out to lie outside are counted over all their values."""
    at = lambda q: F.kll_sketch_get_quantile_double("sketch", F.lit(q))
    start = F.window(F.col("ts").cast("timestamp"), "5 minutes")["start"].cast("timestamp_ntz")
    raw = requests.filter(F.col("latency").isNotNull()).select(start.alias("window_start"), F.col("latency").cast("double").alias("latency"))
    bounds = sketches.filter("known > 0").select("window_start", "known", at(max(0.0, 0.95 - margin)).alias("low"), at(min(1.0, 0.95 + margin)).alias("high"))

    def ranked(ranges: DataFrame) -> DataFrame:
        inside = F.when(F.col("latency") >= F.col("low"), F.col("latency"))         # NULL: below the range
        counts = (raw.join(ranges, "window_start").filter(F.col("latency") <= F.col("high"))
                  .groupBy("window_start", "known", inside.alias("value")).agg(F.count(F.lit(1)).alias("n")))
        upto = Window.partitionBy("window_start").orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hit = counts.withColumn("upto", F.sum("n").over(upto)).filter(F.col("upto") * 100 >= F.col("known") * 95)
        return hit.groupBy("window_start").agg(F.min("value").alias("p95_latency"), F.max(F.col("value").isNull()).alias("below"))

    first = ranked(bounds).filter("not below")
    missed = bounds.join(first, "window_start", "left_anti").withColumns(
        {"low": F.lit(float("-inf")), "high": F.lit(float("inf"))})
    p95 = first.select("window_start", "p95_latency").unionByName(ranked(missed).select("window_start", "p95_latency"))
    return sketches.join(p95, "window_start", "left").select(
        "window_start", "requests", "p95_latency", (F.col("p95_latency") > threshold).alias("alert"))


def breach_rules(p95_threshold: float, errors_per_second: float = 0.05) -> dict:
    """ST14: alert rules over a 5-minute window's requests.  The p95 exceeds the threshold exactly when less than
    95 % of the latencies are at or below it."""
    return {"p95_latency": F.count_if(F.col("latency") <= p95_threshold) * 100 < F.count("latency") * 95,
            "error_rate": F.count_if("is_error") > errors_per_second * 300}


def breach_stream(requests: DataFrame, rules: dict, min_steps: int = 2) -> DataFrame:
    """ST14 in a stream, two chained stateful operators: 5-minute windows that break a rule, then a session window
    for each rule that joins consecutive ones."""
    r = event_time(requests, "ts").withWatermark("event_time", "10 minutes")
    broken = F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]).alias("broken")
    w = r.groupBy(F.window("event_time", "5 minutes").alias("step")).agg(broken)
    s = (w.select(F.window_time("step").alias("at"), F.col("step.start").alias("start"), F.explode("broken").alias("rule"))
         .filter(F.col("rule").isNotNull()).groupBy("rule", F.session_window("at", "450 seconds"))       # steps are 300 seconds apart
         .agg(F.min("start").alias("first"), F.max("start").alias("last"), F.count(F.lit(1)).alias("windows")))
    return s.filter(F.col("windows") >= min_steps).select(
        "rule", F.col("first").cast("timestamp_ntz").alias("breach_start"),
        (F.col("last").cast("timestamp_ntz") + F.expr("INTERVAL 300 SECONDS")).alias("breach_end"), "windows")


def sustained_breach(series: DataFrame, flag: str, ts: str, step_seconds: int, min_steps: int) -> DataFrame:
    """ST14: gaps-and-islands over consecutive breaching windows; an island counts
    when it spans ≥ ``min_steps`` consecutive windows.  The window runs over one
    row per time window (bounded by the time span, not the data volume)."""
    b = series.filter(F.col(flag)).select(ts)
    idx = (F.unix_micros(F.col(ts).cast("timestamp")) / (step_seconds * 1_000_000)).cast("long")
    w = Window.orderBy(ts)
    g = b.withColumn("_i", idx).withColumn("_grp", F.col("_i") - F.row_number().over(w))
    isl = g.groupBy("_grp").agg(F.min(ts).alias("breach_start"), F.max(ts).alias("last_window"),
                                F.count(F.lit(1)).alias("windows"))
    return (isl.filter(F.col("windows") >= min_steps)
            .select("breach_start", (F.col("last_window") + F.expr(f"INTERVAL {int(step_seconds)} SECONDS"))
                    .alias("breach_end"), "windows"))


def new_violations(violations: DataFrame) -> DataFrame:
    """ST7: records never seen before by (source, external id).  The keys stay in state for
    all time (RocksDB, partitioned by key), so neither the order nor the cutting of the
    micro-batches changes the result."""
    return violations.select("source", "order_key", "line_no").dropDuplicates()


def stream_counters(updates: DataFrame) -> DataFrame:
    """ST12: running message counts by (type, direction)."""
    return (updates.select(F.col("update_type").alias("message_type"), F.lit("outbound").alias("direction"))
            .groupBy("message_type", "direction").agg(F.count(F.lit(1)).alias("messages")))


def connection_sessions(requests: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """ST6: activity sessions per client (session windows): connected at ``session_start``, last
    heard of at ``last_ping``, ``uptime_seconds`` between the two."""
    r = event_time(requests, "ts")
    agg = (r.withWatermark("event_time", WATERMARK).groupBy("client", F.session_window("event_time", gap))
           .agg(F.count(F.lit(1)).alias("requests"), F.max("event_time").alias("last")))
    up = F.unix_micros("last") - F.unix_micros("session_window.start")
    return agg.select("client", F.col("session_window.start").cast("timestamp_ntz").alias("session_start"),
                      F.col("session_window.end").cast("timestamp_ntz").alias("session_end"), "requests",
                      F.col("last").cast("timestamp_ntz").alias("last_ping"),
                      F.floor(up / 1_000_000).alias("uptime_seconds"))


def limiter_stream(requests: DataFrame, kind: str, delay_seconds: int = 86_400, **params) -> DataFrame:
    """ST3/ST4 in a stream: per-client state with ``applyInPandasWithState``.  Requests may be out of order
    by ``delay_seconds``; read the sink through ``limiters.latest``."""
    rule = LIM.sliding_rule(**params) if kind == "sliding" else LIM.bucket_rule(**params)
    return (requests.select("client", "request_id", "ts").groupBy("client")
            .applyInPandasWithState(LIM.state_function(rule, delay_seconds * 1_000_000), LIM.STREAM_SCHEMA,
                                    rule.state_schema + LIM.HELD_SCHEMA, "append",
                                    GroupStateTimeout.NoTimeout))


def streaming_tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir, streaming=True)


# ----------------------------------------------- conversion as keyed state
CONVERSION_SCHEMA = ("unique_key long, property_id long, created timestamp_ntz, first_violation timestamp_ntz, "
                     "converted boolean")
CONVERSION_STATE = "keys array<long>, created array<long>, first array<long>, records array<long>"


def conversion_state_fn(within_days: int = 14, delay_us: int = 86_400_000_000):
    """Per property: each heat complaint with its next class-C record, whichever of them comes first in
    the stream.  State holds the complaints whose next record is unknown or could still be
    preceded by one within the watermark's delay, and the records a complaint within that delay
    could still need - never (complaint, violation) pairs.  A complaint is emitted when a next record
    is known, again when an earlier one arrives (``conversion_result`` keeps the earliest), or when
    the watermark passes its 14 days."""
    from bisect import bisect_left

    import pandas as pd

    span = int(within_days) * 86_400_000_000

    def fn(key, pdfs, state):
        pid = int(key[0])
        keys, created, first, records = (list(x) for x in state.get) if state.exists else ([], [], [], [])
        watermark = state.getCurrentWatermarkMs() * 1000
        newest = watermark
        if not state.hasTimedOut:
            for pdf in pdfs:
                is_record = pdf["kind"] == 1
                records += pdf.loc[is_record, "t_us"].tolist()
                created += pdf.loc[~is_record, "t_us"].tolist()
                keys += pdf.loc[~is_record, "key"].tolist()
                newest = max(newest, int(pdf["t_us"].max()) - delay_us)
        first += [-1] * (len(keys) - len(first))
        records = sorted(set(records))
        out, kept = [], []
        for k, c, known in zip(keys, created, first):
            i = bisect_left(records, c)
            if i < len(records) and (known < 0 or records[i] < known):
                known = records[i]
                conv = known - c <= span
                out.append((k, pid, c, known if conv else None, conv))
            if known < 0 and c + span < watermark:
                out.append((k, pid, c, None, False))
            elif known < 0 or known > newest:
                kept.append((k, c, known))
        records = records[bisect_left(records, newest):]
        if kept or records:
            state.update(tuple([list(x) for x in zip(*kept)] or [[], [], []]) + (records,))
            wake = [(c + span if known < 0 else known) // 1000 + 1 for _, c, known in kept] + [t // 1000 + 1 for t in records[-1:]]
            state.setTimeoutTimestamp(max(min(wake), state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        if out:
            df = pd.DataFrame(out, columns=["unique_key", "property_id", "c_us", "f_us", "converted"])
            yield pd.DataFrame({
                "unique_key": df["unique_key"].astype("int64"), "property_id": df["property_id"].astype("int64"),
                "created": pd.to_datetime(df["c_us"], unit="us"),
                "first_violation": pd.to_datetime(df["f_us"], unit="us"),
                "converted": df["converted"].astype(bool)})
    return fn


def conversion_result(rows: DataFrame) -> DataFrame:
    """One row per complaint: its earliest known record."""
    return rows.groupBy("unique_key", "property_id", "created").agg(
        F.min("first_violation").alias("first_violation"), F.max("converted").alias("converted"))


def stream_conversion_state(complaints: DataFrame, violations: DataFrame, within_days: int = 14, delay_seconds: int = 86_400) -> DataFrame:
    c = (complaints.filter(F.col("complaint_type") == "HEAT/HOT WATER")
         .select("property_id", F.col("unique_key").alias("key"), F.col("created").cast("timestamp").alias("event_time"),
                 F.lit(0).alias("kind")))
    v = violations.select("property_id", F.col("violation_key").alias("key"),
                          F.col("issued").cast("timestamp").alias("event_time"), F.lit(1).alias("kind"))
    u = (c.unionByName(v).withWatermark("event_time", f"{delay_seconds} seconds")
         .withColumn("t_us", F.unix_micros("event_time")))
    return (u.groupBy("property_id")
            .applyInPandasWithState(conversion_state_fn(within_days, delay_seconds * 1_000_000), CONVERSION_SCHEMA, CONVERSION_STATE,
                                    "append", GroupStateTimeout.EventTimeTimeout))


# ----------------------------------------------- conversion as an interval join
def conversion_join(complaints: DataFrame, violations: DataFrame, within_days: int = 14, delay: str = "1 day") -> DataFrame:
    """Stream-stream left outer time-interval join with a watermark on both sides.  State of a key is bounded by
    ``within_days`` plus the delay.  A property's rows are spread along time: a complaint meets the records of its own and
    the following ``within_days`` block, so a hot property is as many keys as it has blocks.  A complaint gives a row
    for each record that follows it in time, and rows without a record once the watermark has passed its horizon."""
    block = int(within_days) * 86_400
    c = event_time(complaints.filter(F.col("complaint_type") == "HEAT/HOT WATER"), "created").withWatermark("event_time", delay)
    first = F.floor(F.unix_seconds("event_time") / block)
    c = c.select("unique_key", "property_id", "created", "event_time", F.explode(F.array(first, first + 1)).alias("block"))
    v = event_time(violations, "issued", "issued_time").withWatermark("issued_time", delay)
    v = v.select(F.col("property_id").alias("v_property"), "issued", "issued_time", F.floor(F.unix_seconds("issued_time") / block).alias("v_block"))
    follows = (F.col("property_id") == F.col("v_property")) & (F.col("block") == F.col("v_block")) \
        & (F.col("issued_time") >= F.col("event_time")) & (F.col("issued_time") <= F.col("event_time") + F.expr(f"INTERVAL {int(within_days)} DAYS"))
    return c.join(v, follows, "leftOuter").select(
        "unique_key", "property_id", "created", F.col("issued").alias("first_violation"), F.col("issued").isNotNull().alias("converted"))
