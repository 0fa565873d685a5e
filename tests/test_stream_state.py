"""Keyed state machines, chained and joined streams, incremental tables, audit: over shuffled micro-batches, against
plain Python or the batch queries."""

import datetime as dt
import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from parcelwise.plans import stream_queries as SQ
from parcelwise.plans.registry import QUERIES, load_all
from parcelwise.sources.tables import Tables
from parcelwise.streaming import connections as C
from parcelwise.streaming import incremental as I
from parcelwise.streaming import jobs as J

from conftest import MEDIUM

load_all()
T0 = dt.datetime(2024, 1, 1)


def landed(spark, rows, schema, path, files=5, seed=1):
    """Rows dealt over files at random, one file a micro-batch."""
    deal = random.Random(seed)
    parts = [[] for _ in range(files)]
    for r in rows:
        parts[deal.randrange(files)].append(r)
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def land(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# --- ST1, A21 ---

MESSAGES = "connection long, message_id long, ts timestamp_ntz, type string, property_id string"


def replay(rows, limit, until):
    """Connections after all messages up to ``until``: {connection: (authenticated, subscriptions)} of the open ones."""
    open_ = {}
    for c, _, t, kind, p in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if t > until:
            continue
        auth, subs, ping = open_.get(c, (False, set(), None))
        if ping is None or t > ping + limit:
            auth, subs, ping = False, set(), t
        if kind == "PING":
            ping = t
        elif kind == "AUTHENTICATE":
            auth = True
        elif kind == "SUBSCRIBE" and auth and p:
            subs = subs | {p}
        elif kind == "UNSUBSCRIBE":
            subs = subs - {p}
        open_[c] = auth, subs, ping
    return {c: (a, s) for c, (a, s, ping) in open_.items() if until <= ping + limit}


@pytest.mark.parametrize("files", [1, 5])
def test_connections_over_shuffled_micro_batches(spark, tmp_path, files):
    rng = random.Random(files)
    kinds = ["SUBSCRIBE"] * 4 + ["UNSUBSCRIBE", "AUTHENTICATE", "PING", "PING", None, "GET_STATUS"]
    rows = [(rng.randrange(12), i, T0 + dt.timedelta(minutes=rng.randrange(60 * 24 * 10)), rng.choice(kinds), rng.choice(["a", "b", "c", None]))
            for i in range(900)]
    limit = dt.timedelta(hours=9)
    stream = landed(spark, rows, MESSAGES, str(tmp_path / "in"), files)
    end = T0 + dt.timedelta(days=9, hours=20)
    land(spark, [(999, 10_000, end + dt.timedelta(days=20), "PING", None)], MESSAGES, str(tmp_path / "in"))     # moves the watermark to ``end``
    out = J.run_available_now(spark, C.connection_changes(stream, int(limit.total_seconds()), "20 days"), "connections")
    changes = spark.read.parquet(out)
    want = replay(rows, limit, end)
    assert _rows(C.subscriptions_of(changes), ["connection", "property_id"]) == sorted((c, p) for c, (_, s) in want.items() for p in s)
    stats = C.connection_stats(changes).first()
    assert (stats["active_connections"], stats["authenticated_connections"]) == (len(want), sum(a for a, _ in want.values()))
    assert stats["total_subscriptions"] == sum(len(s) for _, s in want.values())
    assert changes.filter("change = 'REFUSED'").count() > 0 and changes.filter("change = 'DROPPED'").count() > 0
    twice = changes.groupBy("connection", "seq").count().filter("count > 1")
    assert twice.isEmpty()                          # each change is told once
    assert J.audit(spark, out).agg(F.sum("dropped_by_watermark")).first()[0] == 0


# --- ST5 ---

SENT = "connection long, kind string, property_id long, update_id long, severity string, ts timestamp_ntz"


def test_undelivered_ring_over_shuffled_micro_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(4) % 3, "MESSAGE", rng.randrange(5), i, "LOW", T0 + dt.timedelta(minutes=rng.randrange(3000))) for i in range(400)]
    rows += [(1, "DRAIN", None, None, None, T0 + dt.timedelta(minutes=2900)), (2, "DRAIN", None, None, None, T0 + dt.timedelta(minutes=9000))]
    drained = {1: T0 + dt.timedelta(minutes=2900), 2: T0 + dt.timedelta(minutes=9000)}
    want = []
    for c in range(3):
        mine = [r for r in rows if r[0] == c and r[1] == "MESSAGE" and (c not in drained or r[5] > drained[c])]
        want += [(c, r[3]) for r in sorted(mine, key=lambda r: (r[5], r[3]))[-20:]]
    stream = landed(spark, rows, SENT, str(tmp_path / "in"))
    out = J.run_available_now(spark, C.undelivered(stream, 20), "queue", "update", J.append_sink)
    changes = spark.read.parquet(out)
    assert _rows(C.queue_of(changes), ["connection", "update_id"]) == sorted(want)
    assert {r[0] for r in changes.select("change").distinct().collect()} == {"queued", "evicted", "drained"}


def test_message_that_comes_twice_and_message_without_a_time(spark, tmp_path):
    rows = [(1, "MESSAGE", 7, i % 6, "LOW", None if i % 6 == 0 else T0 + dt.timedelta(minutes=i % 6)) for i in range(12)]
    for size, want in ((20, [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]), (3, [4, 5, 5])):
        stream = landed(spark, rows, SENT, str(tmp_path / f"in{size}"))
        out = J.run_available_now(spark, C.undelivered(stream, size), "queue", "update", J.append_sink, keyed=True)
        assert _rows(C.queue_of(spark.read.parquet(out)), ["update_id"]) == [(i,) for i in want]


def test_messages_without_connection_or_time(spark, tmp_path):
    rows = [(1, 1, T0, "AUTHENTICATE", None), (1, 2, T0 + dt.timedelta(minutes=1), "SUBSCRIBE", "a"), (1, 3, None, "UNSUBSCRIBE", "a"),
            (None, 4, T0 + dt.timedelta(hours=1), "AUTHENTICATE", None), (None, 5, T0 + dt.timedelta(days=2), "PING", None)]
    stream = landed(spark, rows, MESSAGES, str(tmp_path / "in"), files=1)
    out = J.run_available_now(spark, C.connection_changes(stream, 5 * 86_400), "connections", keyed=True)
    changes = spark.read.parquet(out)       # the last message, of no connection, moves the watermark past the others
    assert _rows(C.subscriptions_of(changes), ["connection", "property_id"]) == [(1, "a")]
    assert changes.select("connection").distinct().collect() == [(1,)]


# --- J13 ---

def test_conversion_join_over_shuffled_micro_batches(spark, tmp_path):
    v = Tables(spark, MEDIUM).views
    cc, vv = v.complaints().limit(4000), v.class_c_events()
    c = landed(spark, [tuple(r) for r in cc.collect()], cc.schema, str(tmp_path / "c"))
    e = landed(spark, [tuple(r) for r in vv.collect()], vv.schema, str(tmp_path / "v"), seed=2)
    plan = J.conversion_join(cc, vv, 14)._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "Cartesian" not in plan
    out = J.run_available_now(spark, J.conversion_join(c, e, 14, "40 days"), "conversion-join")
    got = J.conversion_result(spark.read.parquet(out)).filter("converted")
    want = (cc.filter("complaint_type = 'HEAT/HOT WATER'").alias("c").join(vv.alias("v"), "property_id")
            .filter("issued >= created AND issued <= created + INTERVAL 14 DAYS").groupBy("unique_key").agg(F.min("issued").alias("first_violation")))
    assert want.count() > 0
    assert _rows(got, ["unique_key", "first_violation"]) == _rows(want, ["unique_key", "first_violation"])


def test_conversion_join_forgets_old_rows(spark, tmp_path):
    """State holds the rows of the horizon plus the delay, not the history."""
    day = lambda n: T0 + dt.timedelta(days=n)
    cs, vs = "unique_key long, property_id long, created timestamp_ntz, complaint_type string, value double", "violation_key long, property_id long, issued timestamp_ntz"
    for n in range(12):
        land(spark, [(10 * n + i, 1, day(20 * n), "HEAT/HOT WATER", 0.0) for i in range(10)], cs, str(tmp_path / "c"))
        land(spark, [(n, 1, day(20 * n + 3))], vs, str(tmp_path / "v"))
    read = lambda s, p: spark.readStream.schema(s).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / p))
    out = J.run_available_now(spark, J.conversion_join(read(cs, "c"), read(vs, "v"), 14), "conversion-state")
    states = [r["state_rows"] for r in J.audit(spark, out).orderBy("epoch").collect()]
    assert max(states) <= 3 * (20 + 1)             # of 252 rows that came


# --- ST13, ST14 ---

REQUESTS = "request_id long, client long, ts timestamp_ntz, endpoint string, is_error boolean, latency double"


def busy_requests(seed=3):
    """Windows with one request, with thousands of different latencies, with equal ones and with unknown ones."""
    rng = random.Random(seed)
    rows, i = [], 0
    for w, n in enumerate([1, 2500, 30, 700, 0, 400, 3, 1200, 5, 1]):
        for k in range(n):
            latency = None if rng.random() < 0.05 else 200.0 if w == 5 else rng.expovariate(1 / (40 + 60 * (w % 4))) * (1 + 50 * (k == 0))
            rows.append((i, i % 7, T0 + dt.timedelta(seconds=300 * w + rng.randrange(300)), "x", rng.random() < 0.05 * (w % 3), latency))
            i += 1
    rows.append((i, 1, T0 + dt.timedelta(hours=9), "x", False, 1.0))       # closes all windows before it
    return rows


def nearest_rank(values):
    values = sorted(v for v in values if v is not None)
    return next((v for k, v in enumerate(values, 1) if k * 100 >= len(values) * 95), None)


def by_window(rows):
    out = {}
    for r in rows[:-1]:
        out.setdefault(T0 + dt.timedelta(seconds=300 * int((r[2] - T0).total_seconds() // 300)), []).append(r)
    return out


@pytest.mark.parametrize("margin", [0.03, 0.0])
def test_p95_is_exact_with_one_state_row_a_window(spark, tmp_path, margin):
    rows = busy_requests()
    stream = landed(spark, rows, REQUESTS, str(tmp_path / "in"), files=1)
    out = J.run_available_now(spark, J.latency_sketch_5m(stream), "p95")
    assert max(r["state_rows"] for r in J.audit(spark, out).collect()) <= 10
    got = J.p95_from_sketches(spark.read.parquet(out), spark.read.parquet(str(tmp_path / "in")), 150.0, margin)     # margin 0: most ranges are missed
    want = [(w, len(rs), nearest_rank([r[5] for r in rs])) for w, rs in by_window(rows).items()]
    assert _rows(got, ["window_start", "requests", "p95_latency"]) == sorted(want)


def test_breaches_in_a_stream_equal_plain_python(spark, tmp_path):
    rows = busy_requests(4)
    stream = landed(spark, rows, REQUESTS, str(tmp_path / "in"), files=1)
    got = spark.read.parquet(J.run_available_now(spark, J.breach_stream(stream, J.breach_rules(150.0, 0.05), 2), "breach"))
    want = []
    for rule, broken in (("p95_latency", lambda rs: (nearest_rank([r[5] for r in rs]) or 0) > 150), ("error_rate", lambda rs: sum(r[4] for r in rs) > 15)):
        hit = sorted(w for w, rs in by_window(rows).items() if broken(rs))
        runs = []
        for w in hit:
            if runs and w - runs[-1][-1] == dt.timedelta(seconds=300):
                runs[-1].append(w)
            else:
                runs.append([w])
        want += [(rule, r[0], r[-1] + dt.timedelta(seconds=300), len(r)) for r in runs if len(r) > 1]
    assert want and _rows(got, ["rule", "breach_start", "breach_end", "windows"]) == sorted(want)


# --- ST8 ---

def test_heat_state_is_property_days(spark, tmp_path):
    rows = [(i, i % 3, T0 + dt.timedelta(hours=i % 240), "HEAT/HOT WATER", 1.0) for i in range(3000)]
    stream = landed(spark, rows, "unique_key long, property_id long, created timestamp_ntz, complaint_type string, value double", str(tmp_path / "in"), files=1)
    out = J.run_available_now(spark, J.heat_panes(stream), "panes")
    assert max(r["state_rows"] for r in J.audit(spark, out).collect()) == 3 * 10


# --- ST7 ---

def test_new_records_of_shuffled_files_and_a_replayed_epoch(spark, tmp_path):
    v = Tables(spark, MEDIUM).views.violations().select("source", "order_key", "line_no")
    keys = ["source", "order_key", "line_no"]
    rows = [tuple(r) for r in v.limit(3000).collect()]
    rows += rows[::3] + [(None, 1, 1), (None, 1, 1), ("X", None, 2)]
    stream = landed(spark, rows, "source string, order_key long, line_no long", str(tmp_path / "in"))
    sink = I.new_records_sink(keys)
    out = J.run_available_now(spark, stream, "new", "append", sink)
    got = lambda: sorted(map(str, (tuple(r) for r in I.table(spark, out).select(*keys).collect())))
    want = sorted(map(str, set(rows)))
    assert got() == want
    assert all(r["state_rows"] == 0 for r in J.audit(spark, out).collect())
    again = spark.createDataFrame([tuple(r) for r in I.table(spark, out).filter("epoch IN (1, 3)").select(*keys).collect()],
                                  "source string, order_key long, line_no long")
    sink(again, 3, out)                              # the epoch again, with keys of an earlier one
    assert got() == want


# --- ST15 ---

def test_rescore_touches_the_buckets_of_changed_parcels(spark, tmp_path):
    b = Tables(spark, MEDIUM).views
    props, complaints = b.properties(), SQ.feed_sources(b)[1]
    violations = b.violations()
    hit = violations.select("property_id").distinct().orderBy("property_id").limit(2)
    late = violations.join(hit, "property_id", "left_semi")
    path = str(tmp_path / "in")
    violations.join(hit, "property_id", "left_anti").coalesce(1).write.parquet(path)
    stream = lambda: spark.readStream.schema(violations.schema).option("maxFilesPerTrigger", 1).parquet(path)
    base = str(tmp_path / "run")
    run = lambda: J.run_available_now(spark, SQ.rescore_counts(stream()), "rescore", "update", SQ.rescore_sink(props, complaints), base)
    out = run()
    assert I.table(spark, f"{out}/published").select("bucket").distinct().count() > 20
    late.coalesce(1).write.mode("append").parquet(path)
    out = run()
    epochs = I.table(spark, f"{out}/published")
    last = epochs.agg(F.max("epoch")).first()[0]
    changed = SQ.rescore_counts(late).count()
    assert last > 0 and epochs.filter(F.col("epoch") == last).select("bucket").distinct().count() <= max(2, changed)
    cols = ["bbl", "total_violations", "class_b_violations", "relevant_311_complaints", "compliance_risk_score"]
    assert _rows(I.latest(spark, f"{out}/published"), cols) == _rows(QUERIES["feed_scored"](spark, MEDIUM), cols)


# --- late rows ---

def test_audit_counts_late_rows(spark, tmp_path):
    day = lambda n: T0 + dt.timedelta(days=n)
    path = str(tmp_path / "in")
    files = [[(1, 1, day(10), "x", False, 1.0)], [(2, 1, day(20), "x", False, 1.0)],
             [(i, 1, day(1) + dt.timedelta(minutes=10 * i), "x", False, 1.0) for i in range(7)] + [(99, 1, day(21), "x", False, 1.0)]]
    for rows in files:
        land(spark, rows, REQUESTS, path)
    stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(path)
    out = J.run_available_now(spark, J.error_rate_5m(stream), "late")
    audit = J.audit(spark, out)
    assert audit.agg(F.sum("dropped_by_watermark")).first()[0] == 7
    assert audit.agg(F.sum("input_rows")).first()[0] == 10


# --- fan-out ---

def test_hot_property_is_fanned_out_by_several_tasks(spark):
    updates = spark.createDataFrame([(i, 7 if i % 3 == 0 else i % 40, "LOW") for i in range(3000)], "update_id long, property_id long, severity string")
    subs = spark.createDataFrame([(c, 7 if c % 2 else c % 40) for c in range(400)], "connection long, property_id long")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(old, ("-1", "false")):
            spark.conf.set(k, v)
        fan = J.sliced_fanout(updates, subs, rows=100)
        tasks = fan.filter("property_id = 7").groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert len(tasks) > 3 and max(r["count"] for r in tasks) < 0.5 * sum(r["count"] for r in tasks)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    cols = ["update_id", "connection", "property_id"]
    assert _rows(fan, cols) == _rows(J.fanout(updates, subs), cols)


# --- limiters tell what changed ---

@pytest.mark.parametrize("files", [4, 12])
def test_limiter_sink_does_not_grow_with_the_files(spark, tmp_path, files):
    r = Tables(spark, MEDIUM).views.requests().select("client", "request_id", "ts").filter("client < 20")
    cut = r.withColumn("_p", F.ntile(files).over(Window.orderBy("ts", "request_id"))).persist()
    path = str(tmp_path / "in")
    for p in range(1, files + 1):
        cut.filter(F.col("_p") == p).drop("_p").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(path)
    sink = spark.read.parquet(J.run_available_now(spark, J.limiter_stream(stream, "sliding", 40 * 86_400, max_messages=2, window_seconds=43_200), "lim"))
    assert sink.count() == r.count()


# --- peers without a parcel key ---

def test_buildings_without_a_parcel_key_have_peers(spark):
    from parcelwise.operators import peers as P
    rows = [(1, None), (2, None), (3, "3000010001"), (4, "3000010001"), (5, "3000010002")]
    props = spark.createDataFrame([(i, b, "t", "brooklyn", 10, 1950, "A") for i, b in rows],
                                  "property_id long, bbl string, tenant_id string, borough string, units int, year_built int, building_class string")
    scores = spark.createDataFrame([(i, 10.0 * i) for i, _ in rows], "property_id long, risk_score double")
    p = P.prepare(props, scores)
    assert _rows(P.peer_counts(p), ["property_id", "similar_count"]) == [(1, 4), (2, 4), (3, 3), (4, 3), (5, 4)]
    bench = {r["property_id"]: r["similar_count"] for r in P.peer_benchmark(p, P.peer_stats(p, materialize=False)).collect()}
    assert bench == {1: 4, 2: 4, 3: 3, 4: 3, 5: 4}
    assert {r["property_id"]: r["peer_count"] for r in P.peer_topn(p, 10).collect()} == bench


class Kept:
    """A value state in memory."""

    def __init__(self):
        self.value = None

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def ring_changes(old, drained, rows, size):
    """One connection's micro-batch, by plain Python: (changes, ring, drained)."""
    drains = [r[1] for r in rows if r[5] and r[1] is not None]
    drained = max([*drains, *([] if drained is None else [drained])], default=None)
    age = lambda r: tuple((x is not None, x or 0) for x in r[1:4]) + ((r[4] is not None, r[4] or ""),)
    gone = lambda r: drained is not None and (r[1] is None or r[1] <= drained)
    ring = [r for r in sorted(old + [r[:5] for r in rows if not r[5]], key=age)[-size:] if not gone(r)]
    changes = [(*r, "queued" if ring.count(r) > old.count(r) else "drained" if gone(r) else "evicted", ring.count(r))
               for r in {*old, *ring} if ring.count(r) != old.count(r)]
    return changes, ring, drained


@pytest.mark.parametrize("size", [1, 3])
def test_rings_of_a_bucket_equal_one_ring_a_connection(size):
    """Nulls in every column, large numbers, copies, drains and connections that come and go, over micro-batches."""
    rng = random.Random(size)
    big = 2**62
    operators = {b: C.Undelivered(size) for b in (0, C.BUCKETS)}
    for x in operators.values():
        x.init(Kept())
    rings, drained, revisions = {}, {}, {}
    for _ in range(25):
        rows = [(rng.choice([None, 0, 1, big, big + 1]), rng.choice([None, 0, 5, 6, big]), rng.choice([None, 0, 1, big + 1]),
                 rng.choice([None, 7]), rng.choice([None, "", "LOW", "ß"]), rng.random() < 0.04) for _ in range(rng.randrange(30))]
        packed = {}
        for part in (rows[::2], rows[1::2]):
            columns = dict(zip(C.MESSAGE.names, zip(*part))) if part else {c: [] for c in C.MESSAGE.names}
            batch = pa.table({c: pa.array(columns[c], t) for c, t in zip(C.MESSAGE.names, C.MESSAGE.types)}) \
                .append_column("bucket", pa.array([C.BUCKETS if r[0] is None else 0 for r in part], pa.int32()))
            for b in C._packed(size)(iter(batch.to_batches())):
                for k, blob in zip(b["bucket"].to_pylist(), b["rows"].to_pylist()):
                    packed.setdefault(k, []).append(blob)
        got = []
        for k, blobs in packed.items():
            for out in operators[k].handleInputRows((k,), iter([pd.DataFrame({"bucket": k, "rows": [x]}) for x in blobs]), None):
                out = out[["connection", "t_us", "update_id", "property_id", "severity", "change", "copies", "revision"]]
                got += [tuple(None if x is None or x != x else x for x in r) for r in out.astype(object).itertuples(index=False)]
        want = []
        for c in {r[0] for r in rows}:
            mine = [r for r in rows if r[0] == c]
            if all(r[5] and r[1] is None for r in mine):        # a drain without a time drains nothing
                continue
            revisions[c] = revisions.get(c, 0) + 1
            changes, rings[c], drained[c] = ring_changes(rings.get(c, []), drained.get(c), mine, size)
            want += [(*x, revisions[c]) for x in changes]
        key = lambda r: [(x is not None, str(x)) for x in r]
        assert sorted(got, key=key) == sorted(want, key=key)


def test_connections_share_states(spark, tmp_path):
    """A state of its own for each connection took most of the time: there are no more states than buckets."""
    rows = [(c, "MESSAGE", 7, c, "LOW", T0) for c in range(10_000)] + [(0, "MESSAGE", 7, 1, "LOW", T0 + dt.timedelta(seconds=i)) for i in range(50)]
    out = J.run_available_now(spark, C.undelivered(landed(spark, rows, SENT, str(tmp_path / "in"), files=1), 20), "queue", "update", J.append_sink, keyed=True)
    queue = C.queue_of(spark.read.parquet(out))
    assert queue.filter("connection > 0").count() == 9_999 and queue.filter("connection = 0").count() == 20
    assert J.audit(spark, out).agg(F.max("state_rows")).first()[0] <= C.BUCKETS + 1
