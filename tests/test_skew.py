"""Skew-safe operators against brute force on fixtures with a hot key.

Each fixture puts about a third of the rows on one key (or one cell / parcel),
and the Spark operator must agree exactly with a plain-Python computation.
"""

import datetime as dt
import math
import random
import statistics
from collections import deque
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from parcelwise.operators import limiters as LIM
from parcelwise.operators import listing as L
from parcelwise.operators import peers as P
from parcelwise.operators import temporal as T
from parcelwise.operators import windows as W

T0 = dt.datetime(2024, 1, 1)


def _events(n=600, keys=8, seed=1, span_hours=72):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        k = 0 if rnd.random() < 0.34 else rnd.randrange(1, keys)      # key 0 holds a third
        ts = T0 + dt.timedelta(seconds=rnd.randrange(span_hours * 3600))
        rows.append((i, k, ts, rnd.randrange(100)))
    return rows


@pytest.fixture(scope="module")
def ev(spark):
    rows = _events()
    return rows, spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz, v long")


def test_top_n_per_key(spark, ev):
    rows, df = ev
    got = {(r.k, r.id, r["rank"]) for r in
           W.top_n_per_key(df, ["k"], [F.desc("v"), F.asc("id")], 5).collect()}
    want = set()
    for k in {r[1] for r in rows}:
        sel = sorted([r for r in rows if r[1] == k], key=lambda r: (-r[3], r[0]))[:5]
        want |= {(k, r[0], i + 1) for i, r in enumerate(sel)}
    assert got == want


def test_first_k_flags(spark, ev):
    rows, df = ev
    df = df.withColumn("quota", F.when(F.col("k") == 0, 30).otherwise(3))
    got = {r.id: r.admitted for r in first_k(df).collect()}
    for k in {r[1] for r in rows}:
        sel = sorted([r for r in rows if r[1] == k], key=lambda r: (r[2], r[0]))
        q = 30 if k == 0 else 3
        for i, r in enumerate(sel):
            assert got[r[0]] == (i < q)


def first_k(df):
    return W.first_k_flags(df, ["k"], [F.asc("ts"), F.asc("id")], "id", "quota", slice_rows=40)


def test_trailing_count(spark, ev):
    rows, df = ev
    got = {r.id: r.trailing_count for r in W.trailing_count(df, "k", "ts", 6 * 3600).collect()}
    for r in rows:
        want = sum(1 for x in rows if x[1] == r[1] and r[2] - dt.timedelta(hours=6) <= x[2] <= r[2])
        assert got[r[0]] == want


def test_one_day_of_a_hot_key_is_split(spark):
    """A third of the rows on one key inside one day: right answers, from several tasks; a NULL key is a key."""
    rnd = random.Random(5)
    start = dt.datetime(2024, 1, 10)
    rows = [(i, 0 if i % 3 == 0 else (None if i % 3 == 1 else i % 7),
             start + dt.timedelta(seconds=rnd.randrange(0, 86400))) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, k int, ts timestamp_ntz")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        probes = df.where("id % 2 = 0").withColumn("p", F.unix_micros(F.col("ts").cast("timestamp")))
        events = df.where("id % 2 = 1").withColumn("e", F.unix_micros(F.col("ts").cast("timestamp")))
        asof = T.asof_epoch(probes, events, "k", "p", "e").withColumn("task", F.spark_partition_id()).collect()
        counts = {r.id: r.n for r in W.trailing_count(df, "k", "ts", 3600, out="n").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len({r.task for r in asof if r.k == 0}) > 1
    assert len(asof) == 450
    for r in asof:
        past = [x[2] for x in rows if x[0] % 2 == 1 and x[1] == r.k and x[2] <= r.ts]
        want = max(past) if past else None
        assert r.asof_e == (None if want is None else int((want - dt.datetime(1970, 1, 1)).total_seconds()) * 10**6)
    for i, k, ts in rows:
        assert counts[i] == sum(1 for x in rows if x[1] == k and ts - dt.timedelta(hours=1) <= x[2] <= ts)


def test_strict_percentile(spark):
    rnd = random.Random(3)
    rows = [(i, "hot" if i % 3 else f"c{i % 5}", round(rnd.randrange(0, 400) / 4, 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, cohort string, score double")
    got = {r.id: r.percentile for r in W.strict_percentile(df, ["cohort"], "score").collect()}
    for i, c, s in rows:
        peers = [x for x in rows if x[1] == c and x[0] != i]
        want = None if not peers else round(sum(1 for x in peers if x[2] < s) * 100.0 / len(peers), 2)
        assert got[i] == pytest.approx(want) if want is not None else got[i] is None


def test_dedup_on_key(spark, ev):
    rows, df = ev
    got = {r.k: (r.ts, r.id) for r in L.dedup_on_key(df, ["k"], ["ts"]).collect()}
    for k in {r[1] for r in rows}:
        best = max([r for r in rows if r[1] == k], key=lambda r: (r[2], r[3], r[0]))
        assert got[k][0] == best[2]


def test_asof_and_forward(spark, ev):
    rows, df = ev
    probes = df.filter(F.col("v") < 50).select("id", "k", "ts")
    events = df.filter(F.col("v") >= 50).select("k", F.col("ts").alias("ets"))
    back = {r.id: r.asof_ts for r in T.asof_backward(probes, events, "k", "ts", "ets").collect()}
    fwd = {r.id: r.next_ts for r in T.first_after(probes, events, "k", "ts", "ets").collect()}
    evs = [r for r in rows if r[3] >= 50]
    for i, k, ts, v in rows:
        if v >= 50:
            continue
        before = [e[2] for e in evs if e[1] == k and e[2] <= ts]
        after = [e[2] for e in evs if e[1] == k and e[2] >= ts]
        assert back[i] == (max(before) if before else None)
        assert fwd[i] == (min(after) if after else None)


def _brute_sliding(ts_list, n, w):
    log, out = deque(), []
    for t in ts_list:
        while log and log[0] < t - w:
            log.popleft()
        out.append(len(log) < n)
        if out[-1]:
            log.append(t)
    return out


def test_sliding_limiter_hot_client(spark, ev):
    rows, _ = ev
    df = spark.createDataFrame([(r[1], r[0], r[2]) for r in rows], "client long, request_id long, ts timestamp_ntz")
    got = {r.request_id: r.admitted for r in LIM.rate_limit_sliding(df, 3, 3600).collect()}
    for c in {r[1] for r in rows}:
        sel = sorted([r for r in rows if r[1] == c], key=lambda r: (r[2], r[0]))
        us = [int((r[2] - dt.datetime(1970, 1, 1)).total_seconds() * 1e6) for r in sel]
        for r, ok in zip(sel, _brute_sliding(us, 3, 3600 * 10**6)):
            assert got[r[0]] == ok
    assert not all(got.values())


def _brute_bucket(times, rate, per_us):
    """Exact fractions: tokens refill evenly, a request takes one."""
    tokens, last, out = Fraction(rate), times[0], []
    for t in times:
        tokens, last = min(Fraction(rate), tokens + Fraction((t - last) * rate, per_us)), t
        out.append(tokens >= 1)
        tokens -= out[-1]
    return out


def test_token_bucket_hot_client(spark, ev):
    rows, _ = ev
    df = spark.createDataFrame([(r[1], r[0], r[2]) for r in rows], "client long, request_id long, ts timestamp_ntz")
    got = {r.request_id: r.admitted for r in LIM.rate_limit_token_bucket(df, 2, 1800.0).collect()}
    for c in {r[1] for r in rows}:
        sel = sorted([r for r in rows if r[1] == c], key=lambda r: (r[2], r[0]))
        us = [int((r[2] - dt.datetime(1970, 1, 1)).total_seconds() * 1e6) for r in sel]
        for r, ok in zip(sel, _brute_bucket(us, 2, 1800 * 10**6)):
            assert got[r[0]] == ok
    assert not all(got.values())


def _brute_peers(b):
    out = {}
    for t in b:
        peers = []
        for c in b:
            if c["bbl"] == t["bbl"] or c["borough"].lower() != t["borough"].lower():
                continue
            if c["units"] > 0 and t["units"] > 0 and not (0.7 <= c["units"] / t["units"] <= 1.3):
                continue
            if c["year_built"] and t["year_built"] and abs(c["year_built"] - t["year_built"]) > 15:
                continue
            peers.append(c)
        scores = [p["risk_score"] for p in peers if p["risk_score"] is not None]
        out[t["property_id"]] = (len(peers), scores)
    return out


def test_peer_stats_against_pairs(spark):
    rnd = random.Random(7)
    b = []
    for i in range(260):
        hot = i % 3 == 0                                  # a third in one cell
        bbl = "3000010001" if i % 17 == 0 else f"3{i:05d}0001"   # a crowded parcel
        b.append({"property_id": i, "bbl": bbl, "tenant_id": "t", "borough": "brooklyn",
                  "units": 20 if hot else rnd.choice([0, 5, 8, 10, 13, 30, 60]),
                  "year_built": 1950 if hot else rnd.choice([None, 0, 1900, 1940, 1960, 1990]),
                  "risk_score": None if i % 11 == 0 else round(rnd.randrange(0, 10000) / 100, 2)})
    props = spark.createDataFrame([(x["property_id"], x["bbl"], x["tenant_id"], x["borough"], x["units"],
                                    x["year_built"]) for x in b],
                                  "property_id long, bbl string, tenant_id string, borough string, units int, year_built int")
    scores = spark.createDataFrame([(x["property_id"], x["risk_score"]) for x in b], "property_id long, risk_score double")
    pr = P.prepare(props, scores)
    got = {r.property_id: r for r in P.peer_stats(pr, materialize=False).collect()}
    brute = _brute_peers(b)
    for t in b:
        n, sc = brute[t["property_id"]]
        g = got[t["property_id"]]
        assert g.similar_count == n
        assert g.scored_peers == len(sc)
        assert g.sum_cents == (sum(round(s * 100) for s in sc) if sc else 0)
        if t["risk_score"] is not None:
            assert g.below == sum(1 for s in sc if s < t["risk_score"])
        if sc:
            med = statistics.median([round(s * 100) for s in sc])
            assert g.median_cents == pytest.approx(med)


@pytest.mark.parametrize("crowd, hot_year", [(13, 1950), (2, None)])    # one parcel with half of all buildings
def test_nearest_peers_hot_cell(spark, crowd, hot_year):
    rnd = random.Random(11)
    b = []
    for i in range(200):
        hot = i % 3 == 0
        b.append((i, "3000010001" if i % crowd == 0 else f"3{i:05d}0001", "t", "brooklyn",
                  20 if hot else rnd.choice([0, 10, 15, 20, 25]), hot_year if hot else rnd.choice([None, 1940, 1955, 1965]),
                  rnd.choice(["A", "B"]), None if i % 7 == 0 else round(rnd.randrange(0, 10000) / 100, 2)))
    props = spark.createDataFrame([x[:6] + (x[6],) for x in b], "property_id long, bbl string, tenant_id string, "
                                  "borough string, units int, year_built int, building_class string")
    scores = spark.createDataFrame([(x[0], x[7]) for x in b], "property_id long, risk_score double")
    got = {}
    for r in P.nearest_peers(P.prepare(props, scores), k=10).collect():
        got.setdefault(r.property_id, set()).add(r.peer_id)
    for t in b:
        cands = []
        for c in b:
            if c[1] == t[1]:
                continue
            tu, cu = (t[4] if t[4] > 0 else None), (c[4] if c[4] > 0 else None)
            ty, cy = t[5] or None, c[5] or None
            if tu and cu and not (0.7 <= cu / tu <= 1.3):
                continue
            if ty and cy and abs(cy - ty) > 15:
                continue
            d = (0.0 if ty is None or cy is None else abs(cy - ty) / 15.0) \
                + (0.0 if tu is None or cu is None else abs(cu - tu) / tu) + (0.0 if c[6] == t[6] else 1.0)
            cands.append((d, c[0]))
        want = {cid for _, cid in sorted(cands)[:10]}
        assert got.get(t[0], set()) == want


def test_nearest_peers_stop_at_the_ring(spark):
    """Dense cells stop at small rings, thin ones search everything; both equal brute force, missing values included."""
    rnd = random.Random(23)
    b = []
    for i in range(320):
        dense = i % 2 == 0
        b.append((i, f"3{i // 2 if i % 40 < 2 else i + 1000:05d}0001", "t", "queens", rnd.choice([40, 41, 43, 50]) if dense else rnd.choice([None, 0, 3, 9, 52, 400]),
                  rnd.choice([1950, 1951, 1953, 1957]) if dense else rnd.choice([None, 0, 1890, 1946, 1962, 2001]),
                  rnd.choice(["A", "A", "B", None]), None if i % 9 == 0 else rnd.randrange(10000) / 100))
    props = spark.createDataFrame([x[:7] for x in b], "property_id long, bbl string, tenant_id string, borough string, "
                                  "units int, year_built int, building_class string")
    prepared = P.prepare(props, spark.createDataFrame([(x[0], x[7]) for x in b], "property_id long, risk_score double"))
    k = 4
    cells = prepared.withColumn("class_l", F.col("building_class")).groupBy(*P.KCELL).agg(
        F.count(F.lit(1)).alias("n"), F.lit(2).alias("most"))
    rings = {None if r.reach is None else round(r.reach, 2) for r in P._rings(cells, k).collect()}
    assert len(rings) >= 4 and None in rings and any(r is not None and r < 1 for r in rings) and any(r and r >= 1 for r in rings)
    got = {}
    for r in P.nearest_peers(prepared, k=k).collect():
        got.setdefault(r.property_id, set()).add((round(r.d, 9), r.peer_id))
    for t in b:
        found = []
        for c in b:
            tu, cu, ty, cy = t[4] or None, c[4] or None, t[5] or None, c[5] or None
            gap_u = abs(cu - tu) / tu if tu and cu else 0.0
            gap_y = abs(cy - ty) if ty and cy else 0
            if c[1] != t[1] and gap_y <= 15 and (not (tu and cu) or 0.7 <= cu / tu <= 1.3):
                found.append((gap_y / 15.0 + gap_u + (0.0 if c[6] == t[6] else 1.0), c[0]))
        assert got.get(t[0], set()) == {(round(d, 9), i) for d, i in sorted(found)[:k]}


def test_spread_join_of_a_hot_key(spark):
    """A third of the rows on one key: dealt over parts; same rows as a plain join, null keys and unknown keys left out."""
    rows = [(i, 7 if i % 3 == 0 else None if i % 50 == 1 else i % 40 + 100) for i in range(3000)]
    facts = spark.createDataFrame(rows, "id long, k long")
    dim = spark.createDataFrame([(7, "hot"), (None, "none")] + [(j, f"d{j}") for j in range(100, 130)], "k long, label string")
    parts = {r.k: r.parts for r in W.hot_parts(facts, "k", 12).collect()}
    assert parts == {7: 4}                               # 1000 rows, a share is 250
    got = sorted((r.id, r.k, r.label) for r in W.spread_join(facts, dim, "k", ["id"], 12).collect())
    labels = {7: "hot"} | {j: f"d{j}" for j in range(100, 130)}
    assert got == [(i, k, labels[k]) for i, k in rows if k in labels]
    assert W.spread_join(facts.limit(0), dim, "k", ["id"]).count() == 0


def test_hit_rate_with_ties(spark):
    from parcelwise.operators import usage as U
    rnd = random.Random(5)
    rows = []
    for i in range(400):
        c = 0 if i % 3 == 0 else rnd.randrange(1, 6)
        ts = T0 + dt.timedelta(minutes=rnd.randrange(0, 3000) // 7 * 7)     # many equal timestamps
        rows.append((i, c, rnd.choice(["a", "b"]), ts))
    df = spark.createDataFrame(rows, "request_id long, client long, endpoint string, ts timestamp_ntz")
    got = {r.endpoint: (r.hits, r.misses) for r in U.hit_rate(df, 3600).collect()}
    want = {}
    for ep in ("a", "b"):
        hits = misses = 0
        for c in {r[1] for r in rows}:
            sel = sorted([r for r in rows if r[1] == c and r[2] == ep], key=lambda r: (r[3], r[0]))
            for prev, cur in zip([None] + sel[:-1], sel):
                if prev is not None and cur[3] - prev[3] <= dt.timedelta(hours=1):
                    hits += 1
                else:
                    misses += 1
        want[ep] = (hits, misses)
    assert got == want


def test_null_hot_key_is_cut_before_the_shuffle(spark):
    rows = [(i, None if i % 3 == 0 else i % 50, i % 97) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k long, v long").withColumn("quota", F.lit(20))
    top = W.top_n_per_key(df, ["k"], [F.desc("v"), F.asc("id")], 5)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.id, r["rank"]) for r in top.filter("k is null").collect())
    want = sorted((r[0], n + 1) for n, r in enumerate(sorted([r for r in rows if r[1] is None], key=lambda r: (-r[2], r[0]))[:5]))
    assert got == want
    flags = W.first_k_flags(df, ["k"], [F.asc("v"), F.asc("id")], "id", "quota", slice_rows=64)
    nulls = sorted([r for r in rows if r[1] is None], key=lambda r: (r[2], r[0]))
    got = {r.id: r.position for r in flags.filter("k is null").collect()}
    assert got == {r[0]: (n + 1 if n < 20 else None) for n, r in enumerate(nulls)} and flags.count() == 3000


def test_bundle_pages_of_a_crowded_parcel(spark):
    """One parcel with most records, many of one moment; null feeds and times; pages against plain Python."""
    import datetime as dt
    from parcelwise.sources import feeds as FD
    keys = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "property_id long, bbl string")
    t = dt.datetime(2024, 1, 1)
    rows = [(1 + (i % 2), "x" if i % 5 else None, t + dt.timedelta(hours=i // 40), f"r{i:04d}") for i in range(900)]
    rows += [(3, "x", None, "late"), (3, "x", t, "early"), (4, "x", t, "no key"), (1, "x", t, "r0001")]
    recs = spark.createDataFrame(rows, "property_id long, feed string, ts timestamp_ntz, record string")
    bbl = {1: "a", 2: "a", 3: "b", 4: None}
    want = {}
    for p, f, ts, r in sorted(rows, key=lambda x: (x[2] is None, -(x[2] - t).total_seconds() if x[2] else 0, x[3])):
        want.setdefault((bbl[p], f), []).append(r)
    pages = FD.bundle_pages(keys, recs, 7).collect()
    assert all(r["n_records"] == len(r["records"]) <= 7 for r in pages)
    got = {}
    for r in sorted(pages, key=lambda r: r["page"]):
        got.setdefault((r["bbl"], r["feed"]), []).extend(r["records"])
    assert got == want


def test_webhooks_of_a_hot_property_and_a_hot_tenant(spark):
    """A third of the violations on one property, a third of the properties at one tenant: dealt over parts, same rows as a loop."""
    from parcelwise.streaming import jobs as J
    day = dt.date(2024, 1, 1)
    props = [(i, None if i == 50 else "Brand#2" if i % 3 == 0 else f"Brand#{i % 5 + 10}") for i in range(60)]
    vio = [(7 if n % 3 == 0 else n % 70 if n % 70 != 69 else None, n, n % 4, day, day if n % 2 else None) for n in range(1500)]
    hooks = J.webhook_hooks(spark.createDataFrame(props, "property_id long, tenant_id string").filter("tenant_id is not null"))
    wanted = J.wanted_events(spark.createDataFrame(props, "property_id long, tenant_id string"), hooks, 4)
    violations = spark.createDataFrame(vio, "property_id long, order_key long, line_no int, issued_date date, resolved_date date")
    events = J.violation_events(violations)
    hot = {(r.property_id, r.event_type) for r in W.hot_parts(events, ["property_id", "event_type"], 12).collect()}
    assert hot == {(7, "violation.new"), (7, "violation.resolved")}
    got = sorted((r.order_key, r.event_type, r.tenant_id, r.hook_id) for r in J.webhook_match(events, wanted, 12).collect())
    tenant = dict(props)
    want = []
    for p, n, _, _, resolved in vio:
        t = tenant.get(p)
        if t is None:
            continue
        want.append((n, "violation.new", t, f"hook-{t}"))
        if resolved and int(t.split("#")[1]) % 2 == 0:
            want.append((n, "violation.resolved", t, f"hook-{t}"))
    assert got == sorted(want)


def _plan_nodes(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_property_report_broadcasts_no_texts(spark):
    from parcelwise.operators import scoring as S
    rows = [(1, 1950), (2, 0), (3, None), (4, 2001), (5, 1700)]
    props = spark.createDataFrame([(i, "b", "x", "a", 3, y) for i, y in rows],
                                  "property_id long, bbl string, borough string, address string, units int, year_built int")
    report = S.property_report(props, "2024-03-01")
    assert "Broadcast" not in _plan_nodes(report)
    got = {r["property_id"]: r["report"] for r in report.collect()}
    assert {i for i, r in got.items() if "BUILDING ERA RISK ANALYSIS" in r} == {1, 4, 5}
    assert "Risk Factors" in got[1] and "Year Built: Unknown" in got[3] and "Year Built: 0" in got[2]


def _scored_buildings(spark, rows):
    props = spark.createDataFrame([(i, f"30000{i:05d}", "t", "brooklyn", u, y, "A") for i, u, y, _ in rows],
                                  "property_id long, bbl string, tenant_id string, borough string, units int, year_built int, building_class string")
    return P.prepare(props, spark.createDataFrame([(i, s) for i, _, _, s in rows], "property_id long, risk_score double"))


def test_peer_topn_plans_in_small_steps(spark):
    """The driver plans each step on a written table: the plan holds none of the steps before it."""
    p = _scored_buildings(spark, [(i, 10 + i % 3, 1950 + i % 7, float(i)) for i in range(60)])
    plan = _plan_nodes(P.peer_topn(p.localCheckpoint(), 5))
    assert plan.count("Window") <= 4 and plan.count("Join") <= 6, plan


def test_peer_stats_make_no_merged_histogram(spark, monkeypatch):
    """No step writes a row for each cell and each score that its peers have."""
    rows = [(i, 100 + i % 20, 1950, (i * 37 % 2000) / 20) for i in range(2000)]
    p, sizes = _scored_buildings(spark, rows), {}

    def count(df, name):
        df = df.persist()
        sizes[name] = df.count()
        return df
    monkeypatch.setattr(P, "written", count)
    got = {r["property_id"]: r for r in P.peer_stats(p).collect()}
    assert sizes and max(sizes.values()) <= 2 * len(rows)      # 20 cells admit 20 unit counts with 2000 scores in all
    for i, u, _, s in rows[::97]:
        peers = sorted(round(100 * x[3]) for x in rows if x[0] != i and 0.7 <= x[1] / u <= 1.3)
        n = len(peers)
        assert (got[i]["similar_count"], got[i]["below"]) == (n, sum(x < round(100 * s) for x in peers))
        assert got[i]["median_cents"] == (peers[(n - 1) // 2] + peers[n // 2]) / 2
