"""Per-client rate limiters (ST3 sliding log, ST4 token bucket).

Both are sequential folds over a client's requests in (ts, id) order: a
rejected request changes the state differently from an admitted one, so no
window aggregate expresses them.  Spark still partitions the work:

* a client's history is cut into *segments* at idle gaps after which the
  limiter state is provably back to its initial value (gap > window for the
  sliding log — every logged request has been evicted; gap ≥ period for the
  token bucket — the bucket has refilled to capacity).  Segments are found with
  time-bucketed as-of scans; rows are hash-partitioned on (client,
  segment) and sorted, and one ``mapInPandas`` pass folds run after run — so a
  busy client is split along time and no per-group Python call is paid;
* the fold itself is one integer rule per request, shared by batch and stream.

The streaming versions keep the same state per client with
``applyInPandasWithState``.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT_SCHEMA = "client long, request_id long, ts timestamp_ntz, admitted boolean"


def _segments(requests: DataFrame, reset_us: int, strict: bool) -> DataFrame:
    """Segment id (= epoch of the segment's first request) for every request.

    A new segment starts at a distinct timestamp whose gap to the client's previous
    distinct timestamp exceeds the reset (``>`` when ``strict``, else ``≥``).  Both
    steps are time-bucketed as-of scans, so a client with a third of all requests is
    split along time instead of sorted whole in one task."""
    from parcelwise.operators.temporal import asof_epoch, previous_distinct
    r = requests.select("client", "request_id", "ts").withColumn("_e", F.unix_micros(F.col("ts").cast("timestamp")))
    prev = previous_distinct(r, ["client"], "_e", out="_prev")
    gap = F.col("_e") - F.col("_prev")
    starts = prev.filter(F.col("_prev").isNull() | ((gap > reset_us) if strict else (gap >= reset_us))) \
        .select("client", F.col("_e").alias("_start"))
    return asof_epoch(r, starts, "client", "_e", "_start", out="segment").drop("_e")


class SlidingLog:
    """At most ``limit`` admitted requests in any window: a request passes when the ``limit``-th last
    admitted one lies before the window.  State: the last ``limit`` admitted times."""

    state_schema = "log array<long>"

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window_us = limit, window_us

    def load(self, stored: tuple | None) -> deque:
        return deque(stored[0] if stored else (), maxlen=self.limit)

    def dump(self, ring: deque) -> tuple:
        return (list(ring),)

    def admit(self, ring: deque, now: int) -> bool:
        if len(ring) == self.limit and not (ring and ring[0] < now - self.window_us):
            return False
        ring.append(now)
        return True


class TokenBucket:
    """``rate`` tokens of burst, refilled evenly over ``per_us``, as one theoretical arrival time: the time
    at which the bucket would be full again.  A request passes while that time is at most ``rate - 1``
    token intervals ahead, and moves it by one.  Times count in 1/rate microseconds, so an
    interval is the integer ``per_us`` and nothing is rounded.  State: that time."""

    state_schema = "full_at string"     # a decimal integer: it can exceed 64 bits for large rates

    def __init__(self, rate: int, per_us: int):
        self.rate, self.per_us = rate, per_us

    def load(self, stored: tuple | None) -> list[int]:
        return [int(stored[0])] if stored else []

    def dump(self, state: list[int]) -> tuple:
        return (str(state[0]),)

    def admit(self, state: list[int], now: int) -> bool:
        clock = now * self.rate
        full_at = max(state[0], clock) if state else clock
        passes = full_at - clock <= (self.rate - 1) * self.per_us
        state[:] = [full_at + self.per_us if passes else full_at]
        return passes


def _fold_sorted(seg: DataFrame, rule) -> DataFrame:
    """Fold ``rule`` over every (client, segment) run.

    Rows are hash-partitioned on (client, segment) — segments of one busy client
    land in different tasks — and sorted inside each partition, so one pass of
    ``mapInPandas`` folds run after run; the state is carried across Arrow
    batches while the run continues."""
    ordered = (seg.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
               .repartition("client", "segment")
               .sortWithinPartitions("client", "segment", "ts", "request_id"))

    def run(batches):
        current, state = None, None
        for pdf in batches:
            admitted = []
            for client, segment, now in zip(pdf["client"].tolist(), pdf["segment"].tolist(), pdf["_us"].tolist()):
                if (client, segment) != current:
                    current, state = (client, segment), rule.load(None)
                admitted.append(rule.admit(state, now))
            yield pdf[["client", "request_id", "ts"]].assign(admitted=admitted)

    return ordered.mapInPandas(run, OUT_SCHEMA)


def sliding_rule(max_messages: int = 100, window_seconds: int = 60) -> SlidingLog:
    return SlidingLog(max_messages, int(window_seconds) * 1_000_000)


def bucket_rule(rate: int = 1000, per: float = 60.0) -> TokenBucket:
    return TokenBucket(rate, int(per * 1_000_000))


def rate_limit_sliding(requests: DataFrame, max_messages: int = 100, window_seconds: int = 60) -> DataFrame:
    rule = sliding_rule(max_messages, window_seconds)
    return _fold_sorted(_segments(requests, rule.window_us, strict=True), rule)


def rate_limit_token_bucket(requests: DataFrame, rate: int = 1000, per: float = 60.0) -> DataFrame:
    rule = bucket_rule(rate, per)
    return _fold_sorted(_segments(requests, rule.per_us, strict=False), rule)


STREAM_SCHEMA = OUT_SCHEMA + ", nth long, revision long, late boolean"
HELD_SCHEMA = ", base_us long, held_us array<long>, held_id array<long>, held_ok array<boolean>, revision long, late long"


def state_function(rule, delay_us: int):
    """The rule for ``applyInPandasWithState``, whatever the order and cutting of the micro-batches.

    State: the rule's state after the requests up to ``base_us`` (the client's newest request less
    the delay) and the requests since, with their decisions.  A micro-batch's requests are merged into these in (ts, id)
    order and decided again, and a request is emitted when it is new or its decision has changed; ``latest``
    keeps the last one.  A request at or before ``base_us`` on arrival is late: it is decided
    with the state of that time, once, and marked."""
    def fold(key, frames, state):
        *stored, base, times, ids, told, revision, late = state.get if state.exists else (None, None, [], [], [], 0, 0)
        settled = rule.load(tuple(stored) if state.exists and stored[0] is not None else None)
        held, out, client = list(zip(times, ids, told)), [], key[0]
        for pdf in frames:
            for now, rid in zip(pdf["ts"].astype("datetime64[us]").astype("int64").tolist(), pdf["request_id"].tolist()):
                if base is None or now > base:
                    held.append((now, rid, None))
                else:
                    late += 1
                    out.append((rid, now, rule.admit(settled, base), -late, 0, True))
        held.sort(key=lambda x: x[:2])           # stable: of equal requests those already told come first
        revision += 1
        newest = held[-1][0] - delay_us if held else base
        base = newest if base is None else max(base, newest)
        cut = bisect_right(held, base, key=lambda x: x[0])
        open_, nth, decided = None, 0, []
        for i, (now, rid, before) in enumerate(held):
            if i == cut:
                open_ = rule.load(rule.dump(settled)) if settled else rule.load(None)
            nth = nth + 1 if i and held[i - 1][:2] == (now, rid) else 0
            decided.append(rule.admit(settled if open_ is None else open_, now))
            if before is None or bool(before) != decided[-1]:
                out.append((rid, now, decided[-1], nth, revision, False))
        rest = held[cut:]
        state.update((*(rule.dump(settled) if settled else (None,)), base, [t for t, _, _ in rest], [r for _, r, _ in rest], decided[cut:],
                      revision, late))
        for at in range(0, len(out), 100_000):
            rid, ts, admitted, nth, rev, was_late = zip(*out[at:at + 100_000])
            yield pd.DataFrame({"client": [client] * len(rid), "request_id": rid, "ts": pd.to_datetime(list(ts), unit="us"),
                                "admitted": admitted, "nth": nth, "revision": rev, "late": was_late})
    return fold


def latest(decisions: DataFrame) -> DataFrame:
    """The last decision of each request."""
    return decisions.groupBy("client", "request_id", "ts", "nth").agg(F.max_by("admitted", "revision").alias("admitted")).drop("nth")
