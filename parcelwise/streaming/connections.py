"""Connection state as keyed state machines (ST1, ST5, A21).

Both run on ``transformWithStateInPandas`` and tell rows only for what changed.  Rows may arrive in any order, those of
``ConnectionState`` (one small state a connection, event-time timers) within the watermark's delay.

* ``ConnectionState`` holds a connection's messages until the watermark passes them and then applies them
  in (time, id) order: AUTHENTICATE, SUBSCRIBE (refused before authentication or without a property),
  UNSUBSCRIBE, PING.  A connection opens with its first message; when no PING follows within the limit it is
  dropped: its subscriptions end and it is no longer authenticated.
* ``Undelivered`` is a ring of the newest ``size`` messages of a connection that could not be
  delivered; a DRAIN row delivers everything up to its time.  Connections share states in buckets, worked on as columns.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# The driver unpickles a processor too, in a worker that has neither ``addPyFile`` archives nor the repository on its
# path: the classes of this module travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHANGES = ("connection long, property_id string, change string, authenticated boolean, ts timestamp, seq long")
CONNECTED, DROPPED, REFUSED, AUTHENTICATED = "CONNECTED", "DROPPED", "REFUSED", "AUTHENTICATED"


def _missing(x) -> bool:
    return x is None or x != x


class Machine:
    """The rules of one connection; times in microseconds.  Yields (property or None, change, time)."""

    def __init__(self, limit_us: int, authenticated: bool = False, last_ping: int | None = None, subscribed: set[str] | None = None):
        self.limit_us, self.authenticated, self.last_ping = limit_us, authenticated, last_ping
        self.subscribed = set() if subscribed is None else subscribed

    def expire(self, now: int) -> Iterator[tuple[str | None, str, int]]:
        """Drop the connection if its limit has passed before ``now``."""
        if self.last_ping is not None and now > self.last_ping + self.limit_us:
            at = self.last_ping + self.limit_us
            self.authenticated, self.last_ping = False, None
            for p in sorted(self.subscribed):
                yield p, "UNSUBSCRIBE", at
            self.subscribed.clear()
            yield None, DROPPED, at

    def apply(self, now: int, kind: str, prop: str | None) -> Iterator[tuple[str | None, str, int]]:
        yield from self.expire(now)
        if self.last_ping is None:
            self.last_ping = now
            yield None, CONNECTED, now
        if kind == "PING":
            self.last_ping = now
        elif kind == "AUTHENTICATE":
            if not self.authenticated:
                self.authenticated = True
                yield None, AUTHENTICATED, now
        elif kind == "SUBSCRIBE":
            if not self.authenticated or not prop:
                yield prop, REFUSED, now
            elif prop not in self.subscribed:
                self.subscribed.add(prop)
                yield prop, "SUBSCRIBE", now
        elif kind == "UNSUBSCRIBE" and prop in self.subscribed:
            self.subscribed.discard(prop)
            yield prop, "UNSUBSCRIBE", now


class ConnectionState(StatefulProcessor):
    def __init__(self, limit_seconds: int):
        self.limit_us = int(limit_seconds) * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", "authenticated boolean, last_ping long, seq long")
        self.subscribed = handle.getMapState("subscribed", "property_id string", "one int")
        self.waiting = handle.getListState("waiting", "t long, id long, kind string, prop string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t), int(i), k, None if _missing(p) else p) for b in rows
               for t, i, k, p in zip(b["t_us"].tolist(), b["message_id"].tolist(), b["type"].tolist(), b["property_id"].tolist())]
        if new:
            self.waiting.appendList(new)
            self.wake(min(t for t, *_ in new))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        auth, ping, seq = self.facts.get() if self.facts.exists() else (False, None, 0)
        before = {k[0] for k in self.subscribed.keys()} if self.subscribed.exists() else set()
        machine, out = Machine(self.limit_us, auth, ping, set(before)), []
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], r[1], r[2] or "", r[3] or "")) if self.waiting.exists() else []
        due, rest = [r for r in rows if r[0] <= watermark], [r for r in rows if r[0] > watermark]
        for t, _, kind, prop in due:
            out += [(*x, machine.authenticated) for x in machine.apply(t, kind, prop)]
        out += [(*x, machine.authenticated) for x in machine.expire(watermark)]
        for p in before - machine.subscribed:
            self.subscribed.removeKey((p,))
        for p in machine.subscribed - before:
            self.subscribed.updateValue((p,), (1,))
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if machine.last_ping is None and not rest:
            self.facts.clear() if not out else self.facts.update((False, None, seq + len(out)))
        else:
            self.facts.update((machine.authenticated, machine.last_ping, seq + len(out)))
        next_ = [r[0] for r in rest] + ([machine.last_ping + self.limit_us + 1] if machine.last_ping is not None else [])
        if next_:
            self.wake(max(min(next_), watermark + 1))
        if out:
            p, change, t, authenticated = zip(*out)
            yield pd.DataFrame({"connection": [int(key[0])] * len(out), "property_id": pd.Series(p, dtype=object), "change": change,
                                "authenticated": authenticated, "ts": pd.to_datetime(pd.Series(t), unit="us"),
                                "seq": range(seq, seq + len(out))})

    def wake(self, at_us: int) -> None:
        at = -(-at_us // 1000)
        for old in list(self.handle.listTimers()):
            if old <= at:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def connection_changes(messages: DataFrame, limit_seconds: int = 3 * 86_400, delay: str = "1 day") -> DataFrame:
    """ST1: (connection, ts, message_id, type, property_id) messages to the changes of connections and subscriptions.
    Messages without a connection or a time open none; the filter holds the event time, so it stays above the watermark,
    which all messages move."""
    m = messages.select("connection", "message_id", "type", "property_id", F.col("ts").cast("timestamp").alias("event_time")) \
        .withWatermark("event_time", delay).filter(F.when(F.col("connection").isNotNull(), F.col("event_time")).isNotNull()) \
        .withColumn("t_us", F.unix_micros("event_time"))
    return m.groupBy("connection").transformWithStateInPandas(ConnectionState(limit_seconds), CHANGES, "append", "EventTime")


def subscriptions_of(changes: DataFrame) -> DataFrame:
    """What holds after all changes: (connection, property_id)."""
    last = changes.filter(F.col("change").isin("SUBSCRIBE", "UNSUBSCRIBE")).groupBy("connection", "property_id") \
        .agg(F.max_by("change", "seq").alias("change"))
    return last.filter("change = 'SUBSCRIBE'").select("connection", "property_id")


def connection_stats(changes: DataFrame) -> DataFrame:
    """Open and authenticated connections, subscriptions and their properties."""
    last = changes.filter(F.col("change").isin(CONNECTED, DROPPED, AUTHENTICATED)).groupBy("connection") \
        .agg(F.max_by("change", "seq").alias("change"))
    rows = last.select("change", F.lit(None).cast("string").alias("property_id")) \
        .unionByName(subscriptions_of(changes).select(F.lit("SUBSCRIBE").alias("change"), "property_id"))
    return rows.agg(F.count_if(F.col("change").isin(CONNECTED, AUTHENTICATED)).alias("active_connections"),
                    F.count_if(F.col("change") == AUTHENTICATED).alias("authenticated_connections"),
                    F.count_if(F.col("change") == "SUBSCRIBE").alias("total_subscriptions"),
                    F.count_distinct("property_id").alias("unique_properties"))


QUEUED, EVICTED, DRAINED = "queued", "evicted", "drained"

# Messages travel and rest as Arrow record batches of many rows, a bucket of connections each: a row of its own for each
# message and a state of its own for each connection cost more than the messages themselves.  The number of buckets is part
# of a stream's state; connections that are null have the last bucket.
BUCKETS, CHUNK_ROWS, CHUNK_BYTES = 4096, 1 << 18, 32 << 20
MESSAGE = pa.schema([("connection", pa.int64()), ("t_us", pa.int64()), ("update_id", pa.int64()), ("property_id", pa.int64()),
                     ("severity", pa.string()), ("drain", pa.bool_())])
CHANGE = ("connection long, property_id long, update_id long, severity string, t_us long, change string, revision long, copies long")
NEVER = np.iinfo(np.int64).min      # of a connection that was never drained


def _kept(rows: pa.Table) -> bytes:
    """Rows as a state value: compressed, as state stays in memory and is copied to the checkpoint."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, MESSAGE, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(rows)
    return sink.getvalue().to_pybytes()


def _rows(blobs) -> pa.Table:
    return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(b), MESSAGE) for b in blobs], MESSAGE)


def _numbers(rows: pa.Table, name: str) -> np.ndarray:
    return rows[name].fill_null(0).to_numpy()


def _keys(rows: pa.Table, *names: str) -> list[np.ndarray]:
    """What the rows sort by, most significant first; a null is the least."""
    out = []
    for c in names:
        col = rows[c].combine_chunks()
        if col.null_count:
            out.append(col.is_valid().to_numpy(zero_copy_only=False))
        if pa.types.is_string(col.type):
            codes = col.dictionary_encode()
            place = np.empty(len(codes.dictionary), np.int64)
            place[pc.sort_indices(codes.dictionary).to_numpy()] = np.arange(len(place))
            codes = codes.indices.fill_null(0).to_numpy(zero_copy_only=False)
            out.append(place[codes] if len(place) else np.zeros(len(codes), np.int64))
        else:
            out.append(col.fill_null(0).to_numpy(zero_copy_only=False))
    return out


def _same(keys: list[np.ndarray]) -> np.ndarray:
    """Whether each sorted row equals the one before it."""
    if not len(keys[0]):
        return np.zeros(0, bool)
    return np.r_[False, np.logical_and.reduce([k[1:] == k[:-1] for k in keys])]


def _aged(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The rows by connection and age, the oldest first, and whether each equals the one before it."""
    first = _keys(rows, "connection", "t_us", "update_id")
    order = np.lexsort(first[::-1])
    same = _same([k[order] for k in first])
    if same.any():
        keys = first + _keys(rows, "property_id", "severity")
        order = np.lexsort(keys[::-1])
        same = _same([k[order] for k in keys])
    return rows.take(order), same


def _runs(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal sorted rows start, and how long they are."""
    starts = np.flatnonzero(~_same(keys))
    return starts, np.diff(np.r_[starts, len(keys[0])])


def _from_end(rows: pa.Table) -> np.ndarray:
    """Of rows sorted by connection, how many of the same connection follow each."""
    starts, sizes = _runs(_keys(rows, "connection"))
    return np.repeat(starts + sizes, sizes) - np.arange(len(rows)) - 1


def newest(rows: pa.Table, size: int) -> pa.Table:
    """The newest ``size`` messages of each connection and its last DRAIN row."""
    drain = rows["drain"].to_numpy()
    if drain.any():
        last = _aged(rows.filter(pc.and_(rows["drain"], rows["t_us"].is_valid())))[0]
        return pa.concat_tables([newest(rows.filter(~drain), size), last.filter(_from_end(last) == 0)])
    keys = _keys(rows, "connection")
    order = np.lexsort(keys[::-1])
    sizes = _runs([k[order] for k in keys])[1]
    many = np.zeros(len(rows), bool)
    many[order] = np.repeat(sizes, sizes) > size
    if not many.any():
        return rows
    over = _aged(rows.filter(many))[0]
    return pa.concat_tables([rows.filter(~many), over.filter(_from_end(over) < size)])


def _packed(size: int):
    """(bucket, rows): the messages of a bucket in one value; what a ring can no longer hold does not travel."""
    def pack(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = newest(pa.Table.from_batches(held), size)
        bucket = rows["bucket"].to_numpy().astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        starts, sizes = _runs([bucket])
        whole = rows.select(MESSAGE.names).take(order).cast(MESSAGE).combine_chunks().to_batches()
        blobs = [whole[0].slice(a, n).serialize().to_pybytes() for a, n in zip(starts, sizes)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size_ = [], 0, 0
        for b in batches:
            held.append(b)
            n, size_ = n + b.num_rows, size_ + b.nbytes
            if n >= CHUNK_ROWS or size_ >= CHUNK_BYTES:
                yield from pack(held)
                held, n, size_ = [], 0, 0
        if n:
            yield from pack(held)
        del held
        pa.default_memory_pool().release_unused()     # a worker lives on after its task
    return run


class Undelivered(StatefulProcessor):
    """The newest ``size`` undelivered messages of each connection of a bucket, by (time, id); order of arrival does not
    matter.  Messages without a time are the oldest.  A message that comes twice is queued twice: a change tells how many
    ``copies`` are left.  State: the rings in one value, and what is known of each connection (until when it is drained, its
    number of revisions) in another."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("rings", "ring binary, facts binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ring, facts = self.state.get() or (None, b"")
        old = pa.ipc.open_stream(ring).read_all() if ring else _rows([])
        known, drained, revision = np.frombuffer(facts, np.int64).reshape(3, -1)
        new = _rows([])
        for b in rows:
            new = newest(pa.concat_tables([new, _rows(b["rows"])]), self.size)       # bounded whatever the micro-batch holds
        drain = new["drain"].to_numpy()
        touched, to = _numbers(new, "connection"), _numbers(new, "t_us")
        all_ = np.union1d(known, touched)
        at = np.searchsorted(all_, known)
        drained_to, revisions = np.full(len(all_), NEVER), np.zeros(len(all_), np.int64)
        drained_to[at], revisions[at] = drained, revision
        revisions[np.searchsorted(all_, np.unique(touched))] += 1
        np.maximum.at(drained_to, np.searchsorted(all_, touched[drain]), to[drain])

        both, same = _aged(pa.concat_tables([old, new.filter(~drain)])
                           .append_column("old", pa.array(np.r_[np.ones(len(old), bool), np.zeros(len(new) - int(drain.sum()), bool)])))
        at = np.searchsorted(all_, _numbers(both, "connection"))
        gone = (drained_to[at] != NEVER) & (~both["t_us"].is_valid().to_numpy() | (_numbers(both, "t_us") <= drained_to[at]))
        kept = (_from_end(both) < self.size) & ~gone
        self.state.update((_kept(both.filter(kept).select(MESSAGE.names)), np.stack([all_, drained_to, revisions]).tobytes()))
        starts = np.flatnonzero(~same)
        if not len(starts):
            return
        before, after = (np.add.reduceat(x.astype(np.int64), starts) for x in (both["old"].to_numpy(), kept))
        told = before != after
        starts, before, after = starts[told], before[told], after[told]
        change = np.where(after > before, QUEUED, np.where(gone[starts], DRAINED, EVICTED)).astype(object)
        told, revision = both.take(starts), revisions[at[starts]]
        for i in range(0, len(starts), 1 << 16):
            part = slice(i, i + (1 << 16))
            t = told.slice(i, 1 << 16)
            column = lambda c: t[c].to_pandas(integer_object_nulls=True)  # noqa: B023, E731
            yield pd.DataFrame({"connection": column("connection") if key[0] < BUCKETS else pd.Series([None] * len(t), dtype=object),
                                "property_id": column("property_id"), "update_id": column("update_id"), "severity": column("severity"),
                                "t_us": column("t_us"), "change": change[part], "revision": revision[part], "copies": after[part]})

    def close(self) -> None:
        pass


def undelivered(messages: DataFrame, size: int = 100) -> DataFrame:
    """ST5: (connection, kind, property_id, update_id, severity, ts) rows, kind MESSAGE or DRAIN, to changes of the queues."""
    bucket = F.when(F.col("connection").isNull(), F.lit(BUCKETS)).otherwise(F.pmod(F.xxhash64(F.col("connection").cast("long")), F.lit(BUCKETS)))
    m = messages.select(bucket.cast("int").alias("bucket"), F.col("connection").cast("long").alias("connection"),
                        F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), F.col("update_id").cast("long").alias("update_id"),
                        F.col("property_id").cast("long").alias("property_id"), F.col("severity").cast("string").alias("severity"),
                        F.col("kind").eqNullSafe("DRAIN").alias("drain"))
    changes = m.mapInArrow(_packed(size), "bucket int, rows binary").groupBy("bucket") \
        .transformWithStateInPandas(Undelivered(size), CHANGE, "update", "None")
    return changes.select("connection", "property_id", "update_id", "severity", F.timestamp_micros("t_us").alias("ts"), "change", "revision", "copies")


def queue_of(changes: DataFrame) -> DataFrame:
    """The queues after all changes."""
    key = ["connection", "property_id", "update_id", "severity", "ts"]
    last = changes.groupBy(*key).agg(F.max_by("copies", "revision").alias("copies")).filter("copies > 0")
    return last.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*key)
