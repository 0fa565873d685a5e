"""Time-ordered joins: as-of lookup (J14) and the 14-day conversion join.

Both are a *segmented scan* instead of a pairwise join:

1. probes and events are unioned and cut into (key, minute) segments;
2. inside a segment a running max (rows frame, O(n)) gives the latest event at
   or before each probe;
3. one row per (key, minute) carries the segment's latest event: a running max over a
   day's minutes, and one over a key's days, give the latest event of all *earlier* segments.

A key holding a third of all rows is split into minutes, no window holds more than a
minute's rows, a day's minutes or a key's days, and no (probe, event) pair is ever emitted.
The forward direction ("first event at or after") is the same scan over negated time.
Rows with a NULL key are a key of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

DAY_US = 86_400_000_000
MINUTE_US = 60_000_000


def _epoch(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(col.cast("timestamp"))


def running(df: DataFrame, keys: list[str], t: str, tie: str, value: str, total: bool, out: str,
            segment_us: int = MINUTE_US) -> DataFrame:
    """``out``: the sum (``total``) or the maximum of ``value`` over the rows of the same key up to
    this one in (t, tie) order, t in microseconds."""
    how = F.sum if total else F.max

    def both(a: str, b: str) -> Column:
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)) if total else F.greatest(a, b)

    cut = df.withColumn("_s", F.floor(F.col(t) / segment_us))
    inside = Window.partitionBy(*keys, "_s").orderBy(t, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.withColumn("_local", how(value).over(inside))
    names = [f"_k_{k}" for k in keys]
    segments = (cut.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("_s").alias("_ks"))
                .agg(how(value).alias("_v")).withColumn("_day", F.floor(F.col("_ks") * segment_us / DAY_US)))
    earlier = (Window.unboundedPreceding, -1)
    in_day = segments.withColumn("_in_day", how("_v").over(
        Window.partitionBy(*names, "_day").orderBy("_ks").rowsBetween(*earlier)))
    days = (segments.groupBy(*[F.col(n).alias(f"_d{n}") for n in names], F.col("_day").alias("_d_day"))
            .agg(how("_v").alias("_v"))
            .withColumn("_days", how("_v").over(
                Window.partitionBy(*[f"_d{n}" for n in names]).orderBy("_d_day").rowsBetween(*earlier))).drop("_v"))
    same_day = [F.col(n).eqNullSafe(F.col(f"_d{n}")) for n in names] + [F.col("_day").eqNullSafe(F.col("_d_day"))]
    carry = in_day.join(days, same_day).select(*names, "_ks", both("_in_day", "_days").alias("_carry"))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)] + [F.col("_s").eqNullSafe(F.col("_ks"))]
    return (local.join(carry, same).withColumn(out, both("_local", "_carry"))
            .drop(*names, "_s", "_ks", "_local", "_carry"))


def asof_epoch(probes: DataFrame, events: DataFrame, key: str | list[str], probe_e: str, event_e: str,
               out: str = "asof_e") -> DataFrame:
    """For each probe row, the greatest ``event_e`` ≤ ``probe_e`` of the same key (epoch longs)."""
    keys = [key] if isinstance(key, str) else list(key)
    p = probes.withColumn("_kind", F.lit(1)).withColumn("_t", F.col(probe_e))
    e = events.select(*keys, F.col(event_e).alias("_t")).withColumn("_kind", F.lit(0))
    u = p.unionByName(e, allowMissingColumns=True).withColumn("_ev", F.when(F.col("_kind") == 0, F.col("_t")))
    return running(u, keys, "_t", "_kind", "_ev", False, out).filter(F.col("_kind") == 1).drop("_kind", "_t", "_ev")


def previous_distinct(df: DataFrame, keys: list[str], e: str, out: str = "prev_e") -> DataFrame:
    """One row per distinct (keys, e) with the previous distinct epoch of the same key —
    the as-of scan at e − 1 µs (timestamps are whole microseconds)."""
    d = df.select(*keys, e).distinct()
    probes = d.withColumn("_pe", F.col(e) - 1)
    return asof_epoch(probes, d.select(*keys, F.col(e).alias("_ee")), keys, "_pe", "_ee", out=out).drop("_pe")


def asof_backward(probes: DataFrame, events: DataFrame, key: str, probe_ts: str, event_ts: str,
                  out: str = "asof_ts") -> DataFrame:
    """Latest event at or before each probe (same key)."""
    p = probes.withColumn("_pe", _epoch(probe_ts))
    e = events.withColumn("_ee", _epoch(event_ts))
    r = asof_epoch(p, e, key, "_pe", "_ee", out="_ae")
    return r.withColumn(out, F.timestamp_micros("_ae").cast("timestamp_ntz")).drop("_pe", "_ae")


def first_after(probes: DataFrame, events: DataFrame, key: str, probe_ts: str, event_ts: str,
                out: str = "next_ts") -> DataFrame:
    """Earliest event at or after each probe (same key) — the backward scan on negated time."""
    p = probes.withColumn("_pe", -_epoch(probe_ts))
    e = events.withColumn("_ee", -_epoch(event_ts))
    r = asof_epoch(p, e, key, "_pe", "_ee", out="_ae")
    return r.withColumn(out, F.timestamp_micros(-F.col("_ae")).cast("timestamp_ntz")).drop("_pe", "_ae")


def snapshot_asof(probes: DataFrame, snapshots: DataFrame, key: str, probe_ts: str, snap_ts: str,
                  ttl_seconds: int) -> DataFrame:
    """J14 with the stale flag: the freshest snapshot at or before the probe; stale when
    older than the TTL; null when there is none."""
    r = asof_backward(probes, snapshots, key, probe_ts, snap_ts, out="snapshot_ts")
    age = _epoch(probe_ts) - _epoch("snapshot_ts")
    return r.withColumn("is_stale", age > int(ttl_seconds) * 1_000_000)


def conversion(complaints: DataFrame, violations: DataFrame, key: str, c_ts: str, v_ts: str,
               within_days: int = 14) -> DataFrame:
    """First violation at or after each complaint; converted when it falls within
    ``within_days``; lag in hours (4 dp)."""
    r = first_after(complaints, violations, key, c_ts, v_ts, out="first_violation")
    lag_us = _epoch("first_violation") - _epoch(c_ts)
    conv = F.coalesce(lag_us <= int(within_days) * DAY_US, F.lit(False))
    return (r.withColumn("converted", conv)
            .withColumn("first_violation", F.when(conv, F.col("first_violation")))
            .withColumn("lag_hours", F.when(conv, F.bround(lag_us / 3_600_000_000.0, 4))))


def conversion_summary(conv: DataFrame, by: str, c_ts: str = "created") -> DataFrame:
    """Conversion rate (4 dp) and mean lag in hours (2 dp) per group.  The lag is summed
    in integer microseconds, so the mean does not depend on how partial sums combine."""
    lag_us = F.when(F.col("converted"), _epoch("first_violation") - _epoch(c_ts))
    return conv.groupBy(by).agg(
        F.count(F.lit(1)).alias("complaints"), F.count_if("converted").alias("converted"),
        F.sum(lag_us).alias("_lag"), F.count(lag_us).alias("_n")).select(
        by, "complaints", "converted",
        F.bround(F.col("converted") / F.col("complaints"), 4).alias("conversion_rate"),
        F.bround(F.try_divide(F.col("_lag"), F.col("_n")) / 3_600_000_000.0, 2).alias("avg_lag_hours"))
