"""Ranking and window operators that stay exact when one key holds a third of the rows.

* ``top_n_per_key`` — newest/highest N per key in one window; the partial group limit
  cuts every map task's rows to N per key before the shuffle.
* ``first_k_flags`` — admission of the first k rows per key (k may vary per key): ranked
  in hash slices of bounded size first, then among the slices' first k.
* ``strict_percentile`` — share of a cohort strictly below each score, from a
  per-cohort score histogram (≤ 10 001 distinct 2-dp scores in 0–100), so a hot
  cohort is pre-aggregated before any window runs.
* ``trailing_count`` — count of a key's events in the trailing ``seconds``, as the
  difference of two running counts over (key, minute) segments.
* ``spread_join`` — rows looked up in a dimension, a hot key's rows dealt over several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

SLICE_ROWS = 100_000      # rows of a key that are sorted together when its first k are looked for


def top_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int,
                  rank_col: str | None = "rank") -> DataFrame:
    """Exact top-n rows per key under a total order (``order`` must break all ties).

    For n up to ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000) Catalyst cuts each
    map task's rows to n per key before the shuffle, so a hot key (NULL included) costs n rows
    for each task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    return out.withColumnRenamed("_r", rank_col) if rank_col else out.drop("_r")


def first_k_flags(df: DataFrame, keys: list[str], order: list[Column], id_col: str,
                  k_col: str, flag: str = "admitted", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Flag the first ``k_col`` rows per key (the same k on all rows of a key), all other rows False;
    ``position`` is the rank of a flagged row.

    A key's rows are ranked inside ``ceil(rows / slice_rows)`` slices chosen by a hash of ``id_col``;
    only the first k of each slice can be among the first k, and these are ranked once more.  The other
    rows keep their slice, so no sort holds a whole hot key."""
    counts = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(slice_rows)).alias("_slices"))
    counts = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_slices")
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    sliced = df.join(counts, same).drop(*[f"_k_{k}" for k in keys]) \
        .withColumn("_slice", F.pmod(F.xxhash64(id_col), F.col("_slices"))).drop("_slices")
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    sliced = sliced.withColumn("_first", F.row_number().over(inside) <= F.col(k_col))
    group = F.when(F.col("_first"), F.lit(-1)).otherwise(F.col("_slice"))
    ranked = sliced.withColumn("_group", group)
    ranked = ranked.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_group").orderBy(*order)))
    position = F.when(F.col("_first") & (F.col("_r") <= F.col(k_col)), F.col("_r"))
    return ranked.withColumn("position", position).withColumn(flag, F.col("position").isNotNull()) \
        .drop("_slice", "_first", "_group", "_r")


def strict_percentile(df: DataFrame, cohort: list[str], score: str, out: str = "percentile") -> DataFrame:
    """Percent of the *other* members of a cohort with a strictly lower score.

    ``score`` must be a 2-dp value; rows without a score are dropped.  Null when
    the cohort has no other member."""
    cents = F.round(F.col(score) * 100).cast("long")
    scored = df.filter(F.col(score).isNotNull()).withColumn("_cents", cents)
    hist = scored.groupBy(*cohort, "_cents").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*cohort).orderBy("_cents").rowsBetween(Window.unboundedPreceding, -1)
    wt = Window.partitionBy(*cohort)
    cum = hist.select(*cohort, "_cents",
                      F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_below"),
                      F.sum("_n").over(wt).alias("_size"))
    j = scored.join(cum, cohort + ["_cents"])
    pct = F.try_divide(F.col("_below") * 100.0, F.col("_size") - 1)
    return j.withColumn(out, F.bround(pct, 2)).withColumnRenamed("_below", "peers_below") \
            .withColumn("peers", F.col("_size") - 1).drop("_cents", "_size")


def trailing_count(df: DataFrame, key: str, ts: str, seconds: int, out: str = "trailing_count") -> DataFrame:
    """For each row, the number of rows of the same key with ts in [ts - seconds, ts]; 0 without a ts.

    The difference of two running counts: rows up to ts, and rows before ts - seconds.  Both come
    from one segmented scan over the key's distinct moments (``temporal.running``)."""
    from parcelwise.operators.temporal import running
    span = int(seconds) * 1_000_000
    base = df.withColumn("_e", F.unix_micros(F.col(ts).cast("timestamp")))
    moments = base.groupBy(F.col(key).alias("_key"), F.col("_e").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    marks = F.array(F.struct(F.col("_at").alias("_t"), F.lit(0).alias("_kind"), F.col("_n").alias("_add")),
                    F.struct((F.col("_at") - span - 1).alias("_t"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_add")))
    scan = running(moments.select("_key", "_at", F.inline(marks)), ["_key"], "_t", "_kind", "_add", True, "_run")
    counts = scan.groupBy("_key", "_at").agg(F.sum(F.when(F.col("_kind") == 0, F.col("_run")).otherwise(-F.col("_run"))).alias(out))
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col("_e").eqNullSafe(F.col("_at"))
    return base.join(counts, same).drop("_key", "_at", "_e")


def _columns(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else key


def hot_parts(facts: DataFrame, key: str | list[str], shares: int = 4096) -> DataFrame:
    """(key, or its columns, and parts) of the keys with more than 1 / ``shares`` of all rows, so at most ``shares`` rows; a part holds
    at most such a share."""
    total = facts.agg(F.count(F.lit(1)).alias("n")).scalar()
    n = F.count(F.lit(1))
    return facts.groupBy(*_columns(key)).agg(F.ceil(n * shares / total).cast("long").alias("parts")).filter(F.col("parts") > 1)


def spread_join(facts: DataFrame, dim: DataFrame, key: str | list[str], row_id: list[str], shares: int = 4096) -> DataFrame:
    """Inner join of ``facts`` with ``dim`` on ``key``.  The rows of a hot key are dealt over its ``hot_parts`` by a hash
    of ``row_id``, and its dimension rows go once to each part.  The directory has at most ``shares`` rows, so it is
    broadcast.  Rows without a key are dropped, as in any inner join."""
    directory = F.broadcast(hot_parts(facts, key, shares))
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    f = facts.join(directory, key, "left").select(*facts.columns, F.pmod(F.xxhash64(*row_id), parts).alias("_part"))
    d = dim.join(directory, key, "left").select(
        *dim.columns, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("_part"))
    return f.join(d, [*_columns(key), "_part"]).drop("_part")


def date_spine(keys: DataFrame, start: str, end: str, col: str = "day") -> DataFrame:
    """One row per key and day in [start, end] — a generator, not a join."""
    return keys.select("*", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias(col))
