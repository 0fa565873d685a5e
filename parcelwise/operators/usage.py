"""API usage: quotas, tier caps, usage reports, cache hit rate, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import dims as D
from parcelwise.functions import rules as R
from parcelwise.operators.windows import first_k_flags, top_n_per_key


def _limit_for(tier_col, unknown: int):
    return F.coalesce(F.element_at(R.lit_map(D.TIER_LIMITS), tier_col), F.lit(unknown))


def quota_admission(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    """The k-th request of a key in a calendar month is admitted iff k ≤ its tier
    limit; unknown keys are rejected (limit 0).  Rejected requests are not counted,
    so the admitted ones are exactly the first ``limit`` of the month."""
    acc = accounts.select(F.col("account_key").alias("client"), "tier")
    r = (requests.select("request_id", "client", "ts")
         .withColumn("month", F.date_trunc("month", F.col("ts")).cast("timestamp_ntz"))
         .join(acc, "client", "left")
         .withColumn("quota", _limit_for(F.col("tier"), 0)))
    return first_k_flags(r, ["client", "month"], [F.asc("ts"), F.asc("request_id")], "request_id", "quota")


def usage_report(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    """J12/A20 per account and month: used (admitted only), limit, remaining.
    Unknown keys never reach the report (inner join)."""
    per = (requests.withColumn("month", F.date_trunc("month", F.col("ts")).cast("timestamp_ntz"))
           .groupBy("client", "month").agg(F.count(F.lit(1)).alias("requests")))
    acc = accounts.select(F.col("account_key").alias("client"), "email", "tier")
    lim = _limit_for(F.coalesce(F.col("tier"), F.lit("free")), 10)
    j = per.join(acc, "client")
    return j.select("client", "email", "tier", "month", "requests",
                    F.least(F.col("requests"), lim).alias("used"), lim.alias("limit"),
                    (lim - F.least(F.col("requests"), lim)).alias("remaining"))


def tier_building_cap(checks: DataFrame, accounts: DataFrame, cap: int = D.FREE_TIER_BUILDINGS) -> DataFrame:
    """A free user's first ``cap`` distinct parcels (by first check) are scored;
    re-checks of those stay allowed; other tiers are unlimited."""
    first = (checks.groupBy("user", "bbl")
             .agg(F.min(F.struct("ts", "seq")).alias("_first"))
             .select("user", "bbl", F.col("_first.ts").alias("first_ts"), F.col("_first.seq").alias("first_seq")))
    top = top_n_per_key(first, ["user"], [F.asc("first_ts"), F.asc("first_seq"), F.asc("bbl")], cap,
                        rank_col="slot").select("user", "bbl", "slot")
    acc = accounts.select(F.col("account_key").alias("user"), "tier")
    j = (checks.join(acc, "user", "left").join(top, ["user", "bbl"], "left")
         .withColumn("tier", F.coalesce("tier", F.lit("free"))))
    return j.withColumn("allowed", (F.col("tier") != "free") | F.col("slot").isNotNull())


def tenant_property_limit(properties: DataFrame, limit: int = D.TENANT_PROPERTIES) -> DataFrame:
    """The first ``limit`` properties of a tenant (by id) are within its plan."""
    flagged = first_k_flags(properties.select("tenant_id", "property_id", F.lit(limit).alias("properties_limit")),
                            ["tenant_id"], [F.asc("property_id")], "property_id", "properties_limit", "within_limit")
    return flagged.drop("position")


def hit_rate(requests: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """A request is a cache hit when the same client asked the same endpoint
    within the TTL before it (in (ts, id) order); rate = hits / (hits + misses), 0.0
    when there are none.  The previous request comes from a time-bucketed as-of scan,
    plus an aggregate for requests sharing a timestamp — no per-key sort."""
    from parcelwise.operators.temporal import previous_distinct
    keys = ["client", "endpoint"]
    r = requests.select(*keys, "request_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("_e"))
    first = r.groupBy(*keys, "_e").agg(F.min("request_id").alias("_first"))
    prev = previous_distinct(r, keys, "_e", out="_prev")
    j = r.join(first, keys + ["_e"]).join(prev, keys + ["_e"])
    ttl = int(ttl_seconds) * 1_000_000
    hit = (F.col("request_id") != F.col("_first")) | F.coalesce(F.col("_e") - F.col("_prev") <= ttl, F.lit(False))
    agg = j.groupBy("endpoint").agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"))
    return agg.withColumn("hit_rate", F.coalesce(
        F.bround(F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")), 4), F.lit(0.0)))


def request_counters(requests: DataFrame) -> DataFrame:
    """Counts per (endpoint, status) label pair."""
    status = F.when(F.col("is_error"), "5xx").otherwise("2xx")
    return requests.groupBy("endpoint", status.alias("status")).agg(F.count(F.lit(1)).alias("requests"))
