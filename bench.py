"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
    (optional: BENCH_QUERIES=a,b  BENCH_SHUFFLE_PARTITIONS=n  BENCH_EVENT_LOG=<scratch dir>)

Each query is run once to warm up and then three times; the median wall time
of a full evaluation (``noop`` sink: every row computed, nothing collected) is
reported.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from parcelwise.plans.registry import QUERIES, load_all  # noqa: E402
from parcelwise.session import get_spark  # noqa: E402

HEADLINE = [
    "feed_scored",             # agg → full outer join → score (flagship feed)
    "integrated_risk",         # era × inspector × heat per property
    "violation_summary",       # per-property conditional aggregates
    "dashboard_metrics",       # all-tenant dashboard
    "per_property_latest_n",   # two-phase top-N per key
    "dedup_violations",        # max(struct) dedup
    "quota_admission",         # first-k admission per (key, month)
    "cohort_percentile",       # histogram strict percentile
    "peer_benchmark",          # cell-level peer join, exact median
    "portfolio_peer_ranking",  # market percentile via cent histogram
    "complaint_conversion",    # 14-day forward as-of scan
    "heat_complaints_30d",     # trailing count split by time bucket
    "rate_limit_sliding_batch",  # sequential fold per idle-gap segment
    "violation_trend_30d",     # date spine + running sum
    "stream_heat_alerts",      # watermarked sliding window stream
    "peer_topn",               # k nearest peers by ranked cells
    "stream_fanout",           # updates × subscribers
    "queue_last_100",          # newest 100 a connection
    "property_bundle",         # four feeds' records per parcel
    "src_dob_violations",      # newest 50 per parcel
    "stream_conversion_join",  # stream-stream interval join
    "stream_rescore",          # incremental re-scoring by buckets
    "p95_latency_5m",          # sketched p95 with an exact pass
    "connection_subscriptions",  # connection state machine
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(2 * cpus)))
    extra = {"spark.driver.memory": "16g"}
    if os.environ.get("BENCH_EVENT_LOG"):      # stage/task times without the UI: a scratch folder
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": os.environ["BENCH_EVENT_LOG"]})
    spark = get_spark(f"local[{cpus}]", app="parcelwise-bench", shuffle_partitions=parts, extra=extra)
    load_all()
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    # Process warm-up (JIT of the common operators), so the first timed query does not
    # carry the JVM's start-up; not timed.
    for _ in range(3):
        for name in HEADLINE[:2]:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.catalog.clearCache()
    results = {}
    for name in names:
        fn = QUERIES[name]
        times = []
        for i in range(4):
            t = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                times.append(time.perf_counter() - t)
            spark.catalog.clearCache()   # each run starts without the previous run's persisted data
        results[name] = round(statistics.median(times), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "sum_median_query_sec", "value": round(sum(results.values()), 3), "unit": "sec",
                      "queries": results, "sf": sf, "cpus": cpus,
                      "settings": {"spark.sql.shuffle.partitions": parts, "aqe": True}}))
    spark.stop()


if __name__ == "__main__":
    main()
