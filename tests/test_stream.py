"""Batch = stream: the streaming jobs replayed from the landed files agree with
their batch twins."""

from pyspark.sql import functions as F
from pyspark.sql import Window

from parcelwise.plans.registry import QUERIES, load_all

from conftest import MEDIUM

load_all()


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_limiters_stream_equals_batch(spark):
    cols = ["client", "request_id", "admitted"]
    for name in ("rate_limit_sliding", "rate_limit_token_bucket"):
        s = QUERIES[name](spark, MEDIUM)
        b = QUERIES[f"{name}_batch"](spark, MEDIUM)
        assert _rows(s, cols) == _rows(b, cols)
        assert s.filter(~F.col("admitted")).count() > 0          # the policy does reject


def test_stream_conversion_is_batch_on_decided_rows(spark):
    s = QUERIES["stream_complaint_conversion"](spark, MEDIUM)
    b = QUERIES["complaint_conversion"](spark, MEDIUM)
    keys = s.select("unique_key")
    cols = ["unique_key", "converted", "first_violation"]
    assert _rows(s, cols) == _rows(b.join(keys, "unique_key", "left_semi"), cols)


def test_rescore_stream_equals_batch_feed(spark):
    cols = ["bbl", "total_violations", "class_b_violations", "relevant_311_complaints", "compliance_risk_score"]
    assert _rows(QUERIES["stream_rescore"](spark, MEDIUM), cols) == _rows(QUERIES["feed_scored"](spark, MEDIUM), cols)


def test_heat_alert_stream_equals_batch_windows(spark):
    from parcelwise.sources.tables import Tables
    heat = (Tables(spark, MEDIUM).views.complaints().filter(F.col("complaint_type") == "HEAT/HOT WATER")
            .withColumn("t", F.col("created").cast("timestamp")))
    wm = heat.agg(F.max("t")).first()[0]
    batch = (heat.groupBy("property_id", F.window("t", "30 days", "1 day")).agg(F.count(F.lit(1)).alias("complaints"))
             .filter((F.col("complaints") >= 3) & (F.col("window.end") <= F.lit(wm) - F.expr("INTERVAL 1 DAY")))
             .select("property_id", F.col("window.start").cast("timestamp_ntz").alias("window_start"), "complaints"))
    cols = ["property_id", "window_start", "complaints"]
    assert _rows(QUERIES["stream_heat_alerts"](spark, MEDIUM), cols) == _rows(batch, cols)


def test_new_violations_over_shuffled_micro_batches(spark, tmp_path):
    """Five files in reverse time order with repeats across files, one file per micro-batch: each key once."""
    from parcelwise.sources.tables import Tables
    from parcelwise.streaming import jobs as J
    v = Tables(spark, MEDIUM).views.violations()
    parts = v.withColumn("_p", F.ntile(5).over(Window.orderBy(F.desc("issued_date"), "order_key", "line_no"))).persist()
    path = str(tmp_path / "landed")
    for p in (4, 1, 5, 2, 3):
        parts.filter((F.col("_p") == p) | (F.col("_p") == p % 5 + 1)).drop("_p").coalesce(1).write.mode("append").parquet(path)
    parts.unpersist()
    stream = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = spark.read.parquet(J.run_available_now(spark, J.new_violations(stream), "new-violations-test"))
    want = v.select("source", "order_key", "line_no").distinct()
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def _shuffled_files(df, order, path, parts=5):
    """``parts`` files cut by time and landed out of order."""
    cut = df.withColumn("_p", F.ntile(parts).over(Window.orderBy(*order))).persist()
    for p in (4, 1, 5, 2, 3):
        cut.filter(F.col("_p") == p).drop("_p").coalesce(1).write.mode("append").parquet(path)
    cut.unpersist()
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_limiters_over_shuffled_micro_batches(spark, tmp_path):
    from parcelwise.operators import limiters as LIM
    from parcelwise.sources.tables import Tables
    from parcelwise.streaming import jobs as J
    r = Tables(spark, MEDIUM).views.requests().select("client", "request_id", "ts")
    stream = _shuffled_files(r, ["ts", "request_id"], str(tmp_path / "landed"))
    month = 40 * 86_400
    for kind, want, params in [("sliding", LIM.rate_limit_sliding(r, 2, 43_200), {"max_messages": 2, "window_seconds": 43_200}),
                               ("bucket", LIM.rate_limit_token_bucket(r, 2, 43_200.0), {"rate": 2, "per": 43_200.0})]:
        sink = spark.read.parquet(J.run_available_now(spark, J.limiter_stream(stream, kind, month, **params), f"{kind}-shuffled"))
        cols = ["client", "request_id", "ts", "admitted"]
        assert _rows(LIM.latest(sink), cols) == _rows(want, cols) and not sink.filter("late").count()
    late = spark.read.parquet(J.run_available_now(spark, J.limiter_stream(stream, "sliding", 1, max_messages=2, window_seconds=43_200), "late"))
    assert late.filter("late").count() > 0 and LIM.latest(late).count() == r.count()       # counted, none lost


def test_conversion_over_shuffled_micro_batches(spark, tmp_path):
    from parcelwise.sources.tables import Tables
    from parcelwise.streaming import jobs as J
    v = Tables(spark, MEDIUM).views
    c = _shuffled_files(v.complaints(), ["created", "unique_key"], str(tmp_path / "c"))
    e = _shuffled_files(v.class_c_events(), [F.desc("issued"), "violation_key"], str(tmp_path / "v"))
    got = J.conversion_result(spark.read.parquet(J.run_available_now(spark, J.stream_conversion_state(c, e, 14, 40 * 86_400), "conversion-shuffled")))
    want = QUERIES["complaint_conversion"](spark, MEDIUM).filter("converted")
    cols = ["unique_key", "converted", "first_violation"]
    assert want.count() > 0 and _rows(got.filter("converted"), cols) == _rows(want, cols)
