"""Physical-plan guards: what the plans must (not) contain, checked with explain."""

import contextlib
import io
import re

import pytest

from parcelwise.plans.registry import QUERIES, load_all

from conftest import SMALL

load_all()

BATCH = sorted(n for n in QUERIES if not n.startswith(("stream_", "rate_limit_sliding", "rate_limit_token_bucket"))
               or n.endswith("_batch"))


def formatted(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", BATCH)
def test_no_cartesian_or_nested_loop(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def _scans(name, spark):
    txt = formatted(QUERIES[name](spark, SMALL))
    return re.findall(r"ReadSchema: (struct<[^\n]*>)", txt), re.findall(r"PushedFilters: (\[[^\n]*\])", txt)


def test_feed_scan_reads_only_needed_columns(spark):
    schemas, pushed = _scans("feed_scored", spark)
    lineitem = [set(re.findall(r"(l_\w+):", s)) for s in schemas if "l_partkey" in s]
    assert lineitem and all(s == {"l_partkey", "l_returnflag", "l_suppkey", "l_shipdate"} for s in lineitem)
    assert any("GreaterThanOrEqual(l_shipdate," in p for p in pushed)


def test_label_and_time_filters_reach_the_scan(spark):
    _, pushed = _scans("complaints_lookback", spark)
    assert any("EqualTo(event_type,error)" in p and "GreaterThanOrEqual(ts," in p for p in pushed)
    _, pushed = _scans("tenant_scope", spark)
    assert any("EqualTo(p_brand,Brand#23)" in p for p in pushed)
    _, pushed = _scans("src_dataset_slice", spark)
    assert any("GreaterThanOrEqual(l_shipdate," in p for p in pushed)


@pytest.mark.parametrize("name", ["per_property_latest_n", "src_dob_violations", "outreach_top5", "queue_last_100"])
def test_top_n_cuts_each_map_task_before_the_shuffle(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit .*Partial", plan) and re.search(r"WindowGroupLimit .*Final", plan)


@pytest.mark.parametrize("name", ["violation_stats", "high_risk_properties", "property_lookup"])
def test_raw_rows_are_aggregated_before_the_join(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    join = re.search(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin)", plan).start()
    assert "HashAggregate" in plan[join:]
