"""Boundary tables and empty / null-key / duplicate-key inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from parcelwise.functions import rules as R
from parcelwise.operators import feed as FE
from parcelwise.operators import listing as L

PROPS = "property_id long, bbl string"
VIOL = "property_id long, violation_class string"
COMP = "property_id long, complaint_type string"


@pytest.mark.parametrize("temp,risk", [(54.9, 2.0), (55.0, 1.5), (61.9, 1.5), (62.0, 1.0), (None, 1.0)])
def test_temperature_bands(spark, temp, risk):
    df = spark.createDataFrame([(temp,)], "t double")
    assert df.select(R.temperature_risk("t")).first()[0] == risk


@pytest.mark.parametrize("n,risk", [(0, 1.0), (1, 1.5), (2, 1.5), (3, 2.0), (4, 2.0), (5, 3.0), (9, 3.0)])
def test_complaint_bands(spark, n, risk):
    df = spark.createDataFrame([(n,)], "n int")
    assert df.select(R.complaint_risk("n")).first()[0] == risk


def test_feed_with_empty_sides(spark):
    props = spark.createDataFrame([(1, "3000010001"), (2, "3000020001")], PROPS)
    v = spark.createDataFrame([(1, "B"), (1, "A")], VIOL)
    c_empty = spark.createDataFrame([], COMP)
    out = {r.bbl: r for r in FE.feed_scored(v, c_empty, props).collect()}
    assert out["3000010001"].total_violations == 2 and out["3000010001"].relevant_311_complaints == 0
    assert out["3000010001"].compliance_risk_score == 3.0
    v_empty = spark.createDataFrame([], VIOL)
    c = spark.createDataFrame([(2, "PLUMBING"), (2, "NOISE")], COMP)
    out = {r.bbl: r for r in FE.feed_scored(v_empty, c, props).collect()}
    assert out == {"3000020001": out["3000020001"]} and out["3000020001"].compliance_risk_score == 1.5
    assert FE.feed_scored(v_empty, c_empty, props).count() == 0


def test_null_and_blank_parcel_keys_are_dropped(spark):
    props = spark.createDataFrame([(1, None), (2, " "), (3, "3000030001")], PROPS)
    v = spark.createDataFrame([(1, "B"), (2, "B"), (3, "B")], VIOL)
    rows = FE.violations_agg(v, props).collect()
    assert [r.bbl for r in rows] == ["3000030001"]


def test_insert_if_absent_with_duplicate_keys(spark):
    existing = spark.createDataFrame([("t1", "3000010001", 5)], "tenant_id string, bbl string, units int")
    incoming = spark.createDataFrame([("t1", "3000010001", 7), ("t1", "3000020001", 3), ("t1", "3000020001", 4)],
                                     "tenant_id string, bbl string, units int")
    merged, rejected = L.insert_if_absent(existing, incoming, ["tenant_id", "bbl"])
    assert merged.count() == 2 and rejected.count() == 1
    assert merged.filter(F.col("bbl") == "3000010001").first().units == 5


def test_partial_update_applies_explicit_null(spark):
    existing = spark.createDataFrame([(1, 10, 1950), (2, 20, 1960)], "property_id long, units int, year_built int")
    changes = spark.createDataFrame([(1, None, False, None, True)],
                                    "property_id long, units int, units_set boolean, year_built int, year_built_set boolean")
    out = {r.property_id: r for r in L.partial_update(existing, changes, "property_id", ["units", "year_built"]).collect()}
    assert out[1].units == 10 and out[1].year_built is None and out[2].year_built == 1960


def test_delete_is_tenant_scoped(spark):
    existing = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], "tenant_id string, property_id long")
    dels = spark.createDataFrame([("a", 1), ("c", 2)], "tenant_id string, property_id long")
    assert sorted(tuple(r) for r in L.delete_by_key(existing, dels, ["tenant_id", "property_id"]).collect()) == \
        [("a", 2), ("b", 1)]


def test_hpd_feed_retries_without_class_filter(spark):
    v = spark.createDataFrame([("HPD", " x ", dt.date(2024, 1, 1))], "source string, violation_class string, issued_date date")
    assert FE.hpd_violations(v, "2024-01-31", 90).count() == 1
    v2 = spark.createDataFrame([("HPD", " b ", dt.date(2024, 1, 1)), ("HPD", "x", dt.date(2024, 1, 1))],
                               "source string, violation_class string, issued_date date")
    assert [r.violation_class for r in FE.hpd_violations(v2, "2024-01-31", 90).collect()] == ["B"]


def test_property_without_violations_is_clean(spark):
    from parcelwise.operators import aggs as A
    props = spark.createDataFrame([(1,), (2,)], "property_id long")
    v = spark.createDataFrame([(1, "B", False, None, None)],
                              "property_id long, violation_class string, is_resolved boolean, resolved_date date, issued_date date")
    got = {r.property_id: (r.total, r.risk_level) for r in A.property_risk_level(A.violation_summary(v), props).collect()}
    assert got == {1: (1, "LOW"), 2: (0, "CLEAN")}


def test_p95_is_exact_for_large_windows(spark):
    from parcelwise.streaming import jobs as J
    counts = spark.range(40_000).select(F.lit(0).alias("window_start"), (F.col("id") / 7).alias("latency"), F.lit(1).cast("long").alias("requests"))
    r = J.p95_latency(counts, 150.0).first()
    assert (r.requests, r.p95_latency, r.alert) == (40_000, 37_999 / 7, True)


def test_shared_folder_is_required_off_local_mode(spark, monkeypatch):
    from types import SimpleNamespace

    import pytest

    from parcelwise import session as S
    context = lambda master: SimpleNamespace(sparkContext=SimpleNamespace(
        master=master, getCheckpointDir=lambda: None, getConf=lambda: SimpleNamespace(get=lambda *a: None)))
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError):
            S.checkpoint_dir(context(master))
