"""Rule expressions against the product's own test vectors and boundary tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from parcelwise.functions import rules as R
from parcelwise.operators import aggs as A


def one(spark, expr, schema="x int", value=None):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("year,mult,pre", [
    (None, 1.0, False), (1799, 1.0, False), (1800, 3.8, True), (1950, 3.8, True), (1959, 3.8, True),
    (1960, 2.5, True), (1973, 2.5, True), (1974, 1.0, False), (1990, 1.0, False), (2025, 1.0, False),
    (2026, 1.0, False)])
def test_era_multiplier_boundaries(spark, year, mult, pre):
    df = spark.createDataFrame([(year,)], "y int")
    r = df.select(R.era_multiplier("y").alias("m"), R.is_pre1974("y").alias("p"), R.era_explanation("y").alias("e")).first()
    assert r["m"] == mult and r["p"] == pre
    if year is None or year < 1800 or year > 2025:
        assert r["e"] == "Unknown construction year (baseline risk)"


def _portfolio(spark, years):
    df = spark.createDataFrame([("t", y) for y in years], "tenant_id string, year_built int")
    return A.portfolio_era_stats(df).first()


def test_portfolio_era_vectors(spark):
    r = _portfolio(spark, [2000, 1965, 1950, 1980])
    assert (r.pre1974_count, r.pre1960_count, r.pre1974_percentage) == (2, 1, 50.0)
    assert r.average_multiplier == 2.08 and r.portfolio_risk_level == "CRITICAL"
    r = _portfolio(spark, [1945, 1950, 1955])
    assert r.average_multiplier == 3.8 and r.portfolio_risk_level == "CRITICAL" and r.pre1974_percentage == 100.0
    r = _portfolio(spark, [1985, 1990, 2005])
    assert r.average_multiplier == 1.0 and r.portfolio_risk_level == "STANDARD"
    r = _portfolio(spark, [None, 1990])          # missing year counts as 1.0
    assert r.average_multiplier == 1.0


def test_portfolio_fixture_counts(spark):
    # (bbl, year_built, units) portfolio of five buildings, three before 1974.
    years = [1950, 1968, 1985, 1955, 2005]
    r = _portfolio(spark, years)
    assert r.total_buildings == 5 and r.pre1974_count == 3


@pytest.mark.parametrize("bbl,district,expected", [
    ("3012650001", "brooklyn_council_36", 2.3), ("1012650001", "bronx_council_15", 2.2),
    ("3012650001", None, 1.2), ("1012650001", None, 1.3), ("4012650001", None, 1.1), ("5012650001", None, 0.9),
    ("2012650001", None, 1.4), ("123", None, 1.0), ("", None, 1.0), (None, None, 1.0),
    ("3012650001", "BROOKLYN_COUNCIL_36", 2.3), ("3012650001", "queens_council_99", 1.2)])
def test_inspector_multiplier(spark, bbl, district, expected):
    df = spark.createDataFrame([(bbl, district)], "b string, d string")
    assert df.select(R.inspector_multiplier("b", "d")).first()[0] == expected


@pytest.mark.parametrize("day,season", [
    ("2024-10-01", True), ("2024-05-31", True), ("2024-06-01", False), ("2024-09-30", False)])
def test_heat_season_edges(spark, day, season):
    df = spark.createDataFrame([(dt.date.fromisoformat(day),)], "d date")
    assert df.select(R.is_heat_season("d")).first()[0] is season


@pytest.mark.parametrize("day,mult", [
    ("2024-01-14", 1.2), ("2024-01-15", 2.0), ("2024-03-15", 2.0), ("2024-03-16", 1.2), ("2024-04-15", 1.5),
    ("2024-04-16", 1.2), ("2024-10-14", 1.2), ("2024-10-15", 1.5), ("2024-11-01", 1.5), ("2024-12-31", 1.5),
    ("2024-07-01", 1.0)])
def test_seasonal_multiplier(spark, day, mult):
    df = spark.createDataFrame([(dt.date.fromisoformat(day),)], "d date")
    assert df.select(R.seasonal_multiplier("d")).first()[0] == mult


def test_seasonal_note_late_october_is_not_active(spark):
    df = spark.createDataFrame([(dt.date(2024, 10, 20),)], "d date")
    assert df.select(R.seasonal_note("d")).first()[0].startswith("Heat season")


@pytest.mark.parametrize("n,temp,day,raw,urgency", [
    (5, 50.0, "2024-02-01", 12.0, "CRITICAL"), (1, 75.0, "2024-07-01", 1.5, "MODERATE"),
    (5, 55.0, "2024-02-01", 9.0, "CRITICAL"), (0, None, "2024-07-01", 1.0, "LOW"),
    (3, 61.9, "2024-07-01", 3.0, "HIGH"), (2, 62.0, "2024-07-01", 1.5, "MODERATE")])
def test_heat_forecast_vectors(spark, n, temp, day, raw, urgency):
    df = spark.createDataFrame([(n, temp, dt.date.fromisoformat(day))], "n int, t double, d date")
    m = R.heat_raw_multiplier("n", "t", "d")
    r = df.select(m.alias("m"), R.heat_urgency(m).alias("u")).first()
    assert r.m == raw and r.u == urgency


def test_integrated_worst_and_best(spark):
    df = spark.createDataFrame([(1950, "3012650001", "brooklyn_council_36", 5, 50.0, dt.date(2024, 2, 1)),
                                (1990, "5012650001", None, 0, 70.0, dt.date(2024, 7, 1))],
                               "y int, b string, d string, n int, t double, day date")
    heat = F.bround(R.heat_raw_multiplier("n", "t", "day"), 1)
    r = df.select(F.bround(R.era_multiplier("y") * R.inspector_multiplier("b", "d") * heat, 4).alias("x")).collect()
    assert r[0].x == 104.88 and r[1].x == 0.9


def test_half_even_rounding(spark):
    assert one(spark, F.bround(F.lit(2.25), 1)) == 2.2


def test_compliance_score_sample_row(spark):
    assert one(spark, R.compliance_score(F.lit(15), F.lit(320), F.lit(34))) == 527.0


@pytest.mark.parametrize("cat,cls", [
    ("IMMEDIATELY HAZARDOUS", "Class C"), ("structural collapse", "Class C"), ("NON-HAZARDOUS", "Class B"),
    ("Electrical wiring", "Class B"), ("paperwork", "Class A"), (None, "Class A"), ("", "Class A")])
def test_classifier(spark, cat, cls):
    df = spark.createDataFrame([(cat,)], "c string")
    assert df.select(R.classify_category("c")).first()[0] == cls


@pytest.mark.parametrize("c,b,o,t,level", [
    (1, 0, 0, 1, "CRITICAL"), (0, 3, 0, 3, "HIGH"), (0, 2, 6, 8, "MEDIUM"), (0, 1, 1, 2, "LOW"), (0, 0, 0, 0, "CLEAN")])
def test_risk_level(spark, c, b, o, t, level):
    df = spark.createDataFrame([(c, b, o, t)], "c int, b int, o int, t int")
    assert df.select(R.risk_level("c", "b", "o", "t")).first()[0] == level


@pytest.mark.parametrize("raw,ok", [
    ("3-01265-0001", True), (" 3012650001 ", True), ("6012650001", False), ("301265000", False), (None, False)])
def test_bbl_quality(spark, raw, ok):
    df = spark.createDataFrame([(raw,)], "r string")
    assert df.select(R.valid_bbl(R.clean_bbl(F.col("r")))).first()[0] is ok


def test_winter_recommendations(spark):
    df = spark.createDataFrame([(12.0, 1950), (1.0, 1990)], "c double, y int")
    rec = df.select(R.winter_recommendations("c", "y").alias("r")).collect()
    assert len(rec[0].r) == 5 and rec[0].r[-1].startswith("Consider HVAC")
    assert rec[1].r == []
