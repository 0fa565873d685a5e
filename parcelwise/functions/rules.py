"""Scoring rules as native column expressions.

Each function takes Columns and returns a Column, so a rule applied to a whole
table stays inside whole-stage codegen (no Python UDF).  Lookups of the fixed
values in ``dims`` become literal ``map`` expressions.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelwise.functions import dims as D


def lit_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def lit_array(xs) -> Column:
    return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --------------------------------------------------------------------- era
def era_key(year, max_year: int = D.MAX_VALID_YEAR) -> Column:
    """'unknown' | 'modern' | 'elevated' | 'critical' with the validity range."""
    y = _c(year)
    return (F.when(y.isNull() | (y < D.MIN_VALID_YEAR) | (y > max_year), "unknown")
            .when(y >= D.ELEVATED_YEAR, "modern")
            .when(y >= D.CRITICAL_YEAR, "elevated")
            .otherwise("critical"))


def era_multiplier(year, max_year: int = D.MAX_VALID_YEAR) -> Column:
    k = era_key(year, max_year)
    return (F.when(k == "critical", D.ERA_MULT_CRITICAL)
            .when(k == "elevated", D.ERA_MULT_ELEVATED)
            .otherwise(D.ERA_MULT_BASELINE))


def era_explanation(year, max_year: int = D.MAX_VALID_YEAR) -> Column:
    return F.element_at(lit_map(D.ERA_EXPLANATION), era_key(year, max_year))


def is_pre1974(year, max_year: int = D.MAX_VALID_YEAR) -> Column:
    return era_key(year, max_year).isin("elevated", "critical")


def portfolio_era_multiplier(year) -> Column:
    """Portfolio variant: no validity range; null/0 counts as modern."""
    y = _c(year)
    truthy = y.isNotNull() & (y != 0)
    return (F.when(truthy & (y < D.CRITICAL_YEAR), D.ERA_MULT_CRITICAL)
            .when(truthy & (y < D.ELEVATED_YEAR), D.ERA_MULT_ELEVATED)
            .otherwise(D.ERA_MULT_BASELINE))


def era_class_multiplier(year, violation_class) -> Column:
    y, c = _c(year), _c(violation_class)
    pre = is_pre1974(y)
    return (F.when(pre & (c == "C"), D.ERA_CLASS_MULT["C"])
            .when(pre & (c == "B"), D.ERA_CLASS_MULT["B"])
            .when(pre, D.ERA_CLASS_MULT_OTHER)
            .otherwise(D.ERA_MULT_BASELINE))


# ------------------------------------------------------------- inspectors
def borough_from_bbl(bbl) -> Column:
    b = _c(bbl)
    name = F.element_at(lit_map(D.BOROUGH_CODES), F.substring(b, 1, 1))
    return F.when(b.isNotNull() & (F.length(b) == 10), F.coalesce(name, F.lit("unknown"))).otherwise("unknown")


def district_multiplier(district) -> Column:
    """Hotspot value of a district (lower-cased), null if not a hotspot."""
    return F.element_at(lit_map(D.INSPECTOR_HOTSPOTS), F.lower(_c(district)))


def borough_baseline(borough) -> Column:
    return F.coalesce(F.element_at(lit_map(D.BOROUGH_BASELINES), F.lower(_c(borough))), F.lit(1.0))


def inspector_multiplier(bbl, district) -> Column:
    return F.coalesce(district_multiplier(district),
                      F.element_at(lit_map(D.BOROUGH_BASELINES), borough_from_bbl(bbl)),
                      F.lit(1.0))


def hotspot_level(mult) -> Column:
    m = _c(mult)
    return F.when(m >= 2.0, "CRITICAL").when(m >= 1.5, "ELEVATED").otherwise("STANDARD")


# ------------------------------------------------------------ heat season
def is_heat_season(d) -> Column:
    m = F.month(_c(d))
    return (m >= 10) | (m <= 5)


def _peak(d) -> Column:
    m, day = F.month(_c(d)), F.dayofmonth(_c(d))
    return ((m == 1) & (day >= 15)) | (m == 2) | ((m == 3) & (day <= 15))


def seasonal_multiplier(d) -> Column:
    m, day = F.month(_c(d)), F.dayofmonth(_c(d))
    high = (m == 12) | ((m == 4) & (day <= 15)) | (m == 11) | ((m == 10) & (day >= 15))
    return (F.when(_peak(d), 2.0).when(high, 1.5)
            .when(is_heat_season(d), 1.2).otherwise(1.0))


def seasonal_note(d) -> Column:
    m, day = F.month(_c(d)), F.dayofmonth(_c(d))
    active = (m == 12) | (m == 11) | ((m == 4) & (day <= 15))
    n = D.SEASON_NOTES
    return (F.when(_peak(d), n["peak"]).when(active, n["active"])
            .when(is_heat_season(d), n["season"]).otherwise(n["off"]))


def temperature_risk(temp) -> Column:
    t = _c(temp)
    return F.when(t.isNull(), 1.0).when(t < 55, 2.0).when(t < 62, 1.5).otherwise(1.0)


def complaint_risk(n) -> Column:
    c = _c(n)
    return F.when(c >= 5, 3.0).when(c >= 3, 2.0).when(c >= 1, 1.5).otherwise(1.0)


def heat_raw_multiplier(n_complaints, temp, d) -> Column:
    return seasonal_multiplier(d) * temperature_risk(temp) * complaint_risk(n_complaints)


def heat_urgency(raw) -> Column:
    r = _c(raw)
    return (F.when(r >= 4.0, "CRITICAL").when(r >= 2.5, "HIGH")
            .when(r >= 1.5, "MODERATE").otherwise("LOW"))


def heat_urgency_field(urgency, i: int) -> Column:
    return F.element_at(lit_map({k: v[i] for k, v in D.HEAT_URGENCY.items()}), _c(urgency))


# ---------------------------------------------------------------- winter
def age_factor(year) -> Column:
    y = _c(year)
    truthy = y.isNotNull() & (y != 0)
    return F.when(truthy & (y < D.CRITICAL_YEAR), 1.8).when(truthy & (y < D.ELEVATED_YEAR), 1.4).otherwise(1.0)


def service_factor(last_service, as_of) -> Column:
    """Days since service are whole elapsed days (floor of seconds / 86400)."""
    ls = _c(last_service)
    days = F.floor((F.unix_timestamp(_c(as_of).cast("timestamp")) - F.unix_timestamp(ls.cast("timestamp"))) / 86400)
    return F.when(ls.isNull(), 1.5).when(days > 365, 1.6).when(days > 180, 1.3).otherwise(1.0)


def winter_level(combined) -> Column:
    c = _c(combined)
    return (F.when(c >= 6.0, "CRITICAL").when(c >= 4.0, "HIGH")
            .when(c >= 2.0, "MODERATE").otherwise("LOW"))


def winter_recommendations(combined, year) -> Column:
    lvl = winter_level(combined)
    y = _c(year)
    base = F.coalesce(F.element_at(F.create_map(*chain.from_iterable(
        (F.lit(k), lit_array(v)) for k, v in D.WINTER_RECOMMENDATIONS.items())), lvl),
        F.array().cast("array<string>"))
    extra = F.when(y.isNotNull() & (y != 0) & (y < D.CRITICAL_YEAR),
                   F.array(F.lit(D.WINTER_PRE1960_RECOMMENDATION))).otherwise(F.array().cast("array<string>"))
    return F.concat(base, extra)


# ------------------------------------------------------ violation classes
def classify_category(category) -> Column:
    """Keyword classifier over the whole upper-cased text."""
    u = F.upper(F.coalesce(_c(category).cast("string"), F.lit("")))
    any_of = lambda kws: F.exists(lit_array(kws), lambda k: F.instr(u, k) > 0)
    return (F.when(any_of(D.CLASS_C_KEYWORDS), "Class C")
            .when(any_of(D.CLASS_B_KEYWORDS), "Class B")
            .otherwise("Class A"))


def risk_level(n_class_c, n_class_b, n_open, n_total) -> Column:
    return (F.when(_c(n_class_c) > 0, "CRITICAL").when(_c(n_class_b) > 2, "HIGH")
            .when(_c(n_open) > 5, "MEDIUM").when(_c(n_total) > 0, "LOW").otherwise("CLEAN"))


def compliance_score(class_b, complaints, total) -> Column:
    return F.bround(_c(class_b) * 2.0 + _c(complaints) * 1.5 + _c(total) * 0.5, 2)


def risk_band(score01) -> Column:
    s = _c(score01)
    return F.when(s >= 0.8, "CRITICAL").when(s >= 0.6, "HIGH").when(s >= 0.4, "MEDIUM").otherwise("LOW")


def fine_for_class(violation_class) -> Column:
    return F.coalesce(F.element_at(lit_map(D.FINE_BY_CLASS), _c(violation_class)), F.lit(0))


def peer_urgency(pct) -> Column:
    p = _c(pct)
    return (F.when(p >= 90, "CRITICAL").when(p >= 75, "HIGH").when(p >= 50, "MODERATE").otherwise("LOW"))


def clean_bbl(raw) -> Column:
    return F.regexp_replace(F.trim(_c(raw)), r"[-\s]", "")


def valid_bbl(bbl) -> Column:
    return F.coalesce(_c(bbl).rlike(r"^[1-5][0-9]{9}$"), F.lit(False))
