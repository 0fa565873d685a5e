"""Table-to-table scoring jobs.

Every rule is a native column expression from ``functions.rules``; the only
shuffles are the per-property aggregates of violations/complaints, which are
partially aggregated map-side before the exchange and then joined to the
property table on its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import dims as D
from parcelwise.functions import rules as R
from parcelwise.operators.windows import spread_join


def _as_ts(as_of: str):
    return F.lit(as_of).cast("timestamp_ntz")


def _as_date(as_of: str):
    return F.lit(as_of).cast("date")


def complaint_counts(complaints: DataFrame, as_of: str, days: int,
                     types=("HEAT/HOT WATER",), name: str = "heat_complaints") -> DataFrame:
    """S6 lookback + A1: complaints per property with created >= as_of - days (no upper bound)."""
    return (complaints
            .filter(F.col("complaint_type").isin(*types)
                    & (F.col("created") >= _as_ts(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")))
            .groupBy("property_id").agg(F.count(F.lit(1)).alias(name)))


def era_scores(properties: DataFrame, max_year: int = D.MAX_VALID_YEAR) -> DataFrame:
    y = F.col("year_built")
    return properties.select(
        "property_id", "year_built",
        R.era_multiplier(y, max_year).alias("era_multiplier"),
        R.era_explanation(y, max_year).alias("era_explanation"),
        R.is_pre1974(y, max_year).alias("is_pre1974"))


def _era_detail(year: Column) -> dict[str, Column]:
    k = R.era_key(year)
    det = D.ERA_DETAIL
    pick = lambda i: F.element_at(R.lit_map({e: v[i] for e, v in det.items()}), k)
    arrays = lambda i: F.element_at(F.create_map(*[x for e, v in det.items()
                                                   for x in (F.lit(e), R.lit_array(v[i]))]), k)
    return {"multiplier": R.era_multiplier(year), "era": pick(0), "explanation": pick(1),
            "risk_factors": arrays(2), "action_items": arrays(3)}


def era_detail(properties: DataFrame) -> DataFrame:
    """R2 as literal map lookups keyed by era (no join)."""
    return properties.select("property_id", "year_built", *[c.alias(n) for n, c in _era_detail(F.col("year_built")).items()])


def property_report(properties: DataFrame, as_of: str) -> DataFrame:
    """The report of a single property, for every building; the era part only with a known year."""
    # Only the year is looked up, by a sort-merge join; the texts of an era are made on the row and never broadcast.
    years = properties.filter(F.col("year_built") != 0).select("property_id", F.col("year_built").alias("_year"))
    p = properties.join(years.hint("merge"), "property_id", "left")
    p = p.withColumns({n: F.when(F.col("_year").isNotNull(), c) for n, c in _era_detail(F.col("_year")).items()})
    rule = F.lit("-" * 70)

    def field(label: str, column: str, missing: str) -> Column:
        return F.concat(F.lit(f"{label}: "), F.coalesce(F.col(column).cast("string"), F.lit(missing)))

    def bullets(head: str, column: str) -> Column:
        lines = F.transform(column, lambda x: F.concat(F.lit("  • "), x))
        return F.when(F.size(column) > 0, F.concat_ws("\n", F.lit(head), lines, F.lit("")))

    era = F.when(F.col("era").isNotNull(), F.concat_ws(
        "\n", F.lit("BUILDING ERA RISK ANALYSIS"), rule, field("Era", "era", ""),
        F.concat(F.lit("Risk Multiplier: "), F.col("multiplier").cast("string"), F.lit("x")),
        field("Explanation", "explanation", ""), F.lit(""), bullets("Risk Factors:", "risk_factors"),
        bullets("Recommended Actions:", "action_items")))
    return p.select("property_id", F.concat_ws(
        "\n", F.lit("PROPERTY RISK ASSESSMENT"), F.lit(""), F.lit("PROPERTY INFORMATION"), rule,
        field("Address", "address", "Unknown"), field("BBL", "bbl", "N/A"), field("Units", "units", "N/A"),
        field("Year Built", "year_built", "Unknown"), field("Borough", "borough", "Unknown"), F.lit(""), era, F.lit(""),
        F.concat(F.lit("Date: "), F.date_format(F.lit(as_of).cast("date"), "MMMM dd, yyyy"))).alias("report"))


def inspector_scores(properties: DataFrame) -> DataFrame:
    m = R.inspector_multiplier("bbl", "council_district")
    return properties.select("property_id", "bbl", "council_district",
                             R.borough_from_bbl("bbl").alias("borough"),
                             m.alias("inspector_multiplier"),
                             (m > 1.4).alias("is_hotspot"))


def district_hotspots(properties: DataFrame) -> DataFrame:
    """R6 for every district that occurs in the property table."""
    per = (properties.filter(F.col("council_district").isNotNull())
           .groupBy("council_district").agg(F.count(F.lit(1)).alias("properties")))
    m = F.coalesce(R.district_multiplier("council_district"), F.lit(1.0))
    lvl = R.hotspot_level(m)
    return per.select(
        "council_district", "properties", m.alias("multiplier"), lvl.alias("risk_level"),
        F.element_at(R.lit_map(D.HOTSPOT_DESCRIPTION), lvl).alias("description"),
        (m > 1.0).alias("is_hotspot"),
        F.element_at(F.create_map(*[x for k, v in D.HOTSPOT_ACTIONS.items()
                                    for x in (F.lit(k), R.lit_array(v))]), lvl).alias("action_items"))


def heat_calendar(dates: DataFrame, col: str = "day") -> DataFrame:
    d = F.col(col)
    return dates.select(d.alias("day"), R.is_heat_season(d).alias("is_heat_season"),
                        R.seasonal_multiplier(d).alias("seasonal_multiplier"),
                        R.seasonal_note(d).alias("seasonal_note"))


def heat_forecast(properties: DataFrame, complaints: DataFrame, as_of: str,
                  avg_temp: float | None = 50.0, days: int = 30) -> DataFrame:
    """R9 per property; bands use the unrounded product, output is rounded half-even."""
    n = complaint_counts(complaints, as_of, days)
    base = properties.select("property_id", "bbl", "council_district", "year_built").join(n, "property_id", "left")
    cnt = F.coalesce(F.col("heat_complaints"), F.lit(0)).cast("long")
    temp = F.lit(avg_temp).cast("double")
    raw = R.heat_raw_multiplier(cnt, temp, _as_date(as_of))
    urg = R.heat_urgency(raw)
    return base.select(
        "property_id", "bbl", "council_district", "year_built",
        cnt.alias("heat_complaints_30d"),
        temp.alias("temperature"),
        F.bround(raw, 1).alias("risk_multiplier"),
        urg.alias("urgency"),
        R.heat_urgency_field(urg, 0).alias("days_to_violation"),
        R.heat_urgency_field(urg, 1).alias("fine_range"),
        R.heat_urgency_field(urg, 2).alias("action"),
        R.is_heat_season(_as_date(as_of)).alias("is_heat_season"),
        R.seasonal_note(_as_date(as_of)).alias("seasonal_note"))


def heat_forecast_scenarios(properties: DataFrame, complaints: DataFrame, scenarios: list[tuple[str, float | None]],
                            days: int = 30) -> DataFrame:
    """R9 and R8 for several (date, average temperature) scenarios in one pass: a property's complaints are counted for
    all dates at once, then each scenario is a row."""
    dates = sorted({as_of for as_of, _ in scenarios})
    since = lambda as_of: F.col("created") >= _as_ts(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    counts = complaints.filter((F.col("complaint_type") == "HEAT/HOT WATER") & since(dates[0])).groupBy("property_id") \
        .agg(F.array(*[F.count_if(since(as_of)) for as_of in dates]).alias("_counts"))
    rows = F.array(*[F.struct(_as_date(as_of).alias("as_of"), F.lit(temp).cast("double").alias("temperature"),
                              F.lit(dates.index(as_of)).alias("_at")) for as_of, temp in scenarios])
    base = properties.select("property_id", "year_built").join(counts, "property_id", "left") \
        .select("property_id", "year_built", "_counts", F.inline(rows))
    base = base.withColumn("heat_complaints_30d", F.coalesce(F.get("_counts", F.col("_at")), F.lit(0)).cast("long"))
    raw = R.heat_raw_multiplier(F.col("heat_complaints_30d"), F.col("temperature"), F.col("as_of"))
    urg = R.heat_urgency(raw)
    return base.select("property_id", "as_of", "temperature", "heat_complaints_30d", F.bround(raw, 1).alias("risk_multiplier"), urg.alias("urgency"),
                       R.heat_urgency_field(urg, 0).alias("days_to_violation"), R.heat_urgency_field(urg, 1).alias("fine_range"),
                       R.heat_urgency_field(urg, 2).alias("action"), R.is_heat_season("as_of").alias("is_heat_season"),
                       R.seasonal_note("as_of").alias("seasonal_note"))


def winter_risk(forecast: DataFrame, violations: DataFrame, service_as_of: str) -> DataFrame:
    """Rounded forecast × age factor × service factor.

    The last HVAC service of a property is its latest resolved violation
    (violation-table clock ``service_as_of``)."""
    svc = (violations.filter(F.col("resolved_date").isNotNull())
           .groupBy("property_id").agg(F.max("resolved_date").alias("last_service")))
    f = forecast.join(svc, "property_id", "left")
    age = R.age_factor("year_built")
    service = R.service_factor("last_service", _as_date(service_as_of))
    combined = F.col("risk_multiplier") * age * service
    return f.select(
        "property_id", "year_built", "risk_multiplier", "last_service",
        F.bround(age, 1).alias("age_factor"), F.bround(service, 1).alias("service_factor"),
        F.bround(combined, 1).alias("combined_multiplier"),
        R.winter_level(combined).alias("overall_risk"),
        R.winter_recommendations(combined, F.col("year_built")).alias("recommendations"))


def integrated_risk(properties: DataFrame, complaints: DataFrame, as_of: str,
                    avg_temp: float | None = 50.0) -> DataFrame:
    """Era × inspector × heat (the heat factor as reported, 1 dp)."""
    f = heat_forecast(properties, complaints, as_of, avg_temp)
    era = R.era_multiplier("year_built")
    insp = R.inspector_multiplier("bbl", "council_district")
    return f.select(
        "property_id", "bbl", "year_built", "council_district", "heat_complaints_30d",
        era.alias("era_multiplier"), insp.alias("inspector_multiplier"),
        F.col("risk_multiplier").alias("heat_multiplier"),
        F.bround(era * insp * F.col("risk_multiplier"), 4).alias("integrated_risk"),
        F.col("urgency"))


def classify_categories(categories: DataFrame) -> DataFrame:
    """R12 over whole category texts."""
    return categories.select("doc_id", R.classify_category("category").alias("violation_class"))


def era_class_multiplier(violations: DataFrame, properties: DataFrame) -> DataFrame:
    """R24 per violation: class-aware era multiplier of its building; a building with very many violations is
    spread over several tasks."""
    p = properties.select("property_id", "year_built")
    v = violations.select("order_key", "line_no", "property_id", "violation_class")
    return (spread_join(v, p, "property_id", ["order_key", "line_no"])
            .select("order_key", "line_no", "property_id", "violation_class", "year_built",
                    R.era_class_multiplier("year_built", "violation_class").alias("era_class_multiplier")))


def heat_probability_14d(properties: DataFrame, complaints: DataFrame, as_of: str,
                         temp_forecast: float = 50.0) -> DataFrame:
    """14-day heat complaints × 0.87, ×1.5 below 55°F; > 0.7 is HIGH_RISK."""
    n = complaint_counts(complaints, as_of, 14, name="complaints_14d")
    cnt = F.coalesce(F.col("complaints_14d"), F.lit(0)).cast("long")
    p = cnt * D.HEAT_PROBABILITY_PER_COMPLAINT
    if temp_forecast is not None and temp_forecast < 55:
        p = p * D.HEAT_PROBABILITY_COLD_FACTOR
    return (properties.select("property_id").join(n, "property_id", "left")
            .select("property_id", cnt.alias("complaints_14d"),
                    F.bround(p, 4).alias("violation_probability"),
                    F.when(p > D.HEAT_PROBABILITY_HIGH, "HIGH_RISK").otherwise("NORMAL").alias("prediction")))


def district_enforcement(violations: DataFrame, properties: DataFrame) -> DataFrame:
    """Inspection density (violations per property) per district, terciles → 2.3/1.8/1.5.

    The ranking window runs over one row per district (bounded by the district set)."""
    p = properties.filter(F.col("council_district").isNotNull()).select("property_id", "council_district")
    per_prop = violations.groupBy("property_id").agg(F.count(F.lit(1)).alias("n"))
    per_dist = (p.join(per_prop, "property_id", "left")
                .groupBy("council_district")
                .agg(F.count(F.lit(1)).alias("properties"),
                     F.coalesce(F.sum("n"), F.lit(0)).alias("inspections")))
    dens = F.bround(F.col("inspections") / F.col("properties"), 6)
    from pyspark.sql import Window
    w = Window.orderBy(F.desc("density"), F.asc("council_district"))
    tier = F.ntile(3).over(w)
    return (per_dist.withColumn("density", dens).withColumn("tier", tier)
            .withColumn("enforcement_intensity", F.element_at(R.lit_array(["HIGH", "MEDIUM", "LOW"]), F.col("tier")))
            .withColumn("multiplier", F.element_at(F.array(*[F.lit(x) for x in D.ENFORCEMENT_TIER_MULT]), F.col("tier"))))


def fine_exposure(violations: DataFrame) -> DataFrame:
    """Open-violation fine exposure per property by class."""
    open_v = violations.filter(~F.col("is_resolved"))
    return open_v.groupBy("property_id").agg(
        F.count(F.lit(1)).alias("open_violations"),
        F.count_if(F.col("violation_class") == "C").alias("class_c"),
        F.sum(R.fine_for_class("violation_class")).cast("long").alias("exposure"))


def property_scores(violations: DataFrame) -> DataFrame:
    """Per-property risk score on a 0–100 scale — the mean severity of the
    property's open hazardous (class B/C) violations (risk_score × 10 = 2 × quantity),
    2 dp; null when it has none — with its violation count and last violation date.
    Sums of the integral quantities are exact in any order, so the score does not
    depend on how partial aggregates are combined."""
    hazard = (~F.col("is_resolved")) & F.col("violation_class").isin("B", "C")
    return violations.groupBy("property_id").agg(
        F.bround(F.try_divide(F.sum(F.when(hazard, F.col("quantity"))) * 2.0, F.count_if(hazard)), 2)
        .alias("risk_score"),
        F.count(F.lit(1)).alias("violation_count"),
        F.max("issued_date").alias("last_violation"))
