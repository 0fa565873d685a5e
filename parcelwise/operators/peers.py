"""Peer benchmarking without materialising peer pairs.

A building's peers are the other buildings of the same borough whose unit
count is within [0.7, 1.3]× of its own (unless either is ≤ 0) and whose year
is within ±15 (unless either is missing).  Every building of a *cell*
(borough, year, units) has the same peers up to itself, so the theta join runs
between cells, not buildings:

1. Buildings grouped by (borough, year key, units key, integer-cent score).
2. Two bucketed equi-joins, one an axis: the scores are summed over the years
   within a target year's range, then over the unit counts within a target cell's.
   A target emits every year bucket (width 5) or log-unit bucket (width 0.1) its
   range touches, plus a wildcard token; a candidate emits its own bucket plus an
   "any" token, so both meet exactly once, then the exact test filters.
3. Per-target statistics are the target cell's totals minus the building
   itself and other buildings on the same parcel (aggregated per parcel group).
   The exact median is an order statistic of the merged histogram.

Work is bounded by (cells × (years + unit counts in range) × distinct scores), not by
the square of any group; a cell holding a third of all rows is one row a score here.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from parcelwise.functions import dims as D
from parcelwise.functions import rules as R
from parcelwise.session import written

YEAR_BUCKET = 5      # a target emits exactly the year buckets covering [year − 15, year + 15]
UNIT_BUCKET = 0.1    # ln(units) buckets; a target emits those covering [ln 0.7u, ln 1.3u], ±1 for float safety
CELL = ["borough_l", "y_key", "u_key"]
MISSING = -(1 << 62)  # stands for "no score" where cents are a key
BLOCK = 128           # cents of a block: medians are looked for among blocks first


def prepare(properties: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per building with normalised match keys and its 2-dp score in cents.  A building without a parcel
    key is a parcel of its own: only itself is left out of its peers."""
    y, u = F.col("year_built"), F.col("units")
    if "building_class" not in properties.columns:
        properties = properties.withColumn("building_class", F.lit(None).cast("string"))
    p = properties.join(scores.select("property_id", "risk_score"), "property_id", "left")
    return p.select(
        "property_id", F.coalesce("bbl", F.concat(F.lit("#"), F.col("property_id").cast("string"))).alias("bbl"),
        "tenant_id", "borough", "units", "year_built", "building_class", "risk_score",
        F.lower(F.coalesce(F.col("borough"), F.lit(""))).alias("borough_l"),
        F.when(y.isNotNull() & (y != 0), y).alias("y_key"),
        F.when(u.isNotNull() & (u > 0), u).alias("u_key"),
        F.round(F.col("risk_score") * 100).cast("long").alias("cents"))


def _unit_ok(t_u: Column, c_u: Column) -> Column:
    return c_u.isNull() | t_u.isNull() | ((c_u / t_u >= 0.7) & (c_u / t_u <= 1.3))


def _year_ok(t_y: Column, c_y: Column) -> Column:
    return c_y.isNull() | t_y.isNull() | (F.abs(c_y - t_y) <= 15)


def _year_tokens(y: Column, target: bool) -> Column:
    """Join tokens on the year axis.  A target emits every bucket its ±15 range touches
    plus "W" (meets wildcard candidates); a candidate emits its bucket (or "W" when its
    year is missing) plus "A" (met by wildcard targets, which emit only "A")."""
    if target:
        lo, hi = F.floor((y - 15) / YEAR_BUCKET), F.floor((y + 15) / YEAR_BUCKET)
        return F.when(y.isNull(), F.array(F.lit("A"))).otherwise(
            F.concat(F.transform(F.sequence(lo, hi), lambda b: b.cast("string")), F.array(F.lit("W"))))
    return F.array(F.coalesce(F.floor(y / YEAR_BUCKET).cast("string"), F.lit("W")), F.lit("A"))


def _unit_tokens(u: Column, target: bool) -> Column:
    """Same on ln(units): a target covers ratios 0.7–1.3, widened by one bucket each side."""
    if target:
        lo = F.floor(F.log(u.cast("double") * 0.7) / UNIT_BUCKET) - 1
        hi = F.floor(F.log(u.cast("double") * 1.3) / UNIT_BUCKET) + 1
        return F.when(u.isNull(), F.array(F.lit("A"))).otherwise(
            F.concat(F.transform(F.sequence(lo, hi), lambda b: b.cast("string")), F.array(F.lit("W"))))
    b = F.floor(F.log(u.cast("double")) / UNIT_BUCKET)
    return F.array(F.coalesce(b.cast("string"), F.lit("W")), F.lit("A"))


def _eq_null_safe(cols_a: list[str], cols_b: list[str]) -> Column:
    cond = None
    for a, b in zip(cols_a, cols_b):
        e = F.col(a).eqNullSafe(F.col(b))
        cond = e if cond is None else cond & e
    return cond


def _named(prepared: DataFrame, keys: list[str], name: str, *aggs: Column) -> DataFrame:
    """The groups of ``keys``, each with the smallest property_id in it as its id: one plain key for the joins
    and windows that follow, where the keys themselves hold nulls."""
    return prepared.groupBy(*keys).agg(F.min("property_id").alias(name), *aggs)


def _look_up(df: DataFrame, names: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    side = names.select(*[F.col(k).alias(f"_n_{k}") for k in keys], *cols)
    return df.join(side, _eq_null_safe(keys, [f"_n_{k}" for k in keys])).drop(*[f"_n_{k}" for k in keys])


def _by_year(prepared: DataFrame, v: Column) -> tuple[DataFrame, DataFrame]:
    """(lines, by_year): the (borough, year) pairs as ``line``, and (line, u_key, v, cnt), the buildings whose years a
    line's range admits; at most one row per (borough, year, units, v)."""
    entries = prepared.groupBy(*CELL, F.coalesce(v, F.lit(MISSING)).alias("v")).agg(F.count(F.lit(1)).alias("cnt"))
    lines = _named(prepared, CELL, "cell").groupBy("borough_l", "y_key").agg(F.min("cell").alias("line"))
    years = lines.select("line", F.col("borough_l").alias("t_borough_l"), F.col("y_key").alias("t_y_key"),
                         F.explode(_year_tokens(F.col("y_key"), True)).alias("t_ytok"))
    c = entries.withColumn("ytok", F.explode(_year_tokens(F.col("y_key"), False)))
    return lines, (years.join(c, (F.col("t_borough_l") == F.col("borough_l")) & (F.col("t_ytok") == F.col("ytok")))
                   .filter(_year_ok(F.col("t_y_key"), F.col("y_key")))
                   .groupBy("line", "u_key", "v").agg(F.sum("cnt").alias("cnt")))


def _by_units(prepared: DataFrame, lines: DataFrame, sides: DataFrame, *cols: str) -> DataFrame:
    """Each cell with the rows of ``sides`` (line, u_key, ``cols``) on its line whose unit counts its range admits."""
    targets = (_look_up(_named(prepared, CELL, "cell"), lines, ["borough_l", "y_key"], ["line"])
               .select("cell", F.col("line").alias("t_line"), F.col("u_key").alias("t_u_key"),
                       F.explode(_unit_tokens(F.col("u_key"), True)).alias("t_utok")))
    c = sides.withColumn("utok", F.explode(_unit_tokens(F.col("u_key"), False)))
    return (targets.join(c, (F.col("t_line") == F.col("line")) & (F.col("t_utok") == F.col("utok")))
            .filter(_unit_ok(F.col("t_u_key"), F.col("u_key"))).select("cell", "line", "u_key", *cols))


def merged_counts(prepared: DataFrame) -> DataFrame:
    """(cell, v, cnt): the buildings that the cell's peer predicate admits, the cell itself included, scored (v 0) and
    unscored (``MISSING``); ``cell`` is the id of ``_named``.

    The predicate is a year test and a unit test, so the sum runs over one axis at a time:
    first over the candidates' years for each target year, then over their unit counts for
    each target cell.  The work per cell is the sum of the two ranges, not their product."""
    lines, by_year = _by_year(prepared, F.when(F.col("cents").isNotNull(), F.lit(0).cast("long")))
    return _by_units(prepared, lines, by_year, "v", "cnt").groupBy("cell", "v").agg(F.sum("cnt").alias("cnt"))


def _lots(prepared: DataFrame) -> DataFrame:
    """One row per (parcel, cell), a *lot*: its buildings leave the same ones out of their peers."""
    lots = _named(prepared, ["bbl", *CELL], "lot", F.count(F.lit(1)).alias("g_n"), F.count("cents").alias("g_ns"),
                  F.sum("cents").alias("g_sc"))
    return _look_up(lots, _named(prepared, CELL, "cell"), CELL, ["cell"])


def _left_out_pairs(lots: DataFrame) -> DataFrame:
    """(lot, lot of the same parcel that it would match, itself included): what its buildings' peer sets leave out."""
    g = lots.select(F.col("bbl").alias("g_bbl"), *[F.col(c).alias(f"g_{c}") for c in CELL], F.col("lot").alias("e_lot"),
                    F.col("g_n").alias("x_n"), F.col("g_ns").alias("x_ns"), F.col("g_sc").alias("x_sc"))
    return (lots.select("lot", "cell", "bbl", *CELL)
            .join(g, (F.col("bbl") == F.col("g_bbl")) & (F.col("borough_l") == F.col("g_borough_l")))
            .filter(_year_ok(F.col("y_key"), F.col("g_y_key")) & _unit_ok(F.col("u_key"), F.col("g_u_key")))
            .select("lot", "cell", "e_lot", "x_n", "x_ns", "x_sc"))


def _left_out(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("lot", "cell").agg(F.sum("x_n").alias("e_n"), F.sum("x_ns").alias("e_ns"),
                                            F.coalesce(F.sum("x_sc"), F.lit(0)).alias("e_sc"))


def _with_lot(prepared: DataFrame, lots: DataFrame) -> DataFrame:
    return _look_up(prepared.select("property_id", "bbl", "cents", *CELL), lots, ["bbl", *CELL], ["lot", "cell"]) \
        .select("property_id", "cents", "lot", "cell")


def peer_counts(prepared: DataFrame) -> DataFrame:
    """J4 per building: similar_count (all peers) and scored_peers, without histograms."""
    lots = _lots(prepared)
    tot = merged_counts(prepared).groupBy("cell").agg(
        F.sum("cnt").alias("m_n"), F.coalesce(F.sum(F.when(F.col("v") != MISSING, F.col("cnt"))), F.lit(0)).alias("m_ns"))
    per_lot = _left_out(_left_out_pairs(lots)).join(tot, "cell").select(
        "lot", (F.col("m_n") - F.col("e_n")).alias("similar_count"), (F.col("m_ns") - F.col("e_ns")).alias("scored_peers"))
    return _with_lot(prepared, lots).join(per_lot, "lot").select("property_id", "similar_count", "scored_peers")


def peer_stats(prepared: DataFrame, materialize: bool = True) -> DataFrame:
    """Per building: similar_count (all peers), scored peers, cent sum, strictly-below
    count and exact median (in cents) of scored peers.

    No cell's merged histogram is made.  A *band* is the histogram of one unit count on one
    (borough, year) line; a cell admits a few bands.  Strictly-below counts are as-of lookups
    of a cell's own scores in its bands' running counts; medians are looked for among
    ``BLOCK``-wide sums of the bands, then among the values of the one or two blocks whose ranks
    can hold them.  With ``materialize`` the steps are written to the shared checkpoint folder,
    so each is computed once and no plan holds those before it."""
    def keep(df, name):
        return written(df, f"peers-{name}") if materialize else df

    lots = keep(_lots(prepared), "lots")
    pairs = keep(_left_out_pairs(lots), "pairs")
    out_of = keep(_left_out(pairs), "left-out")
    buildings = keep(_with_lot(prepared, lots), "buildings")
    lines, by_year = _by_year(prepared, F.col("cents"))
    band = ["line", "band"]     # u_key is positive where it is not null
    unit = F.coalesce("u_key", F.lit(-1)).alias("band")
    bands = keep(by_year.select("line", "u_key", unit, "v", "cnt", F.floor(F.col("v") / BLOCK).alias("block")), "bands")
    scored = F.when(F.col("v") != MISSING, F.col("cnt")).otherwise(F.lit(0))
    sums = bands.groupBy("line", "u_key").agg(F.sum("cnt").alias("n"), F.sum(scored).alias("ns"), F.sum(scored * F.col("v")).alias("sc"))
    reach = keep(_by_units(prepared, lines, sums, "n", "ns", "sc").withColumn("band", unit), "reach")
    totals = reach.groupBy("cell").agg(F.sum("n").alias("m_n"), F.sum("ns").alias("m_ns"), F.sum("sc").alias("m_sc"))
    reach, bands = reach.select("cell", *band), bands.filter(F.col("v") != MISSING).select(*band, "block", "v", "cnt")
    # Strictly below in the merged histogram: a cell's own scores against each of its bands.
    asked = buildings.filter(F.col("cents").isNotNull()).select("cell", F.col("cents").alias("v")).distinct()
    marks = bands.select(*band, "v", "cnt", F.lit(None).cast("long").alias("cell")).unionByName(
        reach.join(asked, "cell").select(*band, "v", F.lit(0).cast("long").alias("cnt"), "cell"))
    less = F.sum("cnt").over(Window.partitionBy(*band).orderBy("v").rangeBetween(Window.unboundedPreceding, -1))
    own = (marks.withColumn("less", less).filter(F.col("cell").isNotNull())
           .groupBy("cell", F.col("v").alias("cents")).agg(F.coalesce(F.sum("less"), F.lit(0)).alias("m_below")))
    # The scored peers of a cell's buildings number m_ns - e_ns, and ranks shift by at most e_ns.
    spread = out_of.groupBy("cell").agg(F.min("e_ns").alias("e_least"), F.max("e_ns").alias("e_most"))
    first = F.floor((F.col("m_ns") - F.col("e_most") + 1) / 2)
    last = F.floor((F.col("m_ns") - F.col("e_least")) / 2) + 1 + F.col("e_most")

    def central(of, within, value):
        """The values of each cell, with running counts from ``before`` on, whose ranks can hold a median."""
        w = Window.partitionBy(*within).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        run = of.withColumn("cum_le", F.col("before") + F.sum("cnt").over(w)).withColumn("cum_lt", F.col("cum_le") - F.col("cnt"))
        return run.filter((F.col("cum_le") >= F.col("first")) & (F.col("cum_lt") < F.col("last")))

    limits = totals.join(spread, "cell").select("cell", first.alias("first"), last.alias("last"))
    by_block = (reach.join(bands.groupBy(*band, "block").agg(F.sum("cnt").alias("cnt")), band)
                .groupBy("cell", "block").agg(F.sum("cnt").alias("cnt")))
    blocks = keep(central(by_block.join(limits, "cell").withColumn("before", F.lit(0).cast("long")), ["cell"], "block")
                  .select("cell", "block", F.col("cum_lt").alias("before"), "first", "last"), "blocks")
    by_value = (blocks.select("cell", "block").join(reach, "cell").join(bands, [*band, "block"])
                .groupBy("cell", "block", "v").agg(F.sum("cnt").alias("cnt")).join(blocks, ["cell", "block"]))
    points = keep(central(by_value, ["cell", "block"], "v").select("cell", "v", "cum_le", "cum_lt"), "points")
    n2 = F.col("m_ns") - F.col("e_ns")
    base = keep(out_of.join(totals, "cell").select(
        "lot", "cell", (F.col("m_n") - F.col("e_n")).alias("similar_count"), n2.alias("scored_peers"),
        (F.col("m_sc") - F.col("e_sc")).alias("sum_cents"), F.floor((n2 + 1) / 2).cast("long").alias("j1"),
        (F.floor(n2 / 2) + 1).cast("long").alias("j2"), F.col("e_ns").alias("k")), "base")
    lot_hist = buildings.filter(F.col("cents").isNotNull()).groupBy(F.col("lot").alias("e_lot"), F.col("cents").alias("e_cents")) \
        .agg(F.count(F.lit(1)).alias("e_cnt"))
    ex_hist = keep(pairs.select("lot", "e_lot").join(lot_hist, "e_lot")
                   .groupBy("lot", "e_cents").agg(F.sum("e_cnt").alias("e_cnt")), "left-out-scores")
    # Strictly below: the building's own score is in its cell's and its lot's histogram, two equi-lookups.
    up_to = Window.partitionBy("lot").orderBy("e_cents")
    below_e = ex_hist.select("lot", "e_cents", (F.sum("e_cnt").over(up_to) - F.col("e_cnt")).alias("e_below"))
    below = (buildings.join(own, ["cell", "cents"])
             .join(below_e.withColumnRenamed("e_cents", "cents"), ["lot", "cents"])
             .select("property_id", (F.col("m_below") - F.col("e_below")).alias("below")))
    # Median: P = M \ E; P_j = min v in M with cumM(v) - cumE(v) >= j, and only values whose
    # ranks lie in [j1, j2 + k) can hold it.  Lots of a cell mostly share (j1, j2, k), so
    # the points are searched once for each of these, then handed to the lots.
    rank = ["j1", "j2", "k"]
    near = (base.filter(F.col("scored_peers") > 0).select("cell", *rank).distinct()
            .join(points, "cell")
            .filter((F.col("cum_le") >= F.col("j1")) & (F.col("cum_lt") < F.col("j2") + F.col("k"))))
    cum_e = (base.select("lot", "cell", *rank).join(near, ["cell", *rank]).join(ex_hist, "lot", "left")
             .groupBy("lot", "j1", "j2", "v", "cum_le")
             .agg(F.coalesce(F.sum(F.when(F.col("e_cents") <= F.col("v"), F.col("e_cnt"))), F.lit(0)).alias("ce")))
    rank_p = F.col("cum_le") - F.col("ce")
    med = keep(cum_e.groupBy("lot").agg(
        F.min(F.when(rank_p >= F.col("j1"), F.col("v"))).alias("p1"),
        F.min(F.when(rank_p >= F.col("j2"), F.col("v"))).alias("p2")), "medians")
    below = keep(below, "below")
    per_lot = base.join(med, "lot", "left")
    return (buildings.select("property_id", "lot").join(per_lot, "lot").join(below, "property_id", "left")
            .select("property_id", "similar_count", "scored_peers", "sum_cents", F.coalesce("below", F.lit(0)).alias("below"),
                    F.when(F.col("scored_peers") > 0, (F.col("p1") + F.col("p2")) / 2.0).alias("median_cents")))


def _fmt0(x: Column) -> Column:
    """Format a number with no decimals, rounding half-even (as the product's formatting)."""
    return F.bround(x, 0).cast("long").cast("string")


def peer_benchmark(prepared: DataFrame, stats: DataFrame) -> DataFrame:
    """A8 + R14 for every scored building."""
    t = prepared.filter(F.col("risk_score").isNotNull()).select(
        "property_id", "borough", "units", "year_built", "risk_score")
    j = t.join(stats, "property_id")
    ns = F.col("scored_peers")
    pct = F.col("below") / ns * 100
    avg = F.col("sum_cents") / ns / 100.0
    med = F.col("median_cents") / 100.0
    has = ns > 0
    comparison = (F.when(pct >= 75, F.concat(F.lit("Top "), _fmt0(100 - pct), F.lit("% riskiest")))
                  .when(pct >= 50, "Above average risk").when(pct >= 25, "Below average risk")
                  .otherwise(F.concat(F.lit("Bottom "), _fmt0(pct), F.lit("% risk"))))
    crit = F.concat_ws(", ",
                       F.when(F.col("borough").isNotNull(), F.concat(F.col("borough"), F.lit(" properties"))),
                       F.when(F.col("units").isNotNull(),
                              F.concat((F.col("units") * 0.7).cast("long").cast("string"), F.lit("-"),
                                       (F.col("units") * 1.3).cast("long").cast("string"), F.lit(" units"))),
                       F.when(F.col("year_built").isNotNull(),
                              F.concat(F.lit("built "), (F.col("year_built") - 15).cast("string"), F.lit(" to "),
                                       (F.col("year_built") + 15).cast("string"))))
    score = F.col("risk_score")
    action = (F.when(pct >= 75, F.concat(F.lit("Your score "), _fmt0(score), F.lit(" is "), _fmt0(score - avg),
                                         F.lit(" points above neighborhood average. Immediate review recommended.")))
              .when(pct >= 50, F.concat(F.lit("Your score "), _fmt0(score),
                                        F.lit(" is above average. Consider preventive measures.")))
              .otherwise(F.concat(F.lit("Your score "), _fmt0(score),
                                  F.lit(" is below neighborhood average. Continue current maintenance."))))
    return j.select(
        "property_id",
        F.when(has, F.bround(score, 1)).otherwise(score).alias("risk_score"),
        F.when(has, F.col("similar_count")).otherwise(F.lit(0)).alias("similar_count"),
        F.when(has, F.bround(pct, 0)).alias("percentile"),
        F.when(has, R.peer_urgency(pct)).alias("urgency"),
        F.when(has, comparison).otherwise("Insufficient peer data").alias("vs_peers"),
        F.when(has, F.bround(avg, 1)).alias("neighborhood_avg"),
        F.when(has, F.bround(med, 1)).alias("neighborhood_median"),
        F.when(has, F.concat(F.lit("Matched on: "), crit)).alias("match_criteria"),
        F.when(has, action).alias("action"))


def market_below(market: DataFrame, probes: DataFrame, value: str) -> DataFrame:
    """Count of market scores strictly below each probe value, without a cross join.

    Market scores are 2-dp on a 0–100 scale; their cumulative histogram over the
    cent domain (at least 0..10 000, widened to the data's range) is a
    domain-bounded table, so each probe is an equi-lookup of three neighbouring
    cent keys (which absorbs the float error of value × 100).  The totals ride
    along on every row of that table."""
    m = market.filter(F.col("cents").isNotNull()).groupBy("cents").agg(F.count(F.lit(1)).alias("cnt"))
    spine = (m.agg(F.min("cents").alias("lo"), F.max("cents").alias("hi"))
             .select(F.explode(F.sequence(F.least(F.lit(0).cast("long"), F.coalesce("lo", F.lit(0).cast("long"))),
                                          F.greatest(F.lit(10000).cast("long"),
                                                     F.coalesce("hi", F.lit(0).cast("long"))))).alias("cents")))
    w = Window.orderBy("cents").rowsBetween(Window.unboundedPreceding, 0)
    wall = Window.partitionBy()
    cnt = F.coalesce("cnt", F.lit(0))
    dense = (spine.join(m, "cents", "left")
             .select("cents", F.sum(cnt).over(w).alias("cum_le"),
                     F.sum(cnt).over(wall).alias("market_size"),
                     F.sum(cnt * F.col("cents")).over(wall).alias("market_sum_cents")))
    k = F.floor(F.col(value) * 100).cast("long")
    cand = probes.select("*", F.explode(F.array(k - 1, k, k + 1)).alias("_c"))
    j = cand.join(dense.withColumnRenamed("cents", "_c"), "_c", "left")
    keep = F.when(F.col("_c") / 100.0 < F.col(value), F.col("cum_le"))
    return (j.groupBy(*probes.columns)
            .agg(F.coalesce(F.max(keep), F.lit(0)).alias("market_below"),
                 F.max("market_size").alias("market_size"), F.max("market_sum_cents").alias("market_sum_cents")))


def portfolio_peer_ranking(prepared: DataFrame) -> DataFrame:
    """A7 + R15 per tenant against the whole market (all scored buildings)."""
    per = prepared.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("portfolio_size"),
        F.count("cents").alias("_ns"), F.sum("cents").alias("_sc"),
        F.count_if(F.coalesce(F.col("risk_score"), F.lit(0.0)) >= D.HIGH_RISK_SCORE).alias("high_risk_buildings"))
    avg = F.when(F.col("_ns") > 0, F.col("_sc") / F.col("_ns") / 100.0).otherwise(F.lit(50.0))
    probes = per.select("tenant_id", "portfolio_size", "high_risk_buildings", avg.alias("avg_risk"))
    ranked = market_below(prepared, probes, "avg_risk")
    market_avg = F.when(F.col("market_size") > 0,
                        F.col("market_sum_cents") / F.col("market_size") / 100.0).otherwise(F.lit(50.0))
    pct = F.when(F.col("market_size") > 0, F.col("market_below") / F.col("market_size") * 100)
    hi, tot = F.col("high_risk_buildings"), F.col("portfolio_size")
    rec = (F.when(hi > tot * 0.3, F.concat(F.lit("⚠️  "), hi.cast("string"),
                                           F.lit(" buildings need immediate attention. Portfolio-wide review recommended.")))
           .when(F.col("avg_risk") > 65, "Portfolio risk is elevated. Focus on preventive maintenance.")
           .otherwise("Portfolio health is acceptable. Continue monitoring."))
    return ranked.select(
        "tenant_id", "portfolio_size",
        F.bround("avg_risk", 1).alias("average_risk"),
        F.bround(market_avg, 1).alias("market_average"),
        F.bround(pct, 0).alias("portfolio_percentile"),
        "high_risk_buildings",
        F.bround(hi / tot * 100, 1).alias("high_risk_percentage"),
        F.when(F.col("avg_risk") > market_avg, "Above Market Average").otherwise("Below Market Average")
        .alias("performance"),
        rec.alias("recommendation"))


# ------------------------------------------------------------- k nearest
KCELL = CELL + ["class_l"]
#: Nested boxes around a cell: years, and width in ln(units) (0: the same unit count).  All buildings of one box are
#: peers of each other: 14 years and a ratio of exp(0.26) < 1.3 at most.
RINGS = [(1, 0), (3, 0.06), (6, 0.12), (15, 0.26)]


def _distance(t_y: Column, t_u: Column, t_cls: Column, c_y: Column, c_u: Column, c_cls: Column) -> Column:
    """Similarity distance: age gap in 15-year units + relative size gap + 1 if the
    building class differs; an axis with a missing value contributes 0."""
    dy = F.when(t_y.isNull() | c_y.isNull(), F.lit(0.0)).otherwise(F.abs(c_y - t_y) / 15.0)
    du = F.when(t_u.isNull() | c_u.isNull(), F.lit(0.0)).otherwise(F.abs(c_u - t_u) / t_u)
    dc = F.when(t_cls.eqNullSafe(c_cls), F.lit(0.0)).otherwise(F.lit(1.0))
    return dy + du + dc


def _rings(cells: DataFrame, k: int) -> DataFrame:
    """Per cell a distance within which k peers of any of its buildings must lie, null where none is known.

    Nested grid boxes (``RINGS``) hold a cell; all buildings of its box are peers at most that
    ring's distance away (one more for another class).  The smallest ring whose box holds k
    buildings besides the most crowded parcel of the cell is the one to search.  A box holds at
    most its years times its unit counts times the classes."""
    need, out, least = F.col("most") + k, cells, []
    for i, (years, width) in enumerate(RINGS):
        reach = (years - 1) / 15.0 + (math.exp(width) - 1 if width else 0.0)
        out = out.withColumn("b_y", F.floor(F.col("y_key") / years)) \
            .withColumn("b_u", F.floor(F.log(F.col("u_key").cast("double")) / width) if width else F.col("u_key"))
        box = ["borough_l", "b_y", "b_u"]
        out = out.withColumn(f"all_{i}", F.sum("n").over(Window.partitionBy(*box))) \
            .withColumn(f"same_{i}", F.sum("n").over(Window.partitionBy(*box, "class_l")))
        least += [F.when(F.col(f"same_{i}") >= need, F.lit(reach)), F.when(F.col(f"all_{i}") >= need, F.lit(1.0 + reach))]
    return out.select(*cells.columns, F.least(*least).alias("reach"))


def _near_tokens(y: Column, u: Column, reach: Column) -> tuple[Column, Column]:
    """Year and unit tokens of a target that only looks ``reach`` far: at most the whole ranges."""
    years = F.least(F.lit(15.0), F.coalesce(reach * 15.0, F.lit(15.0)) + 0.001)
    share = F.least(F.lit(0.3), F.coalesce(reach, F.lit(0.3)) + 0.001)
    lo, hi = F.floor((y - years) / YEAR_BUCKET), F.floor((y + years) / YEAR_BUCKET)
    ln = u.cast("double")
    ulo, uhi = F.floor(F.log(ln * (1 - share)) / UNIT_BUCKET - 0.001), F.floor(F.log(ln * (1 + share)) / UNIT_BUCKET + 0.001)

    def tokens(a, b, key):
        return F.when(key.isNull(), F.array(F.lit("A"))).otherwise(
            F.concat(F.transform(F.sequence(a, b), lambda x: x.cast("string")), F.array(F.lit("W"))))
    return tokens(lo, hi, y), tokens(ulo, uhi, u)


def nearest_peers(prepared: DataFrame, k: int = 100) -> DataFrame:
    """The k most similar peers of every building (ties → smaller id).

    Exact and bounded.  Each target cell searches the (year, units) grid only as far as the
    ring that must hold its k-th peer (``_rings``), cells of its own class and, where the ring
    goes beyond the class's distance of 1, of the others that much nearer.  One window then ranks
    the candidate cells by distance and keeps them while fewer than k + m buildings are strictly
    closer (m = the number of buildings on a building's own parcel, which bounds its exclusions);
    each kept cell contributes its 2 k lowest-id buildings, at most k of one parcel: of those, at
    most k are on the target's parcel.  The final top-k per building is ``top_n_per_key``."""
    from parcelwise.operators.windows import top_n_per_key

    def keep(df, name):
        return written(df, f"peers-{name}")     # the steps after it plan on a plain scan

    p = prepared.withColumn("class_l", F.col("building_class"))
    mates = p.groupBy("bbl").agg(F.count(F.lit(1)).alias("mates"))
    names = _named(p, KCELL, "cell")
    buildings = keep(_look_up(p.select("property_id", "bbl", "cents", *KCELL), names, KCELL, ["cell"]).join(mates, "bbl"), "cell-buildings")
    cells = buildings.groupBy("cell", *KCELL).agg(F.count(F.lit(1)).alias("n"), F.max("mates").alias("most"))
    # A target makes many more rows than its own bytes tell: as many partitions as the session shuffles into.
    parts = int(prepared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ringed = keep(_rings(cells, k), "rings").repartition(parts, "cell")
    y, u, reach = F.col("y_key"), F.col("u_key"), F.col("reach")

    def search(targets, how_far, extra, same_class):
        ytok, utok = _near_tokens(y, u, how_far)
        t = (targets.select(F.col("cell").alias("t_cell"), F.col("most"), *[F.col(x).alias(f"t_{x}") for x in KCELL],
                            (F.coalesce(how_far, F.lit(9.0)) + 1e-9).alias("far"), F.explode(ytok).alias("ytok"), utok.alias("_u"))
             .withColumn("utok", F.explode("_u")).drop("_u"))
        c = (ringed.select(F.col("cell").alias("c_cell"), "n", *[F.col(x).alias(f"c_{x}") for x in KCELL],
                          F.explode(_year_tokens(y, False)).alias("c_ytok"), _unit_tokens(u, False).alias("_u"))
             .withColumn("c_utok", F.explode("_u")).drop("_u"))
        on = (F.col("t_borough_l") == F.col("c_borough_l")) & (F.col("ytok") == F.col("c_ytok")) & (F.col("utok") == F.col("c_utok"))
        alike = F.col("t_class_l").eqNullSafe(F.col("c_class_l"))
        axes = _distance(F.col("t_y_key"), F.col("t_u_key"), F.col("t_class_l"),
                         F.col("c_y_key"), F.col("c_u_key"), F.col("t_class_l"))
        return (t.join(c, on & (alike if same_class else ~alike))
                .filter(_year_ok(F.col("t_y_key"), F.col("c_y_key")) & _unit_ok(F.col("t_u_key"), F.col("c_u_key")))
                .withColumn("_axes", axes).filter(F.col("_axes") <= F.col("far"))
                .select("t_cell", "most", "c_cell", "n", (F.col("_axes") + extra).alias("d")))

    near = search(ringed, reach, 0.0, True)
    others = search(ringed.filter(reach.isNull() | (reach >= 1)), reach - 1.0, 1.0, False)
    up_to = Window.partitionBy("t_cell").orderBy("d").rangeBetween(Window.unboundedPreceding, 0)
    closer = F.sum("n").over(up_to) - F.sum("n").over(Window.partitionBy("t_cell", "d"))
    kept = keep(near.unionByName(others).withColumn("closer", closer).filter(F.col("closer") < k + F.col("most")), "kept")
    of_parcel = top_n_per_key(buildings.select(F.col("cell").alias("c_cell"), F.col("property_id").alias("peer_id"),
                                               F.col("bbl").alias("peer_bbl"), F.col("cents").alias("peer_cents")),
                              ["c_cell", "peer_bbl"], [F.asc("peer_id")], k, rank_col=None)
    members = keep(top_n_per_key(of_parcel, ["c_cell"], [F.asc("peer_id")], 2 * k, rank_col=None), "members")
    expanded = kept.select("t_cell", "c_cell", "d", "closer").join(members, "c_cell")
    tj = (buildings.select("property_id", "bbl", "cents", "mates", F.col("cell").alias("t_cell")).join(expanded, "t_cell")
          .filter((F.col("peer_bbl") != F.col("bbl")) & (F.col("closer") < k + F.col("mates")))
          .select("property_id", "cents", "d", "peer_id", "peer_cents"))
    return top_n_per_key(tj, ["property_id"], [F.asc("d"), F.asc("peer_id")], k, rank_col=None)


def peer_topn(prepared: DataFrame, k: int = 100) -> DataFrame:
    """R27 report per scored building: peer count, peer average, strict percentile, ranking text."""
    top = nearest_peers(prepared, k)
    agg = top.groupBy("property_id").agg(
        F.count(F.lit(1)).alias("peer_count"), F.count("peer_cents").alias("_ns"),
        F.sum("peer_cents").alias("_sc"),
        F.count_if(F.col("peer_cents") < F.col("cents")).alias("_below"))
    t = prepared.filter(F.col("cents").isNotNull()).select("property_id", "risk_score")
    j = t.join(agg, "property_id", "left")
    ns = F.coalesce(F.col("_ns"), F.lit(0))
    pct = F.when(ns > 0, F.bround(F.col("_below") / ns * 100, 0))
    ranking = F.when(pct < 50, F.concat(F.lit("Top "), pct.cast("long").cast("string"), F.lit("%"))) \
        .otherwise(F.concat(F.lit("Bottom "), (100 - pct).cast("long").cast("string"), F.lit("%")))
    return j.select("property_id", F.coalesce(F.col("peer_count"), F.lit(0)).alias("peer_count"),
                    F.when(ns > 0, F.bround(F.col("_sc") / ns / 100.0, 1)).alias("peer_average"),
                    pct.alias("percentile"), F.when(ns > 0, ranking).alias("ranking"))
