"""Registered batch queries: peer benchmarks."""

from __future__ import annotations

from parcelwise.operators import peers as P
from parcelwise.operators import scoring as S
from parcelwise.plans.more_queries import PROPERTY_SCORE_SQL
from parcelwise.plans.registry import query
from parcelwise.session import written
from parcelwise.sources.tables import Tables


def _prepared(spark, d):
    v = Tables(spark, d).views
    # One row per building, used by every branch of the peer plan: computed once.
    return written(P.prepare(v.properties(), S.property_scores(v.violations())), "peers-prepared")


BUILDINGS_SQL = f"""
s AS ({PROPERTY_SCORE_SQL}),
b AS (SELECT p.property_id, p.bbl, p.tenant_id, p.borough, p.units, p.year_built, p.building_class, s.risk_score,
             lower(COALESCE(p.borough, '')) AS bl,
             CASE WHEN p.year_built IS NOT NULL AND p.year_built <> 0 THEN p.year_built END AS yk,
             CASE WHEN p.units > 0 THEN p.units END AS uk,
             CAST(round(s.risk_score * 100) AS BIGINT) AS cents
      FROM properties p LEFT JOIN s ON p.property_id = s.property_id)"""

# Brute force: every (target, candidate) pair — fine for the oracle at small scale.
PAIRS_SQL = f"""
WITH {BUILDINGS_SQL},
pr AS (SELECT t.property_id AS tid, c.cents AS cc
       FROM b t JOIN b c ON t.bl = c.bl AND t.bbl <> c.bbl
       WHERE (c.uk IS NULL OR t.uk IS NULL OR (c.uk / t.uk >= 0.7 AND c.uk / t.uk <= 1.3))
         AND (c.yk IS NULL OR t.yk IS NULL OR abs(c.yk - t.yk) <= 15))"""


@query("peer_pairs", f"""
{PAIRS_SQL}
SELECT b.property_id, CAST(count(pr.tid) AS BIGINT) AS similar_count, CAST(count(pr.cc) AS BIGINT) AS scored_peers
FROM b LEFT JOIN pr ON pr.tid = b.property_id GROUP BY b.property_id""")
def q_peer_pairs(spark, d):
    """The peer relation, reported per building as its peer counts (pairs are
    aggregated at cell level and never listed)."""
    return P.peer_counts(_prepared(spark, d))


def _fmt0(x: str) -> str:
    return f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"


@query("peer_benchmark", f"""
{PAIRS_SQL},
st AS (SELECT t.property_id, t.risk_score, t.borough, t.units, t.year_built, count(pr.tid) AS similar_count,
              count(pr.cc) AS ns, sum(pr.cc) AS sc, count(*) FILTER (WHERE pr.cc < t.cents) AS below,
              median(pr.cc) AS med
       FROM b t LEFT JOIN pr ON pr.tid = t.property_id WHERE t.risk_score IS NOT NULL
       GROUP BY t.property_id, t.risk_score, t.borough, t.units, t.year_built),
x AS (SELECT *, below / ns * 100 AS pct, sc / ns / 100.0::DOUBLE AS av, med / 100.0::DOUBLE AS md FROM st)
SELECT property_id,
       CASE WHEN ns > 0 THEN round_even(risk_score, 1) ELSE risk_score END AS risk_score,
       CAST(CASE WHEN ns > 0 THEN similar_count ELSE 0 END AS BIGINT) AS similar_count,
       CASE WHEN ns > 0 THEN round_even(pct, 0) END AS percentile,
       CASE WHEN ns > 0 THEN CASE WHEN pct >= 90 THEN 'CRITICAL' WHEN pct >= 75 THEN 'HIGH'
                                  WHEN pct >= 50 THEN 'MODERATE' ELSE 'LOW' END END AS urgency,
       CASE WHEN ns > 0 THEN
         CASE WHEN pct >= 75 THEN 'Top ' || {_fmt0('100 - pct')} || '% riskiest'
              WHEN pct >= 50 THEN 'Above average risk' WHEN pct >= 25 THEN 'Below average risk'
              ELSE 'Bottom ' || {_fmt0('pct')} || '% risk' END
         ELSE 'Insufficient peer data' END AS vs_peers,
       CASE WHEN ns > 0 THEN round_even(av, 1) END AS neighborhood_avg,
       CASE WHEN ns > 0 THEN round_even(md, 1) END AS neighborhood_median,
       CASE WHEN ns > 0 THEN 'Matched on: ' || concat_ws(', ',
           CASE WHEN borough IS NOT NULL THEN borough || ' properties' END,
           CASE WHEN units IS NOT NULL THEN CAST(CAST(trunc(units * 0.7::DOUBLE) AS BIGINT) AS VARCHAR) || '-'
                || CAST(CAST(trunc(units * 1.3::DOUBLE) AS BIGINT) AS VARCHAR) || ' units' END,
           CASE WHEN year_built IS NOT NULL THEN 'built ' || CAST(year_built - 15 AS VARCHAR) || ' to '
                || CAST(year_built + 15 AS VARCHAR) END) END AS match_criteria,
       CASE WHEN ns > 0 THEN
         CASE WHEN pct >= 75 THEN 'Your score ' || {_fmt0('risk_score')} || ' is ' || {_fmt0('risk_score - av')}
                   || ' points above neighborhood average. Immediate review recommended.'
              WHEN pct >= 50 THEN 'Your score ' || {_fmt0('risk_score')} || ' is above average. Consider preventive measures.'
              ELSE 'Your score ' || {_fmt0('risk_score')} || ' is below neighborhood average. Continue current maintenance.'
         END END AS action
FROM x""")
def q_peer_benchmark(spark, d):
    pr = _prepared(spark, d)
    return P.peer_benchmark(pr, P.peer_stats(pr))


@query("portfolio_peer_ranking", f"""
WITH {BUILDINGS_SQL},
per AS (SELECT tenant_id, count(*) AS portfolio_size, count(cents) AS ns, sum(cents) AS sc,
               count(*) FILTER (WHERE COALESCE(risk_score, 0.0) >= 70) AS high_risk_buildings FROM b GROUP BY tenant_id),
pa AS (SELECT *, CASE WHEN ns > 0 THEN sc / ns / 100.0::DOUBLE ELSE 50.0::DOUBLE END AS avg_risk FROM per),
mk AS (SELECT count(cents) AS mn, sum(cents) AS msc FROM b),
r AS (SELECT pa.*, (SELECT count(*) FROM b WHERE b.cents IS NOT NULL AND b.cents / 100.0::DOUBLE < pa.avg_risk) AS below,
             mk.mn, CASE WHEN mk.mn > 0 THEN mk.msc / mk.mn / 100.0::DOUBLE ELSE 50.0::DOUBLE END AS market_avg
      FROM pa, mk)
SELECT tenant_id, CAST(portfolio_size AS BIGINT) AS portfolio_size, round_even(avg_risk, 1) AS average_risk,
       round_even(market_avg, 1) AS market_average,
       CASE WHEN mn > 0 THEN round_even(below / mn * 100, 0) END AS portfolio_percentile,
       CAST(high_risk_buildings AS BIGINT) AS high_risk_buildings,
       round_even(high_risk_buildings / portfolio_size * 100, 1) AS high_risk_percentage,
       CASE WHEN avg_risk > market_avg THEN 'Above Market Average' ELSE 'Below Market Average' END AS performance,
       CASE WHEN high_risk_buildings > portfolio_size * 0.3
            THEN '⚠️  ' || CAST(high_risk_buildings AS VARCHAR) || ' buildings need immediate attention. Portfolio-wide review recommended.'
            WHEN avg_risk > 65 THEN 'Portfolio risk is elevated. Focus on preventive maintenance.'
            ELSE 'Portfolio health is acceptable. Continue monitoring.' END AS recommendation
FROM r""")
def q_portfolio_peer_ranking(spark, d):
    return P.portfolio_peer_ranking(_prepared(spark, d))


@query("peer_topn", f"""
WITH {BUILDINGS_SQL},
pr AS (SELECT t.property_id AS tid, t.cents AS tc, c.property_id AS cid, c.cents AS cc,
              CASE WHEN t.yk IS NULL OR c.yk IS NULL THEN 0.0::DOUBLE ELSE abs(c.yk - t.yk) / 15.0::DOUBLE END
              + CASE WHEN t.uk IS NULL OR c.uk IS NULL THEN 0.0::DOUBLE ELSE abs(c.uk - t.uk) / t.uk END
              + CASE WHEN t.building_class IS NOT DISTINCT FROM c.building_class THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END
                AS d
       FROM b t JOIN b c ON t.bl = c.bl AND t.bbl <> c.bbl
       WHERE (c.uk IS NULL OR t.uk IS NULL OR (c.uk / t.uk >= 0.7 AND c.uk / t.uk <= 1.3))
         AND (c.yk IS NULL OR t.yk IS NULL OR abs(c.yk - t.yk) <= 15)),
r AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY d, cid) AS rn FROM pr),
a AS (SELECT tid, count(*) AS peer_count, count(cc) AS ns, sum(cc) AS sc,
             count(*) FILTER (WHERE cc < tc) AS below FROM r WHERE rn <= 100 GROUP BY tid),
x AS (SELECT b.property_id, CAST(COALESCE(a.peer_count, 0) AS BIGINT) AS peer_count, a.ns, a.sc,
             CASE WHEN a.ns > 0 THEN round_even(a.below / a.ns * 100, 0) END AS percentile
      FROM b LEFT JOIN a ON a.tid = b.property_id WHERE b.cents IS NOT NULL)
SELECT property_id, peer_count, CASE WHEN ns > 0 THEN round_even(sc / ns / 100.0::DOUBLE, 1) END AS peer_average,
       percentile,
       CASE WHEN ns > 0 THEN CASE WHEN percentile < 50 THEN 'Top ' || CAST(CAST(percentile AS BIGINT) AS VARCHAR) || '%'
                                  ELSE 'Bottom ' || CAST(CAST(100 - percentile AS BIGINT) AS VARCHAR) || '%' END END
         AS ranking
FROM x""")
def q_peer_topn(spark, d):
    """The 100 most similar peers (age, size, class; same borough) and the
    building's standing among them."""
    return P.peer_topn(_prepared(spark, d), 100)
