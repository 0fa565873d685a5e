"""Connected components of a link table by alternating large-star and small-star steps.

Each step is an aggregate and a join on the vertex, so no vertex's neighbours are ever
gathered in one place, and each round is written to the shared folder.  The links read back
are the left side of a left join, which is never broadcast: their compressed files say little
about their rows in memory.  Each vertex has a smallest neighbour, so no row is without one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import saved


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())


def _to_smallest(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its neighbours v."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b): undirected links between long ids.  Returns (id, component) for
    every id that has a link to another one; component is the smallest id reachable."""
    edges = saved(links.where(F.col("a") != F.col("b"))
                  .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(_to_smallest(both), "u", "left").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = _to_smallest(large)
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                            F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = saved(small.where(F.col("u") != F.col("v")).distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")) \
        .unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
