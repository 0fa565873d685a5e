"""Mixing sources to target weights by hierarchical budgeting.

Documents hang on a tree domain - language - source.  A token budget goes down the tree: a
node's budget is split among its children by weight, and no child gets more than its
capacity (its tokens times the epochs allowed).  What a child cannot use goes to its
siblings, by weight again, until they are full; only what a whole family cannot use is
missing at its parent, where the same rule hands it to the parent's siblings.  Since a node
never gets more than its own capacity, going down once settles it.  The split of a family is
found in closed form: children ordered by capacity over weight fill up one after another,
until the budget left per weight no longer fills the next one.

A leaf takes whole epochs while its budget covers all its tokens, then a prefix of one more
epoch: documents in the order of a seeded digest of (seed, epoch, doc_id), up to the one
that reaches the quota.  The prefix is found without sorting a leaf: tokens are summed by
(leaf, epoch, first four hex digits of the digest), running sums over at most 256 first
pairs of digits and over the 256 second pairs of each find the one where the quota ends, earlier ones are taken whole, and only the
documents of that one are ordered.

All budgets are integers, so the result does not depend on the order of evaluation.

Defined cases: a null or empty text has 0 tokens; null lang and source become ``unknown``;
a leaf without tokens gives none,
other documents without tokens go by their place in the order; rows without doc_id take no part; repeated rows are counted and decided one by
one and share one place in the order; an empty table gives an empty result; weights that
are not given are the default of their level.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from parcelwise.llm.common import saved

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mixture:
    """Weights by level (``*``: any other name), budget as a share of all tokens, epochs a leaf may give at most."""

    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    numerator: int = 1
    denominator: int = 2
    epochs: int = 2
    seed: str = "mix"


LEVELS = ("domain", "lang", "source")


def weight(mix: Mixture, level: str) -> Column:
    given = mix.weights.get(level, {})
    out = F.lit(given.get("*", 1))
    for name, w in given.items():
        if name != "*":
            out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def split(nodes: DataFrame, family: list[str], name: str) -> DataFrame:
    """Split ``budget`` (the family's, on each child) by ``w`` up to ``capacity``: adds ``given``."""
    order = Window.partitionBy(*family).orderBy((F.col("capacity") / F.col("w")).asc(), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    spent, heavy = F.coalesce(F.sum("capacity").over(before), F.lit(0)), F.sum("w").over(after)
    n = nodes.withColumn("spent", spent).withColumn("heavy", heavy)
    n = n.withColumn("full", F.col("capacity") * F.col("heavy") <= F.col("w") * (F.col("budget") - F.col("spent")))
    n = n.withColumn("open", F.when(~F.col("full"), F.struct("spent", "heavy")))
    first = F.first("open", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    n = n.withColumn("cut", first)
    share = F.expr("w * (budget - cut.spent) div cut.heavy")
    return n.withColumn("given", F.when(F.col("full"), F.col("capacity")).otherwise(share)) \
        .drop("spent", "heavy", "full", "open", "cut")


def budgets(leaves: DataFrame, mix: Mixture) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with ``given``: the tokens each leaf is to provide."""
    capacity = leaves.withColumn("capacity", F.col("tokens") * mix.epochs)
    above = None
    for i, level in enumerate(LEVELS):
        path = list(LEVELS[:i + 1])
        nodes = capacity.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens")) \
            .withColumn("w", weight(mix, level))
        if above is None:      # the domains are one family; its budget is the root's
            root = Window.partitionBy(F.lit(0))
            wanted = F.expr(f"all_tokens * {int(mix.numerator)} div {int(mix.denominator)}")
            nodes = nodes.withColumn("root", F.lit(0)).withColumn("all_tokens", F.sum("tokens").over(root)) \
                .withColumn("budget", F.least(wanted, F.sum("capacity").over(root)))
            above = split(nodes, ["root"], level)
        else:
            nodes = nodes.join(above, path[:-1])
            above = split(nodes, path[:-1], level)
        above = above.select(*path, F.col("given").alias("budget"))
    return leaves.join(above.withColumnRenamed("budget", "given"), list(LEVELS))


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, mixture: Mixture, domain: Column) -> DataFrame:
    """One row per document: doc_id, domain, lang, source, n_tokens, epochs (how often it is
    taken, the document that reaches a quota included) and taken_tokens (the quota cuts that one)."""
    named = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    rows = saved(docs.where(F.col("doc_id").isNotNull())
                 .select(F.col("doc_id").cast("long").alias("doc_id"), named(domain).alias("domain"), named(F.col("lang")).alias("lang"),
                         named(F.col("source")).alias("source"), token_count(F.col("text")).alias("n_tokens")), "mix_rows")
    leaf = list(LEVELS)
    leaves = rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"))
    quota = budgets(leaves, mixture).select(
        *leaf, F.when(F.col("tokens") > 0, F.expr("given div tokens")).otherwise(0).alias("whole"),
        F.when(F.col("tokens") > 0, F.expr("given % tokens")).otherwise(0).alias("part"))
    quota = saved(quota, "mix_quota")
    # the order of the epoch after the whole ones
    keyed = rows.join(quota.select(*leaf, "whole"), leaf) \
        .withColumn("place", F.md5(F.concat_ws(":", F.lit(mixture.seed), F.col("whole"), F.col("doc_id")).cast("binary"))) \
        .withColumn("slot", F.substring("place", 1, 4))
    keyed = saved(keyed, "mix_places")
    two = F.substring("slot", 1, 2).alias("two")
    slots = keyed.groupBy(*leaf, two, "slot").agg(F.sum("n_tokens").alias("tokens"))
    running = lambda by, order: F.coalesce(F.sum("tokens").over(
        Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = slots.groupBy(*leaf, "two").agg(F.sum("tokens").alias("tokens")) \
        .select(*leaf, "two", running(leaf, "two").alias("base"))             # at most 256 rows of a leaf in a window
    slots = slots.withColumn("ahead", running([*leaf, "two"], "slot")).join(coarse, [*leaf, "two"]) \
        .withColumn("ahead", F.col("ahead") + F.col("base")).join(quota.select(*leaf, "part"), leaf)
    # by merge: the files of ``keyed`` are far smaller than its rows in memory, on which Spark would broadcast it
    slots = slots.select(*leaf, "slot", "ahead", "part", F.col("tokens").alias("slot_tokens")).hint("merge")
    placed = keyed.join(slots, [*leaf, "slot"])
    # slots that end before the quota are taken, slots that begin at or after it are not, the one between is cut
    inside = (F.col("ahead") < F.col("part")) & (F.col("ahead") + F.col("slot_tokens") >= F.col("part"))
    cut = placed.where(inside)
    cut = cut.withColumn("start", F.col("ahead") + F.sum("n_tokens").over(
        Window.partitionBy(*leaf).orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow))
        - F.sum("n_tokens").over(Window.partitionBy(*leaf, "place")))
    rest = placed.where(~inside).withColumn("start", F.when(F.col("ahead") < F.col("part"), F.lit(-(1 << 62))).otherwise(F.col("part")))
    both = rest.unionByName(cut)
    last = F.greatest(F.lit(0), F.least("n_tokens", F.col("part") - F.col("start")))
    return both.select("doc_id", *leaf, "n_tokens",
                       (F.col("whole") + F.when(F.col("start") < F.col("part"), 1).otherwise(0)).cast("long").alias("epochs"),
                       (F.col("whole") * F.col("n_tokens") + last).cast("long").alias("taken_tokens"))
