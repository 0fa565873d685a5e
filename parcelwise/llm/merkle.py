"""Merkle manifest of a dataset by concatenated-level strings.

A leaf is the digest of one row.  The leaves of a group (a source) stand in order of doc_id;
every ``RUN`` consecutive nodes of a level make the next level's node until one is left, the
group's subroot; the subroots in order of source make the root in the same way.

An aligned block of ``BLOCK`` = RUN ** DEPTH leaves keeps each of its levels as one hex string:
the parents are the digests of its fixed-width substrings, and what flanks a node inside its
run's substring is its sibling segment.  Block roots are again the leaves of a tree, one
block row for BLOCK nodes, so the number of rounds is the logarithm of the input and a group
of any size is spread over its blocks.  A block holds at most BLOCK digests, so does a task's group.

Positions come from a range partitioning: rows are numbered inside (range, group), and a
group's ranges are offset by running sums over one count a range, so a source with a third of all rows
is numbered by many tasks.  Sibling segments go top-down, from the root to the blocks, joined on
(group, block), which is unique.

Defined cases: a null field is ``-`` in the leaf, so null and empty texts differ; rows without
doc_id are leaves too, before all others of their source, and are never tampered with; equal
doc_ids of a source are ordered by leaf digest, and rows that are equal throughout are leaves each; a lone
leaf is its own subroot and a lone subroot the root, with the digest of the empty string as
proof; whole texts of any length are digested; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from parcelwise.llm.common import saved, shuffle_partitions

RUN, DEPTH, HEX = 3, 5, 64
BLOCK = RUN ** DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_of(columns: dict[str, Column]) -> Column:
    return digest(F.concat(*[field(columns[c]) for c in FIELDS]))


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (grp, row, ...) with ``pos``, 0, 1, ... in each grp by ``order`` and ``row``, and ``n``, the rows of the grp.
    ``row`` is unique, so equal keys are numbered too, and no grp has to fit one task."""
    p = shuffle_partitions(rows.sparkSession)
    ranged = saved(rows.repartitionByRange(p, "grp", *order, "row").withColumn("part", F.spark_partition_id()), "ranged")
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)   # one row a range
    base = ranged.groupBy("grp", "part").count().select(
        "grp", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"),
        F.sum("count").over(Window.partitionBy("grp")).alias("n"))
    inside = Window.partitionBy("part", "grp").orderBy(*order, "row")
    return ranged.withColumn("inside", F.row_number().over(inside) - 1).join(base, ["part", "grp"]) \
        .withColumn("pos", F.col("base") + F.col("inside")).drop("inside", "base", "part", "row")


def parents(level: Column) -> Column:
    """The next level of a level string: a digest for each run, the last run may be shorter."""
    runs = F.ceil(F.length(level) / F.lit(RUN * HEX)).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), runs - 1),
                                    lambda i: digest(F.substring(level, i * (RUN * HEX) + 1, F.lit(RUN * HEX)))), "")


def blocks(nodes: DataFrame) -> DataFrame:
    """(grp, block, n, members, levels) of nodes (grp, pos, n, node, carried): the level strings of each aligned block.
    A group of one block stops at one node; a block of a longer group has all DEPTH levels above its nodes."""
    rows = nodes.groupBy("grp", F.expr(f"pos div {BLOCK}").alias("block")).agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "node", "carried"))).alias("members"))
    base = F.array(F.array_join(F.transform("members", lambda m: m["node"]), ""))

    def step(levels: Column, _: Column) -> Column:
        last = F.element_at(levels, -1)
        return F.when((F.col("n") > BLOCK) | (F.length(last) > HEX), F.concat(levels, F.array(parents(last)))).otherwise(levels)

    return rows.withColumn("levels", F.reduce(F.sequence(F.lit(1), F.lit(DEPTH)), base, step))


def raised(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of the nodes, then of their roots, until every group is one block."""
    stages = []
    while True:
        b = saved(blocks(nodes), "merkle_blocks")
        stages.append(b)
        upper = b.where(F.col("n") > BLOCK).select(
            "grp", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"),
            F.element_at("levels", -1).alias("node"), F.struct(F.lit(None).cast("long").alias("nothing")).alias("carried"))
        if upper.isEmpty():
            return stages
        nodes = upper


def roots(stages: list[DataFrame]) -> DataFrame:
    """(grp, node): the last node of each group."""
    tops = [s.where(F.col("n") <= BLOCK).select("grp", F.element_at("levels", -1).alias("node")) for s in stages]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def flanks(levels: Column, at: Column) -> Column:
    """The sibling segments of node ``at`` of a block, level by level: what stands left and right of it in its run."""
    def segment(k: Column) -> Column:
        node = F.floor(at / F.pow(F.lit(float(RUN)), k)).cast("int")
        run = F.floor(node / RUN).cast("int")
        start, off = run * (RUN * HEX), (node - run * RUN) * HEX
        level = F.element_at(levels, k + 1)
        return F.struct(F.substring(level, start + 1, off).alias("left"),
                        F.substring(level, start + off + HEX + 1, F.lit((RUN - 1) * HEX) - off).alias("right"))
    steps = F.size(levels) - 1
    return F.when(steps > 0, F.transform(F.sequence(F.lit(0), steps - 1), segment)).otherwise(F.array().cast(PATH))


def descend(stages: list[DataFrame], above: DataFrame) -> DataFrame:
    """(grp, pos, carried, path, ...) of all nodes of the lowest stage.  ``above``: (grp, path, ...) with the segments
    from each group's root on; its further columns go down to every node."""
    given = [c for c in above.columns if c not in ("grp", "path")]
    upper = None
    for i, stage in reversed(list(enumerate(stages))):
        parts = stage.where(F.col("n") <= BLOCK).join(above, "grp")
        if upper is not None:
            parts = parts.unionByName(stage.where(F.col("n") > BLOCK).join(upper.withColumnRenamed("pos", "block"), ["grp", "block"]))
        rows = parts.select("grp", *given, F.explode(F.transform("members", lambda m: F.struct(
            m["pos"].alias("pos"), m["carried"].alias("carried"),
            F.concat(flanks(F.col("levels"), (m["pos"] - F.col("block") * BLOCK).cast("int")), F.col("path")).alias("path")))).alias("x")) \
            .select("grp", *given, "x.pos", "x.carried", "x.path")
        if i == 0:
            return rows
        upper = saved(rows.drop("carried"), "merkle_paths")
    raise AssertionError("no stages")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its sibling segments give."""
    return F.reduce(path, leaf, lambda node, s: digest(F.concat(s["left"], node, s["right"])))


def proof(path: Column) -> Column:
    """The digest of all siblings, from the leaf's level to the root's, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, path (sibling segments), folded_root
    (from the row with its ``tampered`` columns and the original siblings) and verified (whether that is the root)."""
    own = {c: F.col(c) for c in FIELDS}
    rows = saved(docs.select(
        F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string"))).alias("grp"),
        F.col("doc_id").cast("long").alias("doc_id"), leaf_of(own).alias("node"), leaf_of(own | (tampered or {})).alias("altered"))
        .withColumn("row", F.monotonically_increasing_id()), "merkle_leaves")
    nodes = positions(rows, ["doc_id", "node"]) \
        .select("grp", "pos", "n", "node", F.struct("doc_id", "node", "altered").alias("carried"))
    stages = raised(nodes)
    subroots = saved(roots(stages).withColumn("row", F.monotonically_increasing_id()), "merkle_subroots")
    listed = positions(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("source"), "node", "row"), ["source"]) \
        .select("grp", "pos", "n", "node", F.struct("source", "node").alias("carried"))
    top = raised(listed)
    crown = roots(top).select("grp", F.col("node").alias("root"), F.array().cast(PATH).alias("path"))       # one row
    above = saved(descend(top, crown).select(F.col("carried.source").alias("grp"), F.col("carried.node").alias("subroot"), "root", "path"),
                  "merkle_above")
    out = descend(stages, above).select(
        "carried.doc_id", F.col("carried.node").alias("leaf"), "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "path",
        folded(F.col("carried.altered"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
