"""Merkle manifest of a dataset: leaves, subroots, one root, and proofs.

A row is a leaf; the leaves of a group (a source) form a tree of sixteen-way
runs, and the subroots of all groups form the tree above them. Nothing holds a
whole tree. The places of a group's nodes are cut into aligned blocks of
``SPAN`` (two levels of runs), and a block keeps each of its levels as one hex
string: the nodes of a level, concatenated. A parent is the digest of a
fixed-width substring, and the siblings of a node are the two substrings that
flank it in its run. The blocks' roots are the nodes of the next tier, which is
cut in the same way, until every group has one node: a tier has 1/256 of the
rows of the one below, and a hot group only has more blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import stored

#: Nodes of a run (children of one parent), and of an aligned block.
ARITY, SPAN = 16, 256
#: Characters of a digest in hex, and of a full run of them.
HEX = 64
RUN = ARITY * HEX


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_of(*fields: Column) -> Column:
    """Digest of the fields: each ``-`` if null, else its byte count, ``:``
    and its value as text, so that no two rows spell the same."""
    def spelled(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return digest(F.concat(*map(spelled, fields)))


def group_key(group: Column) -> Column:
    """A key without nulls that orders null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("s"), group.cast("string")), F.lit(""))


def places(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``idx`` (place in its group from 0, by ``order``) and ``n``
    (rows of the group). Rows are range-partitioned once by group and order, so
    a hot group is many partitions; the offsets are one row per group and
    partition."""
    ranged = stored(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
                    .withColumn("at", F.monotonically_increasing_id()), name)
    ranged = ranged.withColumn("pid", F.shiftright("at", 33))
    part = ranged.groupBy(group, "pid").agg(F.count("*").alias("own"), F.min("at").alias("first"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(group, "pid", "first", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("skip"),
                       F.sum("own").over(whole).alias("n"))
    return (ranged.join(part, [group, "pid"])
            .withColumn("idx", F.col("at") - F.col("first") + F.col("skip")).drop("at", "pid", "first", "skip"))


def _piece(level: Column, run: Column) -> Column:
    return F.substring(level, run * RUN + 1, F.lit(RUN))


def _flanks(run: Column, at: Column) -> Column:
    """The siblings of node ``at`` of a run, as the two segments beside it."""
    return F.struct(F.substring(run, F.lit(1), at * HEX).alias("l"),
                    F.substring(run, at * HEX + HEX + 1, F.lit(RUN)).alias("r"))


def _blocks(nodes: DataFrame, group: str, carried: list[str]) -> DataFrame:
    """One row per aligned block of ``nodes(group, idx, n, hash)``: its rows,
    level strings ``l0`` and ``l1``, and ``top``, its root."""
    out = (nodes.withColumn("block", F.floor(F.col("idx") / SPAN))
           .groupBy(group, "block", "n")
           .agg(F.sort_array(F.collect_list(F.struct("idx", "hash", *carried))).alias("rows")))
    out = out.withColumn("l0", F.array_join(F.col("rows.hash"), ""))
    runs = F.sequence(F.lit(0), F.ceil(F.size("rows") / ARITY).cast("int") - 1)
    out = out.withColumn("l1", F.when(F.col("n") > 1, F.array_join(
        F.transform(runs, lambda r: digest(_piece(F.col("l0"), r))), "")))
    return out.withColumn("top", F.when(F.col("n") == 1, F.col("l0")).when(F.col("n") <= ARITY, F.col("l1"))
                          .otherwise(digest(F.col("l1"))))


def _paths(blocks: DataFrame, up: DataFrame | None, group: str, carried: list[str]) -> DataFrame:
    """``group, idx, hash, *carried, path, top`` of every node of ``blocks``:
    the flanking segments of each level up to the root of its group. ``up``:
    the same of the blocks themselves, None if each is its group's root."""
    if up is None:
        blocks = blocks.withColumn("path", F.array().cast("array<struct<l:string,r:string>>"))
    else:
        above = up.select(F.col(group), F.col("idx").alias("block"), "path", F.col("top").alias("above"))
        blocks = blocks.join(above, [group, "block"]).withColumn("top", F.col("above")).drop("above")
    node = blocks.select(group, "n", "l0", "l1", "path", "top", F.explode("rows").alias("row"))
    at = F.pmod(F.col("row.idx"), F.lit(SPAN)).cast("int")
    run = F.floor(at / ARITY).cast("int")
    low = _flanks(_piece(F.col("l0"), run), at % ARITY)
    own = (F.when(F.col("n") == 1, F.array().cast("array<struct<l:string,r:string>>"))
           .when(F.col("n") <= ARITY, F.array(low)).otherwise(F.array(low, _flanks(F.col("l1"), run))))
    return node.select(group, F.col("row.idx").alias("idx"), F.col("row.hash").alias("hash"),
                       *[F.col(f"row.{c}").alias(c) for c in carried], F.concat(own, "path").alias("path"), "top")


def tree(nodes: DataFrame, group: str, carried: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``group, idx, hash, *carried, path, top`` of ``nodes(group, idx, n,
    hash, *carried)``: each node's path and the root of its group's tree; and
    ``group, top``, one row per group."""
    tiers = []
    kept = carried
    while True:
        blocks = stored(_blocks(nodes, group, kept), f"{name}-{len(tiers)}", 16)
        tiers.append((blocks, kept))
        # One number: how many blocks the largest group has.
        most = blocks.agg(F.max(F.ceil(F.col("n") / SPAN))).first()[0]
        if not most or most == 1:
            break
        kept = []
        nodes = blocks.select(group, F.col("block").alias("idx"), F.ceil(F.col("n") / SPAN).alias("n"),
                              F.col("top").alias("hash"))
    up = None
    for blocks, kept in reversed(tiers):
        up = _paths(blocks, up, group, kept)
    return up, tiers[-1][0].select(group, "top")


def manifest(docs: DataFrame, fields=("doc_id", "source", "lang", "n_chars", "text"), order: str = "doc_id",
             group: str = "source", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``order``, ``leaf, subroot, root`` and
    ``proof``, an array of ``struct<l, r>``: at each level from the leaf to the
    root, the digests before and after the node in its run (both empty in a run
    of one). ``carry`` adds columns computed on the row.

    A leaf is ``leaf_of`` the ``fields``, null or not. Leaves of a group ascend
    by ``order`` (null first), equal ones by leaf; null is a group, and the
    first one. Repeated rows are a leaf each, interchangeable. An empty table
    gives an empty result; columns that are not named are not read.
    """
    carry = carry or {}
    leaves = docs.select(group_key(F.col(group)).alias("g_key"), F.col(order).alias("g_order"),
                         leaf_of(*[F.col(c) for c in fields]).alias("hash"),
                         *[c.alias(f"c_{n}") for n, c in carry.items()])
    # The last order key only splits rows that are equal in every other way.
    leaves = stored(leaves.withColumn("g_tie", F.monotonically_increasing_id()), "leaves")
    own = ["g_order", *[f"c_{n}" for n in carry]]
    placed = places(leaves, "g_key", ["g_order", "hash", "g_tie"], "placed").drop("g_tie")
    low, roots = tree(placed, "g_key", own, "tree")
    # A group's subroot is a leaf of the tree above.
    subroots = roots.select(F.lit("").alias("all"), F.col("g_key").alias("o_key"), F.col("top").alias("hash"))
    high, _ = tree(places(subroots, "all", ["o_key"], "groups"), "all", ["o_key"], "top")
    high = high.select(F.col("o_key").alias("g_key"), F.col("path").alias("high"), F.col("top").alias("root"))
    return low.join(high, "g_key").select(
        F.col("g_order").alias(order), F.col("hash").alias("leaf"), F.col("top").alias("subroot"), "root",
        F.concat("path", "high").alias("proof"), *[F.col(f"c_{n}").alias(n) for n in carry])


def siblings(proof: Column) -> Column:
    """The siblings' digests of a proof, left to right, level by level."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["l"], s["r"])), "")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``proof`` make."""
    return F.aggregate(proof, leaf, lambda h, s: digest(F.concat(s["l"], h, s["r"])))
