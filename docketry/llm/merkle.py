"""Merkle manifest: hash trees over a dataset, proofs by a butterfly exchange.

Every row is a leaf. The leaves of a tree (a source) ascend by key; while several
nodes remain, every ``fanout`` consecutive ones become the hash of their hashes.
The roots of the trees are the leaves of one tree above them.

Leaves are placed by a range exchange and counts of its partitions, then cut into
aligned blocks of ``fanout ** levels`` leaves, each hashed up to its own root. The
blocks then swap roots in rounds, as in a butterfly: in round r a block meets those
that differ from it in digit r of the block number only, each bringing the root of
its own ancestor; all of them hash the next ancestor for themselves and note the
siblings. After the last round every block holds the tree's root and the siblings
of all levels above it: there is no second pass downwards.

Scale: a group of the exchange has ``fanout`` rows, a block at most
``fanout ** levels`` leaves, whatever the size of a tree; a tree with a third of
all rows is many blocks. A round moves one row for each block. Texts are read once
and never shuffled: what moves are digests. Rounds: the logarithm of the blocks of
the largest tree.

Edge cases: null fields count as ``-``; a null tree is a tree of its own, before
all others; null keys come first; rows of equal keys stand in the order of their
leaves, so rows that repeat are leaves of their own, in places that nothing tells
apart; a lone leaf is its tree's root; an empty table gives no rows; other columns
may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.session import work_folder

FANOUT = 3
LEVELS = 5
STEP = "struct<before:string,after:string>"


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of UTF-8 text."""
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return digest(F.concat(*map(field, values)))


def joined(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def proof_of(path: Column) -> Column:
    """The hash of all siblings, level by level, left to right."""
    return digest(joined(F.transform(path, lambda step: F.concat(step["before"], step["after"]))))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda node, step: digest(F.concat(step["before"], node, step["after"])))


def placed(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Adds ``place`` (from 0, within the tree) and ``leaves`` (of the tree).

    ``rows`` must be a stored table: its row numbers spread equal rows over
    partitions. Only one count for each partition and tree meets in a task.
    """
    spark = rows.sparkSession
    path = work_folder(spark, "merkle-order")
    spread = rows.select("*", F.col("_metadata.row_index").alias("row_number"))
    keys = [tree, *order, "row_number"]
    (
        spread.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("line", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("line", 33))
        .drop("row_number")
        .write.parquet(path)
    )
    ordered = spark.read.parquet(path)
    parts = ordered.groupBy("part", tree).agg(F.min("line").alias("first_line"), F.count("*").alias("held"))
    whole = Window.partitionBy(tree)
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        F.col("part").alias("of_part"),
        F.col(tree).alias("of_tree"),
        (F.coalesce(F.sum("held").over(earlier), F.lit(0)) - F.col("first_line")).alias("shift"),
        F.sum("held").over(whole).alias("leaves"),
    )
    same = (F.col("part") == F.col("of_part")) & (F.col(tree) == F.col("of_tree"))
    return (
        ordered.join(starts, same)
        .withColumn("place", F.col("line") + F.col("shift"))
        .drop("part", "line", "of_part", "of_tree", "shift")
    )


def height(leaves: Column, fanout: int) -> Column:
    """Levels above ``leaves`` leaves; by comparison, so no rounding of logarithms."""
    powers = [fanout**i for i in range(1, 63) if fanout**i < 1 << 62]
    return F.size(F.filter(F.lit([1, *powers]), lambda power: power < leaves))


def hashed_up(level: Column, fanout: int) -> Column:
    """The level above, a hash for each run of ``fanout`` nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / fanout).cast("int"))
    return F.transform(runs, lambda run: digest(joined(F.slice(level, run * fanout + 1, F.lit(fanout)))))


def block_path(levels: Column, place: Column, fanout: int) -> Column:
    """The steps of a leaf from its place in the block to the block's root."""

    def step(nodes: Column, level: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(fanout), level)).cast("int")
        turn = at % fanout
        return F.struct(
            joined(F.slice(nodes, at - turn + 1, turn)).alias("before"),
            joined(F.slice(nodes, at + 2, fanout - 1 - turn)).alias("after"),
        )

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), step)


def swapped(blocks: DataFrame, round_: int, fanout: int) -> DataFrame:
    """One round of the exchange over (tree, block, blocks, node, path).

    A block deals its node to the group of its lower digits. The last subtree may
    be short of blocks; those it has then also deal to the groups of the missing.
    """
    span, wide = fanout**round_, fanout ** (round_ + 1)
    taking = F.col("blocks") > span
    below = F.col("block") % span
    whole = F.floor(F.col("block") / span)
    held = F.least(F.lit(span), F.col("blocks") - whole * span)
    dealt = blocks.where(taking).select(
        "tree",
        "block",
        "blocks",
        "node",
        "path",
        below.alias("below"),
        F.floor(F.col("block") / wide).alias("group"),
        (whole % fanout).alias("turn"),
        F.explode(F.sequence(below, F.lit(span - 1).cast("long"), held)).alias("towards"),
    )
    met = dealt.groupBy("tree", "group", "towards", "blocks").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "turn",
                    "node",
                    F.when(F.col("towards") == F.col("below"), F.struct("block", "path")).alias("own"),
                )
            )
        ).alias("members")
    )

    def nodes(keep) -> Column:
        return joined(F.transform(F.filter("members", keep), lambda m: m["node"]))

    def gone_up(member: Column) -> Column:
        step = F.struct(
            nodes(lambda m: m["turn"] < member["turn"]).alias("before"),
            nodes(lambda m: m["turn"] > member["turn"]).alias("after"),
        )
        return F.struct(
            member["own"]["block"].alias("block"), F.concat(member["own"]["path"], F.array(step)).alias("path")
        )

    mine = F.transform(F.filter("members", lambda m: m["own"].isNotNull()), gone_up)
    above = met.select(
        "tree", "blocks", digest(nodes(lambda m: F.lit(True))).alias("node"), F.inline(mine)
    ).select("tree", "block", "blocks", "node", "path")
    return above.unionByName(blocks.where(~taking))


def grown(rows: DataFrame, tree: str, order: list[str], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(tree, root, path, and the columns of ``rows``): every leaf's way to the root
    of its own tree. ``rows``: a stored table with ``leaf``; ``tree`` is never null.
    """
    spark = rows.sparkSession
    size = fanout**levels
    carried = [c for c in rows.columns if c != tree]
    path = work_folder(spark, "merkle-blocks")
    level = F.aggregate(
        F.sequence(F.lit(0), F.least(F.lit(levels), height(F.col("leaves"), fanout))),
        F.array(F.transform("members", lambda m: m["leaf"])),
        lambda done, i: F.when(i == 0, done).otherwise(
            F.concat(done, F.array(hashed_up(F.element_at(done, -1), fanout)))
        ),
    )
    (
        placed(rows, tree, order)
        .groupBy(F.col(tree).alias("tree"), F.floor(F.col("place") / size).alias("block"), "leaves")
        .agg(F.array_sort(F.collect_list(F.struct("place", *carried))).alias("members"))
        .withColumn("levels", level)
        .write.parquet(path)
    )
    blocks = spark.read.parquet(path)
    tops = blocks.select(
        "tree",
        "block",
        F.ceil(F.col("leaves") / size).alias("blocks"),
        F.element_at("levels", -1)[0].alias("node"),
        F.array().cast(f"array<{STEP}>").alias("path"),
    )
    most = tops.agg(F.max("blocks")).first()[0] or 0
    round_ = 0
    while fanout**round_ < most:
        tops = swapped(tops, round_, fanout)
        round_ += 1
    ends = tops.select(
        F.col("tree").alias("of_tree"), F.col("block").alias("of_block"), "node", F.col("path").alias("upper")
    )
    same = (F.col("tree") == F.col("of_tree")) & (F.col("block") == F.col("of_block"))
    return blocks.join(ends, same).select(
        "tree", "levels", "members", F.col("node").alias("root"), F.col("upper").alias("above")
    )


def leaves_of(blocks: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """One row for each leaf of ``grown`` blocks: tree, root, its columns and its path."""
    kept = [c for c in blocks.columns if c not in ("levels", "members", "above")]
    one = blocks.select(*kept, "levels", "above", F.explode("members").alias("member"))
    inside = (F.col("member.place") % fanout**levels).cast("int")
    return one.select(
        *kept, "member.*", F.concat(block_path(F.col("levels"), inside, fanout), F.col("above")).alias("path")
    )


def manifest(
    documents: DataFrame,
    leaf: Column,
    tree: str = "source",
    key: str = "doc_id",
    carry: dict[str, Column] | None = None,
    fanout: int = FANOUT,
    levels: int = LEVELS,
) -> DataFrame:
    """(key, tree, leaf, place, subroot, root, path, carried columns) of every row.

    ``path`` has the siblings of every level from the leaf to the root of all trees;
    ``folded(leaf, path)`` gives that root. ``carry``: columns to take along.
    """
    spark = documents.sparkSession
    named = {f"carried_{i}": c for i, c in enumerate((carry or {}).values())}
    stored = work_folder(spark, "merkle-leaves")
    documents.select(
        # "" for null, so that null comes first and joins need no null-safe test
        F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("")).alias("tree"),
        F.col(key).alias("key"),
        leaf.alias("leaf"),
        *(c.alias(n) for n, c in named.items()),
    ).write.parquet(stored)
    blocks = grown(spark.read.parquet(stored), "tree", ["key", "leaf"], fanout, levels)
    kept = work_folder(spark, "merkle-roots")
    blocks.write.parquet(kept)
    blocks = spark.read.parquet(kept)
    roots = work_folder(spark, "merkle-subroots")
    blocks.groupBy("tree").agg(F.min("root").alias("leaf")).select(
        F.lit("").alias("all"), F.col("tree").alias("name"), "leaf"
    ).write.parquet(roots)
    upper = leaves_of(grown(spark.read.parquet(roots), "all", ["name"], fanout, levels), fanout, levels).select(
        F.col("name").alias("of_name"), F.col("root").alias("whole"), F.col("path").alias("rest")
    )
    joint = blocks.join(upper, F.col("tree") == F.col("of_name")).select(
        "tree", F.col("root").alias("subroot"), "whole", "levels", "members", F.concat("above", "rest").alias("above")
    )
    return leaves_of(joint, fanout, levels).select(
        F.col("key").alias(key),
        F.when(F.col("tree") != "", F.substr("tree", F.lit(2))).alias(tree),
        "leaf",
        "place",
        "subroot",
        F.col("whole").alias("root"),
        "path",
        *(F.col(n).alias(c) for n, c in zip(named, carry or {})),
    )
