"""SimHash near-duplicates: pigeonhole blocks, exact verification, components.

A fingerprint has 64 bits; the bit is set if it is set in over half of the
XXH64 values (seed 42) of the text's word shingles, repeats included. Two
fingerprints link at ``distance`` (4) or fewer differing bits. Cut into 7 blocks,
such a pair agrees in at least 3, so every choice of 3 blocks is a key (35 keys
of 27 or 28 bits) and every link is found under one key at least. All pairs of a
key are verified by their Hamming distance; none is left out.

Scale: texts are read once, in the row; only (id, fingerprint) is kept, and
rows of equal fingerprints count as one from then on. Under a key the partition
is read as a sorted stream. Small groups compare all pairs; in larger ones a
search from each fingerprint to those still unreached ends early for a group of
near copies. A task emits a spanning forest of what it found, so a group never
yields more links than members. Groups beyond ``chunk`` fingerprints are cut into
chunks, and every pair of chunks becomes a group of its own with at most two
chunks, so a task holds a bounded number of fingerprints however hot a key is.
Components are found by rounds of star contraction in joins and aggregates; each
round is written to the shared folder, which cuts the lineage.

Edge cases: null and empty texts have fingerprint zero and link like any other;
a text of fewer words than a shingle is one shingle; repeated rows and ids are
kept as rows of the result; a component of null ids only has a null component;
an empty table gives no rows; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.common import ascii_lower_bytes, content_of
from docketry.session import work_folder

BITS = 64
BLOCKS = 7
DISTANCE = 4
SHINGLE = 4
SEED = 42
CHUNK = 20_000
SMALL_GROUP = 48
FOREST_NODES = 500_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = ascii_lower_bytes(text).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends[: len(words) - shingle]]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(
            (digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :])),
            np.uint64,
            len(starts),
        )
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over_half = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over_half, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    """As signed numbers with the same bits."""
    values = np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts))
    return pd.Series(values.view(np.int64))


def hex_digits(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Signed masks of every choice of the blocks that a linked pair shares."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


class Forest:
    """Union-find that tells which links are news; starts afresh when it grows large."""

    def __init__(self, most: int = FOREST_NODES):
        self.parent: dict[int, int] = {}
        self.most = most

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    def joins(self, a: int, b: int) -> bool:
        if len(self.parent) > self.most:
            self.parent.clear()
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def links_in_group(prints: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Star links of the connected parts of one group of distinct fingerprints."""
    left = prints
    while len(left) > 1:
        root, left = left[0], left[1:]
        reached = [root]
        while reached and len(left):
            near = np.bitwise_count(left ^ reached.pop()) <= distance
            if near.any():
                found, left = left[near], left[~near]
                reached.extend(found)
                yield np.full(len(found), root), found


def links_in_groups(
    keys: np.ndarray, prints: np.ndarray, distance: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links under each key; rows are sorted by key."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    for start, size in zip(starts[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP]):
        yield from links_in_group(np.unique(prints[start : start + size]), distance)
    small = np.repeat(sizes <= SMALL_GROUP, sizes) & np.repeat(sizes > 1, sizes)
    keys, prints = keys[small], prints[small]
    for step in range(1, SMALL_GROUP):
        same = np.flatnonzero(keys[step:] == keys[:-step])
        if not len(same):
            break
        near = same[np.bitwise_count(prints[same] ^ prints[same + step]) <= distance]
        yield prints[near], prints[near + step]


def verify_links(distance: int):
    """mapInArrow over (group, print), sorted by group: a forest of (a, b)."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()

        def found(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            news = [
                (a, b)
                for left, right in links_in_groups(keys, prints.view(np.uint64), distance)
                for a, b in zip(left.view(np.int64).tolist(), right.view(np.int64).tolist())
                if a != b and forest.joins(a, b)
            ]
            pairs = np.array(news, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"]
            )

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            keys, prints = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))
            if last == 0 and held and held[-1][0][-1] == keys[0]:
                held.append((keys, prints))  # the group goes on
                continue
            held.append((keys[:last], prints[:last]))
            yield found(*map(np.concatenate, zip(*held)))
            held = [(keys[last:], prints[last:])]
        if held:
            yield found(*map(np.concatenate, zip(*held)))

    return verify


def candidate_links(
    prints: DataFrame,
    distance: int = DISTANCE,
    blocks: int = BLOCKS,
    chunk: int = CHUNK,
) -> DataFrame:
    """(a, b): links that connect every component of the distinct ``print``s."""
    masks = block_masks(blocks, distance)
    keyed = (
        prints.select(
            "print",
            F.explode(
                F.array(
                    *(
                        F.xxhash64(F.lit(i), F.col("print").bitwiseAND(F.lit(m)))
                        for i, m in enumerate(masks)
                    )
                )
            ).alias("group"),
        )
        .repartition("group")
        .sortWithinPartitions("group", "print")
    )
    counted = keyed.selectExpr("*", "count(*) OVER (PARTITION BY group) AS members")
    pieces = F.ceil(F.col("members") / chunk).cast("int")
    mine = F.pmod(F.xxhash64(F.col("print")), pieces).cast("int")
    halves = (
        counted.where(F.col("members") > chunk)
        .withColumn("pieces", pieces)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .select(
            F.xxhash64("group", F.least("mine", "other"), F.greatest("mine", "other")).alias("group"),
            "print",
        )
        .repartition("group")
        .sortWithinPartitions("group", "print")
    )
    within = counted.where((F.col("members") > 1) & (F.col("members") <= chunk))
    verify = verify_links(distance)
    return (
        within.select("group", "print")
        .mapInArrow(verify, "a long, b long")
        .unionByName(halves.mapInArrow(verify, "a long, b long"))
    )


def star_components(links: DataFrame, purpose: str = "links") -> DataFrame:
    """(node, root) of every node with a link: stars around the smallest node.

    Alternates large stars (a node's larger neighbours move to its smallest
    neighbour) and small stars (so do its smaller ones) until nothing changes.
    """
    spark = links.sparkSession

    def written(frame: DataFrame) -> DataFrame:
        path = work_folder(spark, purpose)
        frame.write.parquet(path)
        return spark.read.parquet(path)

    def state(frame: DataFrame) -> tuple:
        return tuple(
            frame.agg(
                F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
            ).first()
        )

    # a > b: every link points to the smaller node
    edges = written(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b")
        .distinct()
    )
    before = None
    while (now := state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy(F.col("a").alias("at")).agg(F.least(F.min("b"), F.col("at")).alias("low"))
        large = (
            edges.select(F.col("b").alias("at"), F.col("a").alias("node"))
            .join(smallest, "at")
            .select(F.col("node").alias("a"), F.col("low").alias("b"))
            .unionByName(
                smallest.where("low < at").select(F.col("at").alias("a"), F.col("low").alias("b"))
            )
            .where("a <> b")
            .distinct()
        )
        large = written(large)
        lowest = large.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("low"))
        edges = written(
            large.select(F.col("a").alias("at"), F.col("b").alias("node"))
            .join(lowest, "at")
            .select(F.col("node").alias("a"), F.col("low").alias("b"))
            .unionByName(lowest.select(F.col("at").alias("a"), F.col("low").alias("b")))
            .where("a <> b")
            .distinct()
        )
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components(
    documents: DataFrame,
    key: str,
    text: str,
    carried: tuple[Column, ...] = (),
    distance: int = DISTANCE,
    blocks: int = BLOCKS,
    chunk: int = CHUNK,
) -> DataFrame:
    """(key, print, carried columns, root, component_id) of every row. ``root`` is the
    fingerprint that names a component, also one without ids."""
    spark = documents.sparkSession
    path = work_folder(spark, "fingerprints")
    documents.select(F.col(key), fingerprints(F.col(text)).alias("print"), *carried).write.parquet(path)
    printed = spark.read.parquet(path)
    nodes = printed.groupBy("print").agg(F.min(key).alias("least"))
    stars = star_components(candidate_links(nodes.select("print"), distance, blocks, chunk))
    linked = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
    rooted = nodes.join(linked, F.col("print") == F.col("node"), "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")
    )
    smallest = (
        rooted.join(stars.select("root").distinct(), "root", "left_semi")
        .groupBy(F.col("root").alias("of_root"))
        .agg(F.min("least").alias("component"))
    )
    named = rooted.join(smallest, F.col("root") == F.col("of_root"), "left").select(
        F.col("print").alias("of_print"), "root", F.coalesce("component", "least").alias("component_id")
    )
    return printed.join(named, F.col("print") == F.col("of_print")).drop("of_print")


def near_duplicates(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    distance: int = DISTANCE,
    blocks: int = BLOCKS,
    chunk: int = CHUNK,
) -> DataFrame:
    """(key, print, component_id) of every row."""
    return components(documents, key, text, (), distance, blocks, chunk).drop("root")


def drop_near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: one of the smallest id, null ids last.

    Of the rows that share this id the one of the smallest content hash stays, and
    of rows alike in all columns one. Decided by row: what other rows of the same id
    do in other components does not matter.
    """
    spark = documents.sparkSession
    content = content_of(*(F.col(f"`{c}`").cast("string") for c in documents.columns))
    chosen = (
        components(documents, key, text, (content.alias("content"),))
        .groupBy("root", "content")  # copies count as one before a component meets
        .agg(F.min(key).alias("id"), F.count(F.lit(1)).alias("copies"))
        .groupBy("root")
        .agg(F.min(F.struct(F.col("id").isNull(), "id", "content", "copies")).alias("first"))
        .select(F.col("first.content").alias("chosen"), "first.copies")
    )
    path = work_folder(spark, "near-duplicate-rows")
    chosen.write.parquet(path)
    chosen = spark.read.parquet(path)
    kept = documents.join(chosen.where("copies = 1"), content == F.col("chosen"), "left_semi")
    repeated = chosen.where("copies > 1")
    if repeated.isEmpty():
        return kept
    alike = documents.withColumn("chosen_content", content).join(
        repeated, F.col("chosen_content") == F.col("chosen"), "left_semi"
    )
    return kept.unionByName(alike.dropDuplicates(["chosen_content"]).drop("chosen_content"))
