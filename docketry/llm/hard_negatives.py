"""Hard-negative mining: exact inner-product search by coordinate pruning.

An anchor's positives are the rows of its label that score highest with it; its
negatives for a positive are the highest rows of other labels whose score lies in
a range set by the positive's score. Both are searched in the manner of LEMP: all
rows fall into buckets by their length, long buckets into units of bounded size. A
unit holds a sorted list of values for every coordinate of its unit-length rows.
An anchor that must reach a score s there needs a cosine of at least
s / (its length x the unit's greatest length), and that leaves on each of its focus
coordinates (those of its largest values) a range of feasible values only. The
ranges are looked up in the sorted lists, their row sets intersected, and what is
left is verified by exact products of whole numbers. The score to reach is raised
by what the unit's first rows give.

Scale: the anchors meet all rows, in units: a stated query set. Anchors are dealt
to every unit and stream through it; a task holds one unit (``unit_rows`` rows)
and one batch of anchors. Each unit gives at most as many rows for an anchor as
are asked for, and ranks are cut in each task before they are shuffled. No cap on
candidates: pruned are only rows that cannot reach the score.

Edge cases: rows with a null label, id or vector, with a null or non-finite
component, or with one whose whole number would be beyond 2**22 (scores could
leave 64 bits) take no part; of rows that repeat an id one takes part, the smallest
by label and vector; missing components of shorter vectors count as zero; equal
scores are ordered by id; zero vectors score 0 with everything; an anchor without
another row of its label, or a positive without rows in range, gives no rows; an
empty table gives none; other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.session import work_folder

UNIT_ROWS = 4096
FOCUS = 4
SEEDS = 256
LENGTH_STEP = 1.25
LARGEST = 1 << 22
# Widens ranges of feasible values by far more than rounding can move them.
SLACK = 1e-9
MOST_TASKS = 10_000
TARGETS = "array<struct<name:long,score:long,lowest:long,highest:long>>"

COLUMNS = ["anchor", "target", "target_score", "other", "score"]
FOUND = ", ".join(f"{c} long" for c in COLUMNS)


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x), x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def prepared(rows: DataFrame, key: str, label: Column, vector: str, scale: int) -> DataFrame:
    """(id, label, vector) of the rows that take part, one for each id."""
    scaled = F.transform(vector, lambda x: x.cast("double") * scale)
    fits = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    return (
        rows.select(
            F.col(key).cast("long").alias("id"),
            label.cast("long").alias("label"),
            F.when(fits, whole_numbers(F.col(vector), scale)).alias("vector"),
        )
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
        .groupBy("id")
        .agg(F.min(F.struct("label", "vector")).alias("row"))
        .select("id", "row.*")
    )


def in_units(rows: DataFrame, unit_rows: int) -> DataFrame:
    """The rows with their ``unit``, numbered from 0.

    A unit is a part of a bucket of lengths. The buckets, few by their logarithmic
    width, are counted first, and long ones dealt to several units by hash.
    """
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x))
    bucket = F.when(length > 0, F.floor(F.log(length) / math.log(LENGTH_STEP))).otherwise(-1)
    bucketed = rows.withColumn("bucket", bucket.cast("long"))
    before = Window.orderBy("of_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        bucketed.groupBy(F.col("bucket").alias("of_bucket"))
        .agg(F.ceil(F.count("*") / unit_rows).alias("units"))
        .withColumn("first", F.coalesce(F.sum("units").over(before), F.lit(0)))
    )
    return bucketed.join(F.broadcast(starts), F.col("bucket") == F.col("of_bucket")).select(
        (F.col("first") + F.pmod(F.xxhash64("id"), "units")).alias("unit"), "id", "label", "vector"
    )


def length_of(vector: np.ndarray) -> float:
    return math.sqrt(float(np.square(vector, dtype=np.float64).sum()))


class Unit:
    """Rows of similar length with a sorted list for each coordinate."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: list[np.ndarray]):
        width = max(map(len, vectors), default=0)
        self.whole = np.zeros((len(ids), width), np.int64)
        for row, vector in enumerate(vectors):
            self.whole[row, : len(vector)] = vector
        self.values = self.whole.astype(np.float64)
        lengths = np.sqrt(np.einsum("ij,ij->i", self.values, self.values))
        # Longest first: the rows that seed a score to reach.
        order = np.lexsort((ids, -lengths))
        self.ids, self.labels = ids[order], labels[order]
        self.whole, self.values, lengths = self.whole[order], self.values[order], lengths[order]
        self.longest = float(lengths[0]) if len(lengths) else 0.0
        unit = np.divide(self.values, lengths[:, None], out=np.zeros_like(self.values), where=lengths[:, None] > 0)
        self.order = np.argsort(unit, axis=0, kind="stable")
        self.lists = np.take_along_axis(unit, self.order, axis=0)
        self.ranks = np.empty_like(self.order)
        np.put_along_axis(self.ranks, self.order, np.arange(len(ids))[:, None], axis=0)

    def scores(self, anchor: np.ndarray, rows: np.ndarray | slice) -> np.ndarray:
        anchor = anchor[: self.whole.shape[1]]
        if length_of(anchor) * self.longest < 2**52:  # sums of doubles are exact below 2**53
            return (self.values[rows, : len(anchor)] @ anchor.astype(np.float64)).astype(np.int64)
        return self.whole[rows, : len(anchor)] @ anchor

    def candidates(self, anchor: np.ndarray, lowest: int) -> np.ndarray | slice:
        """Rows whose score may be ``lowest`` or more: feasible on all focus coordinates."""
        width = min(len(anchor), self.whole.shape[1])
        length = length_of(anchor)
        if lowest <= 0:
            return slice(None)
        if not width or not length or not self.longest:
            return slice(0, 0)
        needed = lowest / (length * self.longest) - SLACK
        if needed > 1:
            return slice(0, 0)
        angle = math.acos(max(needed, -1.0))
        ranges = []
        for axis in np.argsort(-np.abs(anchor[:width]), kind="stable")[:FOCUS]:
            own = math.acos(max(-1.0, min(1.0, anchor[axis] / length)))
            least, most = math.cos(min(math.pi, own + angle)), math.cos(max(0.0, own - angle))
            values = self.lists[:, axis]
            low = int(np.searchsorted(values, least - SLACK, "left"))
            high = int(np.searchsorted(values, most + SLACK, "right"))
            ranges.append((high - low, low, high, axis))
        size, low, high, axis = min(ranges)
        if size == len(self.ids):
            return slice(None)
        rows = self.order[low:high, axis]
        for _, low, high, other in ranges:
            if other != axis and len(rows):
                rank = self.ranks[rows, other]
                rows = rows[(rank >= low) & (rank < high)]
        return rows

    def best(self, scores: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
        """The places of the first ``most`` by score, then id."""
        if len(rows) > most:
            floor = np.partition(scores, len(rows) - most)[len(rows) - most]
            kept = np.flatnonzero(scores >= floor)
        else:
            kept = np.arange(len(rows))
        return kept[np.lexsort((self.ids[rows[kept]], -scores[kept]))][:most]

    def search(self, anchor, own_id, own_label, targets, same: bool, most: int):
        """Of every target (name, score, lowest, highest): (rows, scores) of the first ``most``.

        ``same``: rows of the anchor's label, else those of the others.
        """

        def fitting(rows):
            labels = self.labels[rows]
            return (labels == own_label) & (self.ids[rows] != own_id) if same else labels != own_label

        everyone = np.arange(len(self.ids))
        first = everyone[fitting(slice(None))][:SEEDS] if same else everyone[:SEEDS][fitting(slice(0, SEEDS))]
        seeds = self.scores(anchor, first)
        floors = []
        for _, _, lowest, highest in targets:
            inside = seeds[(seeds >= lowest) & (seeds <= highest)]
            floors.append(int(np.partition(inside, len(inside) - most)[len(inside) - most]) if len(inside) >= most else lowest)
        rows = self.candidates(anchor, min(floors))
        rows = everyone[rows] if isinstance(rows, slice) else rows
        rows = rows[fitting(rows)]
        scores = self.scores(anchor, rows)
        for (name, score, _, highest), lowest in zip(targets, floors):
            held = np.flatnonzero((scores >= lowest) & (scores <= highest))
            kept = held[self.best(scores[held], rows[held], most)]
            yield name, score, rows[kept], scores[kept]


def numbers(vectors: pa.ListArray, row: int) -> np.ndarray:
    return vectors[row].values.to_numpy()


def searching(same: bool, most: int):
    """mapInArrow over rows sorted by (unit, kind): a unit's rows, then its anchors."""

    def answered(unit: Unit, batch: pa.RecordBatch, rows: range) -> pa.RecordBatch | None:
        out = []
        ids, labels, targets = (batch.column(c).to_pylist() for c in ("id", "label", "targets"))
        for row in rows:
            asked = [tuple(t.values()) for t in targets[row]]
            anchor = numbers(batch.column("vector"), row)
            for name, score, found, scores in unit.search(anchor, ids[row], labels[row], asked, same, most):
                one = np.empty((5, len(found)), np.int64)
                one[:] = np.array([[ids[row]], [name], [score], [0], [0]])
                one[3], one[4] = unit.ids[found], scores
                out.append(one)
        if out:
            return pa.RecordBatch.from_arrays([*map(pa.array, np.concatenate(out, axis=1))], names=COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, unit, ids, labels, vectors = None, None, [], [], []
        for batch in batches:
            units = batch.column("unit").to_numpy()
            kinds = batch.column("kind").to_numpy()
            edges = np.flatnonzero((np.diff(units) != 0) | (np.diff(kinds) != 0)) + 1
            for start, end in zip([0, *edges], [*edges, len(units)]):
                if start == end:
                    continue
                if units[start] != current:
                    current, unit, ids, labels, vectors = units[start], None, [], [], []
                if kinds[start] == 0:
                    ids.append(batch.column("id").to_numpy()[start:end])
                    labels.append(batch.column("label").to_numpy()[start:end])
                    vectors += [numbers(batch.column("vector"), row) for row in range(start, end)]
                    continue
                if unit is None:
                    unit = Unit(np.concatenate(ids), np.concatenate(labels), vectors)
                    ids, labels, vectors = [], [], []
                found = answered(unit, batch, range(start, end))
                if found is not None:
                    yield found

    return run


def dealt_to_units(anchors: DataFrame, held: DataFrame, units: int) -> DataFrame:
    """Every unit's rows, then all anchors, in the partition of the unit."""
    nothing = F.array().cast(TARGETS)
    rows = held.select("unit", F.lit(0).alias("kind"), "id", "label", "vector", nothing.alias("targets"))
    asked = anchors.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(units - 1).cast("long"))).alias("unit"),
        F.lit(1).alias("kind"),
        "id",
        "label",
        "vector",
        "targets",
    )
    return (
        rows.unionByName(asked)
        .repartition(min(2 * units, MOST_TASKS), "unit")
        .sortWithinPartitions("unit", "kind")
    )


def searched(anchors: DataFrame, held: DataFrame, units: int, same: bool, most: int) -> DataFrame:
    """The first ``most`` (anchor, target, target_score, other, score), with their ``place``.

    ``anchors``: (id, label, vector, targets); a target is a range of scores.
    """
    found = dealt_to_units(anchors, held, units).mapInArrow(searching(same, most), FOUND)
    order = Window.partitionBy("anchor", "target").orderBy(F.desc("score"), "other")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def hundredths(part: int, score: Column) -> Column:
    """part * score / 100, rounded down."""
    scaled = F.lit(part) * score
    return F.call_function("div", scaled - F.pmod(scaled, F.lit(100)), F.lit(100))


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    label: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 10,
    lowest: int = 30,
    highest: int = 90,
    unit_rows: int = UNIT_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors``: which rows, by their own columns, are anchors. A negative's score
    is between ``lowest`` and ``highest`` percent of the positive's.
    """
    spark = rows.sparkSession
    chosen = rows.where(anchors & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("anchor_key"))
    path = work_folder(spark, "negatives-units")
    in_units(prepared(rows, key, label, vector, scale), unit_rows).write.parquet(path)
    held = spark.read.parquet(path)
    units = (held.agg(F.max("unit")).first()[0] or 0) + 1
    asking = held.join(chosen.distinct(), F.col("id") == F.col("anchor_key"), "left_semi").drop("unit")
    any_score = F.array(
        F.struct(
            F.lit(0).cast("long").alias("name"),
            F.lit(0).cast("long").alias("score"),
            F.lit(-(1 << 62)).alias("lowest"),
            F.lit(1 << 62).alias("highest"),
        )
    )
    liked = searched(asking.withColumn("targets", any_score), held, units, True, positives)
    ranges = (
        liked.select(
            "anchor",
            F.struct(
                F.col("other").alias("name"),
                "score",
                (-hundredths(lowest, -F.col("score"))).alias("lowest"),
                hundredths(highest, F.col("score")).alias("highest"),
            ).alias("target"),
        )
        .where("target.lowest <= target.highest")
        .groupBy("anchor")
        .agg(F.collect_list("target").alias("targets"))
    )
    targeted = asking.join(ranges, F.col("id") == F.col("anchor")).drop("anchor")
    return searched(targeted, held, units, False, negatives).select(
        F.col("anchor").alias("anchor_id"),
        F.col("target").alias("positive_id"),
        F.col("place").cast("int").alias("rank"),
        F.col("other").alias("negative_id"),
        F.col("target_score").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
