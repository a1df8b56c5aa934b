import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm import hard_negatives as H

ROW = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
    ]
)


def brute(rows, every=10, positives=5, negatives=10):
    held = {}
    for id_, vector, label in rows:
        if id_ is None or vector is None or label is None:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(256 * float(np.float32(x))) for x in vector]
        held[id_] = min(held.get(id_, (label, whole)), (label, whole))
    out = []
    for a, (label, x) in held.items():
        if a % every:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), b, other == label) for b, (other, y) in held.items() if b != a]
        scored.sort()
        for score, positive, _ in [s for s in scored if s[2]][:positives]:
            fitting = [(-s, b) for s, b, same in scored if not same and 30 * -score <= 100 * -s <= 90 * -score]
            out += [(a, positive, i + 1, b, -score, s) for i, (s, b) in enumerate(fitting[:negatives])]
    return sorted(out)


def mined(spark, rows, **options):
    frame = spark.createDataFrame(rows, ROW).repartition(3)
    for name in ("unit", "kind", "id", "vector", "targets", "bucket"):
        frame = frame.withColumn(name, F.lit("x"))
    made = H.hard_negatives(frame, F.col("vec_id") % 10 == 0, F.col("label"), **options)
    return sorted(map(tuple, made.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


@pytest.mark.parametrize("unit_rows", [7, 40, 4096])
def test_against_brute_force(spark, unit_rows):
    """Lengths over three orders, groups of equal vectors, ties, one label with a third."""
    rng = np.random.default_rng(unit_rows)
    rows = []
    for i in range(240):
        vector = rng.normal(size=8) * 10 ** rng.uniform(-1, 2)
        if i % 3 == 0:
            vector = np.array([1, 0.5, 0, 0, 0, 0, 0, -1.0])
        rows.append((i, [float(x) for x in vector], int(0 if i % 3 == 1 else rng.integers(0, 5))))
    assert mined(spark, rows, unit_rows=unit_rows) == brute(rows)


def test_awkward_rows(spark):
    rows = [
        (0, [1.0, 2.0, 3.0], 1),
        (10, [0.0, 0.0, 0.0], 1),
        (20, [], 2),
        (30, None, 1),
        (40, [1.0, None, 3.0], 1),
        (50, [1.0, float("nan"), 3.0], 1),
        (60, [1.0, float("inf"), 3.0], 1),
        (70, [1.0, 2.0, 3.0], None),
        (None, [1.0, 2.0, 3.0], 1),
        (80, [-1.0, -2.0, -3.0], 1),
        (1, [1.0, 2.0], 1),
        (2, [1.0, 1.0, 1.0, 5.0], 2),
        (3, [1.0, 1.0, 1.0], 3),
        (3, [1.0, 1.0, 1.0], 3),
        (3, [0.5, 1.0, 1.0], 3),
        (4, [0.0], 7),
    ]
    assert mined(spark, rows, unit_rows=3) == brute(rows) != []
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    # Too large for 64-bit scores: takes no part.
    assert mined(spark, [*rows, (5, [1e6, 1e6, 1e6], 2)], unit_rows=3) == brute(rows)


def test_no_row_is_pruned_that_reaches_the_score():
    rng = np.random.default_rng(3)
    vectors = [np.floor(256 * rng.normal(size=16) * rng.choice([1, 30])).astype(np.int64) for _ in range(300)]
    vectors[7][:] = 0
    unit = H.Unit(np.arange(300), np.zeros(300, np.int64), vectors)
    pruned = 0
    for anchor in vectors[:60]:
        scores = unit.scores(anchor, slice(None))
        for lowest in np.percentile(scores, [0, 50, 90, 99, 100]):
            rows = unit.candidates(anchor, int(lowest))
            kept = np.zeros(300, bool)
            kept[rows] = True
            assert kept[scores >= lowest].all() or lowest <= 0
            pruned += 300 - kept.sum()
    assert pruned > 1_000


def test_scores_are_exact_beyond_doubles():
    a, b = np.array([2**28 + 1, 3], np.int64), np.array([2**28 - 1, 5], np.int64)
    unit = H.Unit(np.array([1]), np.array([1]), [b])
    assert unit.scores(a, slice(None))[0] == int(a[0]) * int(b[0]) + 15
