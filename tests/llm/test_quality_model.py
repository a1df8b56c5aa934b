import numpy as np
import pytest
from helpers import AWKWARD, documents, with_clashing_columns
from pyspark.sql import functions as F

from docketry.llm import quality_model as Q
from docketry.llm.common import id_remainder, table


def slow_contexts(index, documents_):
    total = np.zeros((Q.SLOTS, Q.DIMENSIONS))
    for slots in documents_:
        for i, s in enumerate(slots):
            for j in range(max(0, i - Q.REACH), min(len(slots), i + Q.REACH + 1)):
                if j != i:
                    total[s] += index[:, slots[j]]
    return total


def test_context_sums():
    rng = np.random.default_rng(0)
    found = [rng.integers(0, 40, n) for n in (0, 1, 2, 3, 30)]
    index = Q.index_vectors()
    total = np.zeros((Q.DIMENSIONS, Q.SLOTS + 1))
    Q.add_contexts(total, index, found)
    assert (total[:, : Q.SLOTS].T == slow_contexts(index, found)).all()


def test_pooling_is_finite():
    vectors = np.random.default_rng(0).normal(size=(Q.SLOTS, Q.DIMENSIONS)).astype(np.float32)
    for text in (None, "", "word", "two words", "x" * 100_000, "a " * 50_000):
        assert np.isfinite(Q.pooled(Q.slots_of(text), vectors)).all()
    assert (Q.pooled(Q.slots_of(""), vectors) == 0).all()


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, Q.FEATURES))
    x[:, -1] = np.log1p(200)
    chance = Q.sigmoid(3 * x[:, 0] - 2 * x[:, 1])
    y = (rng.random(3000) < chance).astype(int)
    net = Q.fit_network(x[:2000], y[:2000], np.arange(2000) % 5 == 4)
    scores = net.scores(x[2000:])
    assert ((scores >= 0.5) == (chance[2000:] >= 0.5)).mean() > 0.8
    for low in (0.0, 0.25, 0.5, 0.75):
        inside = (scores >= low) & (scores < low + 0.25)
        assert abs(y[2000:][inside].mean() - scores[inside].mean()) < 0.12


def test_held_out_documents(spark, tables):
    import os

    folder = os.path.join(os.path.dirname(tables.rstrip("/")), "sf0.01")
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = Q.fit_quality(docs, labels, id_remainder(F.col("doc_id"), 5) != 0)
    held = labels.where(id_remainder(F.col("doc_id"), 5) == 0)
    rows = (
        docs.join(held, "doc_id").select("quality", model.score(docs, F.col("text")).alias("score")).collect()
    )
    right = [(r.score >= 0.3) == (r.quality == 1) for r in rows]
    assert len(rows) > 50 and np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


LABEL = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("labels, score", [([], 0.5), ([(1, 1, 0), (2, None, 0), (None, 0, 0)], 1.0), ([(1, 0, 0)], 0.0)])
def test_labels_of_one_kind(spark, labels, score):
    frame = documents(spark, [(1, "some text"), (2, None)])
    model = Q.fit_quality(frame, spark.createDataFrame(labels, LABEL), F.lit(True))
    assert {r[0] for r in frame.select(model.score(frame, F.col("text"))).collect()} == {score}


def test_awkward_rows(spark):
    frame = with_clashing_columns(documents(spark, AWKWARD))
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (5, 1, 0), (6, 0, 0), (1, 0, 0), (99, 1, 1)], LABEL)
    model = Q.fit_quality(frame, labels, F.lit(True), max_labelled=3)
    scores = [r[0] for r in frame.select(model.score(frame, F.col("text"))).collect()]
    assert len(scores) == len(AWKWARD) and all(0 <= s <= 1 for s in scores)
    empty = documents(spark, [])
    model = Q.fit_quality(empty, labels, F.lit(True))
    assert empty.select(model.score(empty, F.col("text"))).collect() == []
