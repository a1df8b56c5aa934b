import os

import numpy as np
import pytest
from helpers import AWKWARD, documents, with_clashing_columns
from pyspark.sql import functions as F

from docketry.llm import language as L
from docketry.llm.common import id_remainder, table


def labelled(spark, rows):
    """From (doc_id, text, lang)."""
    frame = documents(spark, [(i, t) for i, t, _ in rows])
    langs = spark.createDataFrame([(i, g) for i, _, g in rows], "own long, own_lang string")
    return frame.drop("lang").join(langs, F.col("doc_id") == F.col("own")).withColumnRenamed("own_lang", "lang")


def answers(frame, model):
    return {r.doc_id: r.found for r in frame.select("doc_id", model.predict(frame, F.col("text")).alias("found")).collect()}


@pytest.mark.parametrize("length", [0, 1, 4, 5, 159, 160, 161, 316, 317, 1000])
def test_windows_cover_every_run_of_bytes(length):
    text = bytes(np.random.default_rng(length).integers(1, 256, length, dtype=np.uint8))
    windows = [w.tobytes() for w in L.windows_of(text)]
    assert all(len(w) == L.WINDOW for w in windows)
    for start in range(max(1, length - L.WIDEST + 1)):
        assert any(text[start : start + L.WIDEST] in w for w in windows)
    seen = sum(len(w.rstrip(b"\0")) for w in windows)
    assert seen <= length + (len(windows) - 1) * (L.WIDEST - 1)


def test_filters_against_loops():
    net = L.ByteNetwork.fresh(["a", "b", "c"])
    windows = np.random.default_rng(0).integers(0, 256, (3, L.WINDOW), dtype=np.uint8)
    got = net.log_probabilities(windows)
    for row, window in enumerate(windows):
        pooled = np.zeros(net.filters.shape[1])
        for f in range(net.filters.shape[1]):
            width = L.WIDTHS[f // L.FILTERS]
            kernel = net.filters[:, f].reshape(L.WIDEST, L.BYTE_SIZE)[:width]
            values = [
                sum(kernel[k] @ net.bytes_[window[at + k]] for k in range(width)) for at in range(L.STRIDE)
            ]
            pooled[f] = max(0.0, max(values) + net.bias[f])
        logits = pooled @ net.weights + net.constant
        want = logits - np.log(np.exp(logits).sum())
        assert np.allclose(got[row], want, atol=1e-4)


def test_gradients_against_differences():
    net = L.ByteNetwork.fresh(["a", "b", "c"], seed=4)
    for name in ("bytes_", "filters", "bias", "weights", "constant"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    rng = np.random.default_rng(1)
    windows, labels = rng.integers(0, 40, (5, L.WINDOW), dtype=np.uint8), np.array([0, 1, 2, 1, 0])

    def loss():
        return -net.log_probabilities(windows)[np.arange(5), labels].mean()

    for name, slope in L.gradients(net, windows, labels).items():
        values = getattr(net, name)
        touched = np.argwhere(np.abs(slope) > 1e-4)
        for place in map(tuple, touched[rng.permutation(len(touched))[:6]]):
            kept = values[place]
            values[place] = kept + 1e-6
            more = loss()
            values[place] = kept - 1e-6
            less = loss()
            values[place] = kept
            assert abs((more - less) / 2e-6 - slope[place]) < 1e-3 + 0.02 * abs(slope[place]), (name, place)


def test_held_out_documents(spark, tables):
    folder = os.path.join(os.path.dirname(tables.rstrip("/")), "sf0.01")
    docs = table(spark, folder, "documents")
    held = id_remainder(F.col("doc_id"), 3) == 1
    model = L.fit_language(docs, ~held)
    rows = docs.where(held).select("lang", model.predict(docs, F.col("text")).alias("found")).collect()
    assert len(rows) > 200
    assert np.mean([r.lang == r.found.lang for r in rows]) > 0.97
    assert all(0 <= r.found.score <= 1 for r in rows)


def test_rows_that_may_not_be_learnt_from(spark):
    rows = [(i, f"the cat and the dog {i} sat", "en") for i in range(30)]
    rows += [(100 + i, f"el gato y el perro {i} están", "es") for i in range(30)]
    rows += [(200 + i, "und so weiter", "forbidden") for i in range(10)] + [(300, None, "null"), (301, "12", "digits")]
    frame = labelled(spark, rows)
    model = L.fit_language(frame, F.col("lang") != "forbidden")
    assert model.network.languages == ["en", "es"]
    found = answers(frame, model)
    assert [found[i].lang for i in (0, 100)] == ["en", "es"]
    assert tuple(found[300]) == tuple(found[301]) == ("und", 0.0)


def test_nothing_to_learn_from(spark):
    frame = documents(spark, [(1, "text"), (2, None)]).withColumn("lang", F.lit(None).cast("string"))
    assert {tuple(x) for x in answers(frame, L.fit_language(frame, F.lit(True))).values()} == {("und", 0.0)}
    empty = documents(spark, [])
    model = L.fit_language(empty, F.lit(True))
    assert empty.select(model.predict(empty, F.col("text"))).collect() == []


def test_awkward_rows(spark):
    frame = with_clashing_columns(documents(spark, AWKWARD))
    for name in ("own_key", "own_text", "own_language", "nth", "order", "text_hash", "lang_pred", "score"):
        frame = frame.withColumn(name, F.lit("x"))
    model = L.fit_language(frame, F.lit(True), per_language=3)
    rows = frame.select("doc_id", "text", model.predict(frame, F.col("text")).alias("found")).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert tuple(r.found) == (("en", 1.0) if letters else ("und", 0.0))


def test_a_long_text_is_read_to_its_end(spark):
    rows = [(i, "the cat and the dog sat there and then", "en") for i in range(20)]
    rows += [(100 + i, "el gato y el perro están allí señor", "es") for i in range(20)]
    frame = labelled(spark, rows)
    model = L.fit_language(frame, F.lit(True))
    long = documents(spark, [(1, "the cat and the dog " * 50 + "el gato y el perro están " * 20_000)])
    assert answers(long, model)[1].lang == "es"
