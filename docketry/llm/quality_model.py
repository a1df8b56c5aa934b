"""Quality classifier: random-indexing word vectors, a two-layer network, calibration.

Every word falls into one of ``slots`` (32,768) by its hash. A slot has a fixed
sparse index vector of +1 and -1; a word's vector is the sum of the index
vectors of the words up to two places away, over all documents. A document pools
the unit vectors of its words (mean, spread, likeness of neighbours, share of
distinct words), whole text. A two-layer numpy network is fitted on labelled
documents; a temperature fitted on labelled documents that it has not seen turns
its output into calibrated probabilities.

Scale: no text is shuffled. The vectors are sums of whole numbers that tasks
make for themselves and the cluster adds up by slot; the table is 32,768 x 32
numbers (4 MB) for any corpus, which bounds what is collected and broadcast. The
network is fitted on at most ``max_labelled`` (20,000) labelled documents, those
of the smallest hashes of their ids, which bounds the broadcast of the labels and
the features brought to the driver (6 MB).

Edge cases: null and empty texts pool to zeros and are scored like any other;
labels that are null are ignored, of several labels of a document the majority
counts (good on a tie); without labels of both kinds the score is the share of
good labels (0.5 without any); repeated rows are scored each; an empty table
gives no rows; other columns may have any names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLOTS = 1 << 15
DIMENSIONS = 32
NONZERO = 4
REACH = 2
MAX_LABELLED = 20_000
HIDDEN = 24
EPOCHS = 60
DECAY = 1e-3
DOUBT_WORDS = 10
SEED = 5
PORTION = 200_000
FEATURES = 2 * DIMENSIONS + 4
# Runs of letters and digits (any character beyond ASCII is one), or of signs.
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")


def slots_of(text: str | None) -> np.ndarray:
    """The slot of each word of a text; case counts."""
    found = TOKEN.findall((text or "").encode("utf-8", "surrogatepass"))
    return np.fromiter(map(zlib.crc32, found), np.int64, len(found)) & (SLOTS - 1)


def index_vectors(seed: int = SEED) -> np.ndarray:
    """(DIMENSIONS, SLOTS + 1): the last slot, of zeros, separates documents."""
    rng = np.random.default_rng(seed)
    out = np.zeros((DIMENSIONS, SLOTS + 1), np.int8)
    for _ in range(NONZERO):
        out[rng.integers(0, DIMENSIONS, SLOTS), np.arange(SLOTS)] = rng.choice([-1, 1], SLOTS)
    return out


def add_contexts(total: np.ndarray, index: np.ndarray, documents: list[np.ndarray]) -> None:
    """Add to each word's sums the index vectors of its neighbours."""
    gap = np.full(REACH, SLOTS)
    slots = np.concatenate([gap, *(x for d in documents for x in (d, gap))])
    inner = slots[REACH : len(slots) - REACH]
    for d in range(DIMENSIONS):
        values = index[d][slots]
        around = np.zeros(len(inner), np.int16)
        for step in range(1, REACH + 1):
            around += values[REACH - step : len(values) - REACH - step]
            around += values[REACH + step : len(values) - REACH + step]
        total[d] += np.bincount(inner, around, SLOTS + 1)


def context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to one row for each slot that the task has met: (slot, sums)."""
    index = index_vectors()
    total = np.zeros((DIMENSIONS, SLOTS + 1))
    waiting, size = [], 0
    for batch in batches:
        for text in batch.column(0):
            waiting.append(slots_of(text.as_py()))
            size += len(waiting[-1])
            if size > PORTION:
                add_contexts(total, index, waiting)
                waiting, size = [], 0
    if waiting:
        add_contexts(total, index, waiting)
    met = np.flatnonzero(np.abs(total[:, :SLOTS]).sum(axis=0))
    sums = total[:, met].astype(np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(met), *map(pa.array, sums)], names=["slot", *(f"d{i}" for i in range(DIMENSIONS))]
    )


def word_vectors(documents: DataFrame, text: str = "text") -> np.ndarray:
    """(SLOTS, DIMENSIONS) unit vectors; zeros for words never met."""
    names = [f"d{i}" for i in range(DIMENSIONS)]
    summed = (
        documents.select(F.col(text))
        .mapInArrow(context_sums, "slot long, " + ", ".join(f"{n} long" for n in names))
        .groupBy("slot")
        .agg(*(F.sum(n).alias(n) for n in names))
        .toArrow()  # SLOTS rows at most
    )
    vectors = np.zeros((SLOTS, DIMENSIONS), np.float32)
    values = np.stack([summed[n].to_numpy() for n in names], axis=1).astype(np.float64)
    norms = np.linalg.norm(values, axis=1, keepdims=True)
    vectors[summed["slot"].to_numpy()] = np.divide(values, norms, out=np.zeros_like(values), where=norms > 0)
    return vectors


def pooled(slots: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """FEATURES numbers of a document; zeros without words."""
    out = np.zeros(FEATURES, np.float32)
    n = len(slots)
    if n:
        words = vectors[slots]
        out[:DIMENSIONS] = words.mean(axis=0)
        out[DIMENSIONS : 2 * DIMENSIONS] = words.std(axis=0)
        out[-4] = np.einsum("ij,ij->i", words[1:], words[:-1]).mean() if n > 1 else 0.0
        out[-3] = len(np.unique(slots)) / n
        out[-2] = (slots[1:] == slots[:-1]).mean() if n > 1 else 0.0
        out[-1] = np.log1p(n)
    return out


@dataclass
class Network:
    """Two layers; ``prior`` is the answer where nothing could be fitted."""

    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    prior: float | None = None

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """Standardised; drawn towards the average as far as a text is short."""
        words = np.expm1(x[:, -1:])
        return (x - self.mean) / self.spread * (words / (words + DOUBT_WORDS))

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.inputs(x) @ self.w1 + self.b1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(x), self.prior)
        return sigmoid(self.logits(x) / self.temperature)

    def parts(self) -> tuple:
        return (self.mean, self.spread, self.w1, self.b1, self.w2, self.b2, self.temperature, self.prior)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, calibration: np.ndarray, seed: int = SEED) -> Network:
    """Adam on the rows outside ``calibration``, then the temperature on those inside."""
    rng = np.random.default_rng(seed)
    fitted = ~calibration if calibration.any() and len(set(y[~calibration])) == 2 else np.ones(len(y), bool)
    xs, ys = x[fitted].astype(np.float64), y[fitted].astype(np.float64)
    width = x.shape[1]
    net = Network(
        xs.mean(axis=0),
        xs.std(axis=0) + 1e-6,
        rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)),
        np.zeros(HIDDEN),
        rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
        0.0,
    )
    names, moments = ("w1", "b1", "w2", "b2"), {}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(xs))
        for rows in np.array_split(order, max(1, len(xs) // 64)):
            step += 1
            h = net.hidden(xs[rows])
            error = (sigmoid(h @ net.w2 + net.b2) - ys[rows]) / len(rows)
            back = np.outer(error, net.w2) * (1 - h * h)
            gradients = {
                "w1": net.inputs(xs[rows]).T @ back + DECAY * net.w1,
                "b1": back.sum(axis=0),
                "w2": h.T @ error + DECAY * net.w2,
                "b2": error.sum(),
            }
            for name in names:
                first, second = moments.get(name, (0.0, 0.0))
                first = 0.9 * first + 0.1 * gradients[name]
                second = 0.999 * second + 0.001 * gradients[name] ** 2
                moments[name] = first, second
                change = first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
                setattr(net, name, getattr(net, name) - 3e-3 * change)
    if calibration.any():
        logits, labels = net.logits(x[calibration].astype(np.float64)), y[calibration]
        choices = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        losses = [
            -np.mean(np.log(np.where(labels == 1, p, 1 - p) + 1e-12))
            for p in (sigmoid(logits / t) for t in choices)
        ]
        net.temperature = float(choices[int(np.argmin(losses))])
    return net


def constant(prior: float) -> Network:
    nothing = np.zeros(0)
    return Network(nothing, nothing, nothing, nothing, nothing, 0.0, prior=prior)


@dataclass(frozen=True)
class QualityModel:
    vectors: np.ndarray
    network: Network

    def score(self, documents: DataFrame, text: Column) -> Column:
        """The probability that a text is good, 0 to 1."""
        context = documents.sparkSession.sparkContext
        shared = context.broadcast((self.vectors, self.network.parts()))

        @F.pandas_udf(T.DoubleType())
        def scored(texts: pd.Series) -> pd.Series:
            vectors, parts = shared.value
            if not len(texts):
                return pd.Series([], dtype="float64")
            features = np.stack([pooled(slots_of(t), vectors) for t in texts])
            return pd.Series(Network(*parts).scores(features.astype(np.float64)))

        return scored(text)


def labelled_sample(labels: DataFrame, allowed: Column, key: str, label: str, most: int) -> DataFrame:
    """(label_key, label): at most ``most`` documents, those of the smallest hashes."""
    return (
        labels.where(allowed & F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("label_key"))
        .agg((F.avg(F.col(label)) >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("label_key"), "label_key")
        .limit(most)
    )


def fit_quality(
    documents: DataFrame,
    labels: DataFrame,
    allowed: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    max_labelled: int = MAX_LABELLED,
) -> QualityModel:
    """``allowed``: which rows of ``labels`` may be learnt from."""
    vectors = word_vectors(documents, text)
    shared = documents.sparkSession.sparkContext.broadcast(vectors)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([pooled(slots_of(t), shared.value) for t in texts], dtype=object)

    sample = labelled_sample(labels, allowed, key, label, max_labelled)
    rows = (
        documents.select(F.col(key).alias("own_key"), F.col(text).alias("own_text"))
        .join(F.broadcast(sample), F.col("own_key") == F.col("label_key"))
        .select("own_key", "label", features("own_text").alias("features"))
        .orderBy(F.xxhash64("own_key"), "own_key", "features")
        .limit(max_labelled)  # rows that repeat an id
        .collect()
    )
    if not rows:
        return QualityModel(vectors, constant(0.5))
    x = np.array([r["features"] for r in rows], np.float64)
    y = np.array([r["label"] for r in rows])
    if len(set(y)) < 2:
        return QualityModel(vectors, constant(float(y.mean())))
    return QualityModel(vectors, fit_network(x, y, np.arange(len(y)) % 5 == 4))
