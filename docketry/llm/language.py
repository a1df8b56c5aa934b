"""Language identification: a byte convolutional network over fixed-length windows.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes that overlap by the
widest filter, the last one padded; every byte of the text is in one. Bytes have
learned vectors; filters of several widths slide over them, the greatest value of
each filter in the window and a softmax layer give log-probabilities. A document's
answer is the softmax of its windows' mean log-probabilities, each window weighted
by its letters. Gradients, Adam and the fit are numpy.

Scale: prediction is in the row, in portions of ``PORTION`` windows, so long texts
need no more memory than short ones. The network is fitted on the driver on at
most ``per_language`` documents of each of at most ``MAX_LANGUAGES`` languages (the
smallest hashes of their ids; at most ``SAMPLE_WINDOWS`` windows of each, spread
over the text), which bounds what is brought there: 64 x 600 x 4 windows of 160
bytes, 25 MB. The model is 20 KB.

Edge cases: ``und`` with score 0 where the text is null, empty or has no letter, and
for all texts where there is nothing to learn from; null languages and null texts
are not learnt from; a null id counts as one document of empty text for the
split; a single language is answered with score 1; of more than ``MAX_LANGUAGES``
languages the first by name among the most frequent are learnt; repeated rows are
answered each alike; an empty table gives no rows; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 160
WIDTHS = (2, 3, 4, 5)
FILTERS = 14
BYTE_SIZE = 6
PER_LANGUAGE = 600
MAX_LANGUAGES = 64
SAMPLE_WINDOWS = 4
EPOCHS = 6
BATCH = 64
PORTION = 512
SEED = 11
UNKNOWN = "und"
WIDEST = max(WIDTHS)
STRIDE = WINDOW - WIDEST + 1
# Bytes that can be part of a letter: ASCII letters and all beyond ASCII.
LETTER = np.zeros(256, np.float32)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def windows_of(text: bytes) -> np.ndarray:
    """(windows, WINDOW) bytes, zeros at the end."""
    count = max(1, -(-(len(text) - WIDEST + 1) // STRIDE))
    padded = np.zeros((count - 1) * STRIDE + WINDOW, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def letters_in(windows: np.ndarray) -> np.ndarray:
    return LETTER[windows].sum(axis=1)


@dataclass
class ByteNetwork:
    """``bytes_``: (256, BYTE_SIZE); filters of all widths side by side, narrower ones
    with zeros (``mask``) behind: (WIDEST * BYTE_SIZE, filters)."""

    languages: list[str]
    bytes_: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    constant: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], seed: int = SEED) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        count = FILTERS * len(WIDTHS)
        filters = rng.normal(0, 0.3, (WIDEST * BYTE_SIZE, count)) * filter_mask()
        return cls(
            languages,
            rng.normal(0, 0.5, (256, BYTE_SIZE)).astype(np.float32),
            filters.astype(np.float32),
            np.zeros(count, np.float32),
            rng.normal(0, 0.1, (count, len(languages))).astype(np.float32),
            np.zeros(len(languages), np.float32),
        )

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """(windows, STRIDE, WIDEST * BYTE_SIZE): the vectors under the widest filter."""
        vectors = self.bytes_[windows].reshape(len(windows), -1)
        seen = np.lib.stride_tricks.sliding_window_view(vectors, WIDEST * BYTE_SIZE, axis=1)
        return np.ascontiguousarray(seen[:, ::BYTE_SIZE])

    def answers(self, patches: np.ndarray) -> np.ndarray:
        """(windows, STRIDE, filters) before the greatest value is taken."""
        flat = patches.reshape(-1, patches.shape[-1]) @ self.filters
        return flat.reshape(*patches.shape[:2], -1)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        pooled = np.maximum(self.answers(self.patches(windows)).max(axis=1) + self.bias, 0)
        return log_softmax(pooled @ self.weights + self.constant)

    def document(self, text: bytes) -> np.ndarray:
        """Log-probabilities of the languages, of a text with letters."""
        windows = windows_of(text)
        weights = letters_in(windows)
        total = np.zeros(len(self.languages))
        for start in range(0, len(windows), PORTION):
            part = slice(start, start + PORTION)
            total += weights[part] @ self.log_probabilities(windows[part])
        return log_softmax(total[None] / max(weights.sum(), 1))[0]

    def parts(self) -> tuple:
        return (self.languages, self.bytes_, self.filters, self.bias, self.weights, self.constant)


def filter_mask() -> np.ndarray:
    rows = np.arange(WIDEST * BYTE_SIZE)[:, None] // BYTE_SIZE
    return (rows < np.repeat(WIDTHS, FILTERS)[None]).astype(np.float32)


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def gradients(net: ByteNetwork, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross entropy, by back propagation through the greatest values."""
    patches = net.patches(windows)
    values = net.answers(patches)
    places = values.argmax(axis=1)
    rows = np.arange(len(windows))[:, None]
    greatest = np.take_along_axis(values, places[:, None], axis=1)[:, 0] + net.bias
    pooled = np.maximum(greatest, 0)
    error = np.exp(log_softmax(pooled @ net.weights + net.constant))
    error[np.arange(len(labels)), labels] -= 1
    error /= len(labels)
    back = (error @ net.weights.T) * (greatest > 0)
    chosen = patches[rows, places]  # (windows, filters, WIDEST * BYTE_SIZE)
    onto = back[..., None] * net.filters.T[None]
    onto = onto.reshape(-1, BYTE_SIZE)
    under = windows[rows[..., None], places[..., None] + np.arange(WIDEST)].ravel()
    by_byte = np.stack([np.bincount(under, onto[:, i], 256) for i in range(BYTE_SIZE)], axis=1)
    return {
        "bytes_": by_byte,
        "filters": np.einsum("nf,nfp->pf", back, chosen) * filter_mask(),
        "bias": back.sum(axis=0),
        "weights": pooled.T @ error,
        "constant": error.sum(axis=0),
    }


def fit_network(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = SEED) -> ByteNetwork:
    """Adam, with a rate that falls to zero."""
    net, rng, moments, step = ByteNetwork.fresh(languages, seed), np.random.default_rng(seed), {}, 0
    steps = EPOCHS * max(1, len(windows) // BATCH)
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // BATCH)):
            step += 1
            for name, slope in gradients(net, windows[rows], labels[rows]).items():
                first, second = moments.get(name, (0.0, 0.0))
                first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
                moments[name] = first, second
                change = first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
                rate = 5e-3 * (1 - (step - 1) / steps)
                setattr(net, name, (getattr(net, name) - rate * change).astype(np.float32))
    return net


def sample_windows(text: bytes) -> np.ndarray:
    """At most SAMPLE_WINDOWS windows with letters, spread evenly over the text."""
    windows = windows_of(text)
    windows = windows[letters_in(windows) > 0]
    if len(windows) > SAMPLE_WINDOWS:
        windows = windows[np.linspace(0, len(windows) - 1, SAMPLE_WINDOWS).astype(int)]
    return windows


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def learnt_from(
    documents: DataFrame, allowed: Column, key: str, text: str, language: str, per_language: int
) -> DataFrame:
    """(language, windows): a bounded sample, by hash, of the most frequent languages."""
    rows = documents.where(allowed & F.col(language).isNotNull() & has_letter(F.col(text))).select(
        F.col(key).cast("string").alias("own_key"), F.col(language).alias("own_language"), F.col(text).alias("own_text")
    )
    frequent = (
        rows.groupBy("own_language").count().orderBy(F.desc("count"), "own_language").limit(MAX_LANGUAGES)
    )
    # A row's place among all, 0 to 1, by hash: twice as many as needed are ranked,
    # whatever the number of rows, and rows that repeat are one.
    place = F.shiftrightunsigned(F.xxhash64("own_key", "own_text"), 11) / float(1 << 53)
    of = F.col("own_language") == F.col("of_language")
    by_place = Window.partitionBy("of_language").orderBy("place", "of_key")
    chosen = (
        rows.select(F.col("own_key").alias("of_key"), "own_language", place.alias("place"))
        .join(F.broadcast(frequent.select(F.col("own_language").alias("of_language"), "count")), of)
        .where(F.col("place") * F.col("count") <= 2 * per_language)
        .select("of_key", "of_language", "place")
        .distinct()
        .withColumn("nth", F.row_number().over(by_place))
        .where(F.col("nth") <= per_language)
    )

    @F.pandas_udf("binary")
    def sampled(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sample_windows(utf8(t)).tobytes())

    same = (
        F.col("own_key").eqNullSafe(F.col("of_key"))
        & (place == F.col("place"))
        & of
    )
    return rows.join(F.broadcast(chosen), same).select("own_language", "own_key", sampled("own_text").alias("windows"))


@dataclass(frozen=True)
class LanguageModel:
    network: ByteNetwork | None

    def predict(self, documents: DataFrame, text: Column) -> Column:
        """(lang, score) of each whole text."""
        if self.network is None:
            return F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
        shared = documents.sparkSession.sparkContext.broadcast(self.network.parts())

        @F.pandas_udf("lang string, score double")
        def predicted(texts: pd.Series) -> pd.DataFrame:
            net = ByteNetwork(*shared.value)
            found: Iterable[tuple[str, float]] = (best(net, net.document(utf8(t))) for t in texts)
            return pd.DataFrame(list(found), columns=["lang", "score"])

        nothing = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
        known = has_letter(text)
        # A text without letters is empty to the network, which runs on every row.
        answer = predicted(F.when(known, text))
        return F.when(known, answer).otherwise(nothing)


def best(net: ByteNetwork, scores: np.ndarray) -> tuple[str, float]:
    place = int(scores.argmax())
    return net.languages[place], float(np.exp(scores[place]))


def fit_language(
    documents: DataFrame,
    allowed: Column,
    key: str = "doc_id",
    text: str = "text",
    language: str = "lang",
    per_language: int = PER_LANGUAGE,
) -> LanguageModel:
    """``allowed``: which rows may be learnt from."""
    most = MAX_LANGUAGES * per_language
    rows = (
        learnt_from(documents, allowed, key, text, language, per_language)
        .orderBy(F.xxhash64("own_key"), "own_key", "own_language", "windows")
        .limit(most)  # rows that repeat an id
        .collect()
    )
    languages = sorted({r.own_language for r in rows})
    if not languages:
        return LanguageModel(None)
    windows = [np.frombuffer(r.windows, np.uint8).reshape(-1, WINDOW) for r in rows]
    labels = np.repeat([languages.index(r.own_language) for r in rows], [len(w) for w in windows])
    return LanguageModel(fit_network(np.concatenate(windows), labels, languages))
