"""Language-model scoring by the likelihood of a subword lattice.

A text is its words, each with a space in front, and one end mark. A word's
probability is the sum over all its segmentations into pieces of an existing
vocabulary, found by a forward recursion in log space; the document's marginal
probability is their product, as no piece crosses a word.

The vocabulary's own scores (merge ranks, read as Zipf weights) weight the
lattices first; ``rounds`` of expectation-maximisation over all words of the
training documents, each word weighted by its count, turn them into the piece
probabilities of the corpus. Next to it stands the plain word model of the
base score.

Scale: words are counted in each task before the shuffle; lattices are built
once for each distinct word, not for each occurrence. The most frequent words, at
most ``head`` (50,000, a few MB, whatever the corpus), are broadcast with their
scores;
each document sums those at once and keeps only its other words, which are
joined with the word table by word. No word of the join can be hot: each is
rarer than every word of the head. Piece probabilities are one row per piece of
the vocabulary.

Edge cases: null and empty texts have the end mark only; a null id is no
training remainder but that of empty text; repeated rows are scored each and
count each; without training documents all counts are 0 and pieces keep their
first weights; an empty table gives no rows; other columns may have any names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import lattice
from docketry.llm.common import ascii_lower_bytes
from docketry.session import work_folder

END = "\n"  # no word has it
HEAD = 50_000
ROUNDS = 2
FLUSH = 250_000  # distinct words that a task holds before it passes its counts on
LATTICE_WORDS = 50_000


def words_in(text: str | None) -> list[bytes]:
    return ascii_lower_bytes(text).split()


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, training) to partial counts (word, trained, seen)."""

    def flushed(seen: Counter, trained: Counter) -> pa.RecordBatch:
        names = list(seen)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.binary()).cast(pa.string()),
                pa.array([trained[w] for w in names], pa.int64()),
                pa.array([seen[w] for w in names], pa.int64()),
            ],
            names=["word", "trained", "seen"],
        )

    seen, trained = Counter(), Counter()
    for batch in batches:
        for text, training in zip(batch.column(0), batch.column(1).to_pylist()):
            found = words_in(text.as_py())
            found.append(END.encode())
            seen.update(found)
            if training:
                trained.update(found)
            if len(seen) > FLUSH:
                yield flushed(seen, trained)
                seen, trained = Counter(), Counter()
    yield flushed(seen, trained)


def word_lattices(vocabulary: lattice.Vocabulary, words: list[str], weights: np.ndarray):
    """Bounds, edges, nodes and weights of the lattices of words with a space in front."""
    codes, bounds = lattice.code_points([" " + w for w in words])
    codes[codes == lattice.SPACE_CODE] = lattice.LITERAL_SPACE
    codes[bounds[:-1]] = lattice.SPACE_CODE
    edges = lattice.find_edges(vocabulary, codes, bounds)
    _, source, target = lattice.nodes_of(bounds, edges)
    return codes, bounds, edges, source, target, lattice.edge_weights(vocabulary, codes, edges, weights)


def portions(words: list[str]) -> Iterator[slice]:
    """Slices of at most LATTICE_WORDS words and about as many times 16 characters."""
    start = size = 0
    for i, w in enumerate(words):
        size += len(w)
        if i + 1 - start >= LATTICE_WORDS or size > 16 * LATTICE_WORDS:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(words):
        yield slice(start, len(words))


def log_marginals(vocabulary: lattice.Vocabulary, words: list[str], weights: np.ndarray) -> np.ndarray:
    """Natural log of each word's probability over all segmentations."""
    out = np.zeros(len(words))
    for part in portions(words):
        _, bounds, _, source, target, weight = word_lattices(vocabulary, words[part], weights)
        sums = lattice.path_sums(bounds, source, target, weight)
        out[part] = sums[bounds[1:] + np.arange(len(bounds) - 1)]
    return out


def expected_pieces(
    vocabulary: lattice.Vocabulary, words: list[str], counts: np.ndarray, weights: np.ndarray
) -> np.ndarray:
    """Expected number of uses of each piece over ``counts`` occurrences of the words."""
    total = np.zeros(vocabulary.size)
    for part in portions(words):
        codes, bounds, edges, source, target, weight = word_lattices(vocabulary, words[part], weights)
        forward = lattice.path_sums(bounds, source, target, weight)
        backward = lattice.backward_sums(bounds, source, target, weight)
        string = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[edges.start]
        whole = forward[bounds[1:] + np.arange(len(bounds) - 1)]
        used = np.exp(forward[source] + weight + backward[target] - whole[string]) * counts[part][string]
        pieces = edges.piece >= 0
        total += np.bincount(edges.piece[pieces], used[pieces], vocabulary.size)
        for i in np.flatnonzero(~pieces):
            for byte in lattice.bytes_of(int(codes[edges.start[i]])):
                total[vocabulary.byte_ids[byte]] += used[i]
    return total


@dataclass(frozen=True)
class Model:
    """Natural logs: ``weights`` of the pieces, ``end`` of the end mark."""

    vocabulary: lattice.Vocabulary
    weights: np.ndarray
    end: float


def trained_model(spark: SparkSession, words: DataFrame, vocabulary: lattice.Vocabulary, rounds: int) -> Model:
    """Piece probabilities of the training words, half a use added to each piece."""
    ends = words.where(F.col("word") == END).agg(F.sum("trained")).first()[0] or 0
    training = words.where((F.col("trained") > 0) & (F.col("word") != END)).select("word", "trained")
    weights = vocabulary.zipf_weights()
    known = spark.sparkContext.broadcast(vocabulary.parts())
    for _ in range(rounds if ends else 0):
        now = spark.sparkContext.broadcast(weights)

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            pieces = lattice.Vocabulary(*known.value)
            total = np.zeros(pieces.size)
            for batch in batches:
                total += expected_pieces(
                    pieces, batch.column(0).to_pylist(), batch.column(1).to_numpy(), now.value
                )
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "uses"])

        # at most one row for each piece of the vocabulary
        uses = training.mapInArrow(expect, "piece long, uses double").groupBy("piece").agg(F.sum("uses")).collect()
        counts = np.full(vocabulary.size, 0.5)
        counts[[r[0] for r in uses]] += [r[1] for r in uses]
        total = counts.sum() + ends + 0.5
        weights = np.log(counts / total)
    end = math.log((ends + 0.5) / total) if ends else math.log(0.5)
    if not ends:
        weights = weights + math.log(0.5)
    return Model(vocabulary, weights, end)


def word_table(
    documents: DataFrame, training: Column, vocabulary: lattice.Vocabulary, text: str, rounds: int
) -> DataFrame:
    """(word, trained, seen, logp): every distinct word and the end mark, stored."""
    spark = documents.sparkSession
    counted = (
        documents.select(F.col(text), training.alias("training"))
        .mapInArrow(count_words, "word string, trained long, seen long")
        .groupBy("word")
        .agg(F.sum("trained").alias("trained"), F.sum("seen").alias("seen"))
    )
    path = work_folder(spark, "words")
    counted.write.parquet(path)
    words = spark.read.parquet(path)
    trained = trained_model(spark, words, vocabulary, rounds)
    model = spark.sparkContext.broadcast((vocabulary.parts(), trained.weights, trained.end))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, weights, end = model.value
        pieces = lattice.Vocabulary(*parts)
        for batch in batches:
            names = batch.column(0).to_pylist()
            logp = log_marginals(pieces, names, weights)
            logp[[i for i, w in enumerate(names) if w == END]] = end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logp)], names=["word", "trained", "seen", "logp"])

    path = work_folder(spark, "scored-words")
    words.mapInArrow(score, "word string, trained long, seen long, logp double").write.parquet(path)
    return spark.read.parquet(path)


def head_count(words: DataFrame, head: int) -> int:
    """The count from which on there are ``head`` words at most, or fewer.

    From the number of words in each eighth of a power of two: a few hundred rows.
    """
    steps = F.floor(F.log2("seen") * 8)
    classes = words.groupBy(steps.alias("step")).agg(
        F.count(F.lit(1)).alias("words"), F.min("seen").alias("least")
    )
    taken, least = 0, 2**62
    for row in sorted(classes.collect(), key=lambda r: -r["step"]):
        taken += row["words"]
        if taken > head:
            break
        least = row["least"]
    return least


def score_documents(
    documents: DataFrame,
    training: Column,
    vocabulary_path: str,
    key: str = "doc_id",
    text: str = "text",
    head: int = HEAD,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(key, training, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = documents.sparkSession
    words = word_table(documents, training, lattice.load_vocabulary(vocabulary_path), text, rounds)
    totals = words.agg(
        F.sum("trained").alias("tokens"), F.sum((F.col("trained") > 0).cast("long")).alias("words")
    ).first()
    n, v = totals["tokens"] or 0, totals["words"] or 0
    valued = words.select(
        "word",
        (F.col("trained") > 0).cast("long").alias("known"),
        F.log10((F.col("trained") + 0.5) / F.lit(n + 0.5 * (v + 1))).alias("base"),
        (F.col("logp") / math.log(10)).alias("model"),
        "seen",
    )
    top = valued.where(F.col("seen") >= head_count(valued, head)).collect()  # head rows at most
    table = spark.sparkContext.broadcast(
        {r["word"].encode("utf-8", "surrogatepass"): (r["known"], r["base"], r["model"]) for r in top}
    )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = table.value
        for batch in batches:
            sums: list[tuple] = []
            words, times_, ends = [], [], [0]
            for text_ in batch.column("scored_text"):
                found = Counter(words_in(text_.as_py()))
                found[END.encode()] += 1
                known = base = model = 0
                for word, times in found.items():
                    if (score := scores.get(word)) is None:
                        words.append(word)
                        times_.append(times)
                    else:
                        known += times * score[0]
                        base += times * score[1]
                        model += times * score[2]
                sums.append((found.total(), known, float(base), float(model)))
                ends.append(len(words))
            columns = list(zip(*sums)) or [[]] * 4
            others = pa.StructArray.from_arrays(
                [pa.array(words, pa.binary()).cast(pa.string()), pa.array(times_, pa.int64())],
                names=["word", "times"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("scored_key"),
                    batch.column("scored_training"),
                    *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), others),
                ],
                names=["key", "training", "n_tokens", "known", "base", "model", "others"],
            )

    rows = documents.select(
        F.col(key).alias("scored_key"), F.col(text).alias("scored_text"), training.alias("scored_training")
    )
    kind = rows.schema["scored_key"].dataType.simpleString()
    path = work_folder(spark, "sums")
    rows.mapInArrow(
        add_up,
        f"key {kind}, training boolean, n_tokens long, known long, base double, model double, "
        "others array<struct<word: string, times: long>>",
    ).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    summed = spark.read.parquet(path)
    others = (
        summed.select("row", F.explode("others").alias("other"))
        .select("row", "other.word", "other.times")
        .join(valued.drop("seen"), "word")
        .groupBy("row")
        .agg(*(F.sum(F.col(c) * F.col("times")).alias(f"more_{c}") for c in ("known", "base", "model")))
    )

    def both(name: str) -> Column:
        return F.col(name) + F.coalesce(F.col(f"more_{name}"), F.lit(0))

    return summed.join(others, "row", "left").select(
        F.col("key").alias(key),
        "training",
        "n_tokens",
        both("known").cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        both("base").alias("base_score"),
        both("model").alias("score"),
    )
