"""Token ids of a corpus in compressed segments, in the order of the ids.

Documents are range-partitioned and sorted by id, encoded with an existing
tokenizer and closed with an end id. Each partition writes *segments* of whole
documents, about 2 million ids each, as rows of a table in the shared folder:
(file, segment, documents, data). ``data`` is a segment of the range coder
(``idcodec``): blocks that are coded from a fresh model and checked one by one.
Rows of a table, not loose files, so that Spark's commit keeps a repeated task
from leaving two copies, and any storage that Spark writes to will do.

Scale: texts are shuffled once, for the order; equal ids are neighbours in one
task. A task holds segments of 6 million ids together, or one that is longer, and codes
them in step; each is written, and can be read, by itself.
The place of a document in the corpus needs only the number of ids of each
segment, summed in two levels.

Words are looked up by portions of texts: the tokenizer drops white space and never
joins over it, so the ids of a text are those of its stretches between spaces
and line breaks. The parts of words are encoded once in a worker, up to a bound, and
kept as one array: far smaller than a dictionary of words.

Edge cases: null and empty texts have the end id only; null ids come first;
rows of an equal id are ordered by a hash of their text; a document longer than
a segment is a segment of its own; an empty table writes no segment; other
columns may have any names.
"""

from __future__ import annotations

import codecs
import json
import os
from array import array
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import running_starts
from docketry.llm.idcodec import TOGETHER, decode_segments, encode_segments

END = 1
SEGMENT = 2_000_000
PORTION = 16_000_000  # bytes of texts encoded at once
KNOWN_PARTS = 1_000_000
WORDS_AT_ONCE = 10_000
WORDS_GATHERED = 100_000  # words whose ids are put in the order of the texts at once


# The pipeline in front of the merges that ``PARTS`` repeats for ``EASY`` words.
NORMAL = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CUTS = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": CUT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
# Printable ASCII and letters that stand alone in Latin-1: none of them joins another in NFC.
EASY = "[!-~À-ÖØ-öø-ÿ]+"
LETTERS = "a-zß-öø-ÿ"
PARTS = f"({CUT.replace(r'\p{L}', LETTERS).replace(r'\p{N}', '0-9')})"


def byte_letters() -> str:
    """What the library writes for each byte."""
    letters = {b: chr(b) for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    unprinted = [b for b in range(256) if b not in letters]
    return "".join(letters.get(b) or chr(256 + unprinted.index(b)) for b in range(256))


class Encoder:
    """Token ids of texts; the ids of parts met so far are kept, up to a bound.

    The different words of ``EASY`` characters are put in lower case and cut here, as the
    tokenizer's own pipeline does, and their parts go straight to its merges. All other
    words are parts of their own and go through the whole pipeline, and so does every
    word of a tokenizer whose pipeline is another.
    """

    def __init__(self, tokenizer: str):
        # A worker is one task of many: threads of its own would share its core.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        rules = json.loads(tokenizer)
        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.merges = self.tokenizer.model
        self.cuts = (
            rules["normalizer"] == NORMAL
            and rules["pre_tokenizer"] == CUTS
            and rules["post_processor"] is None
            and all("<|" in t["content"] for t in rules["added_tokens"])
        )
        self.byte_letters = byte_letters()
        self.clear()

    def clear(self) -> None:
        self.parts = pa.array([], pa.large_string())
        self.start = np.zeros(1, np.int64)  # of each part's ids, and the end of the last
        self.ids = np.zeros(0, np.int32)

    def easy(self, words: pa.Array) -> pa.Array:
        fits = pc.match_substring_regex(words, f"^{EASY}$")
        return pc.and_(pc.and_not(fits, pc.match_substring(words, "<|")), self.cuts)

    def learn(self, parts: pa.Array) -> np.ndarray:
        """The numbers that the parts get."""
        easy = self.easy(parts)
        order = np.argsort(pc.invert(easy).to_numpy(zero_copy_only=False), kind="stable")
        numbers = np.empty(len(parts), np.int64)
        numbers[order] = np.arange(len(self.parts), len(self.parts) + len(parts))
        merged = (self.merged(x) for x in parts.filter(easy).to_numpy(zero_copy_only=False))
        self.keep(parts.filter(easy), merged)
        others = parts.filter(pc.invert(easy))
        for a in range(0, len(others), WORDS_AT_ONCE):  # an encoding is far larger than its ids
            batch = others.slice(a, WORDS_AT_ONCE)
            found = self.tokenizer.encode_batch_fast(batch.to_pylist(), add_special_tokens=False)
            self.keep(batch, (e.ids for e in found))
        return numbers

    def merged(self, part: str) -> list[int]:
        if not part.isascii():
            part = codecs.charmap_decode(part.encode(), "strict", self.byte_letters)[0]
        return [token.id for token in self.merges.tokenize(part)]

    def keep(self, parts: pa.Array, found: Iterable[list[int]]) -> None:
        ids, ends = array("i"), array("q")
        for of_part in found:
            ids.extend(of_part)
            ends.append(len(ids))
        self.parts = pa.concat_arrays([self.parts, parts])
        self.start = np.r_[self.start, self.start[-1] + np.array(ends, np.int64)]
        self.ids = np.r_[self.ids, np.array(ids, np.int32)]

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different words, end to end, and their bounds."""
        easy = self.easy(words)
        words = pc.if_else(easy, pc.utf8_lower(words), words)
        mixed = pc.and_not(easy, pc.match_substring_regex(words, f"^[{LETTERS}]+$"))
        cut = pc.replace_substring_regex(words.filter(mixed), PARTS, r"\1 ")
        cut = pc.split_pattern(pc.replace_with_mask(words, mixed, cut), " ")
        met = cut.flatten().dictionary_encode()
        if len(self.parts) > KNOWN_PARTS:
            self.clear()
        # Those known are looked up among those met, which are fewer.
        place = pc.index_in(self.parts, met.dictionary)
        known = place.is_valid().to_numpy(zero_copy_only=False).nonzero()[0]
        numbers = np.full(len(met.dictionary), -1)
        numbers[place.drop_null().to_numpy()] = known
        new = numbers < 0
        if new.any():
            numbers[new] = self.learn(met.dictionary.filter(pa.array(new)))
        ids, ends = gathered(self.ids, self.start, numbers.take(met.indices.to_numpy()))
        return ids, ends[np.r_[0, np.cumsum(pc.list_value_length(cut).to_numpy())]]

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text, with the end id."""
        if not len(texts):
            return []
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts)
        split = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        met = split.flatten().dictionary_encode()
        ids, bounds = self.of_words(met.dictionary)
        # Behind each text a word of its own, the end id.
        ids, bounds = np.r_[ids, np.int32(END)], np.r_[bounds, len(ids) + 1]
        stops = np.cumsum(pc.list_value_length(split).to_numpy().astype(np.int64) + 1)
        places = met.indices.to_numpy()
        cuts = np.searchsorted(stops, np.arange(WORDS_GATHERED, stops[-1], WORDS_GATHERED))
        out: list[np.ndarray] = []
        for a, b in pairwise(np.unique(np.r_[0, cuts, len(stops)]).tolist()):
            before = stops[a - 1] if a else 0
            ends_at = stops[a:b] - before
            words = np.full(ends_at[-1], len(bounds) - 2, np.int64)
            inside = np.ones(len(words), bool)
            inside[ends_at - 1] = False
            words[inside] = places[before - a : stops[b - 1] - b]
            of_texts, ends = gathered(ids, bounds, words)
            out += np.split(of_texts, ends[ends_at[:-1]])
        return out


def gathered(ids: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """These of the stretches of ids, end to end, and their bounds."""
    starts = bounds.take(which)
    lengths = bounds.take(which + 1) - starts
    ends = np.r_[0, np.cumsum(lengths)]
    places = np.repeat(starts - ends[:-1], lengths)
    places += np.arange(ends[-1])
    return ids.take(places), ends


def encoder_of(held: list) -> Encoder:
    """The one encoder of a worker: made by its first task, whose list then holds it
    behind the tokenizer's text. The memory of a tokenizer does not all come back."""
    if len(held) == 1:
        held.append(Encoder(held[0]))
    return held[1]


def portions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, cut anew where the texts in the second column reach ``PORTION`` bytes."""
    waiting, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(), dtype=np.int64)
        start, past = 0, 0
        while start < batch.num_rows:
            stop = min(int(np.searchsorted(ends, past + PORTION - size)) + 1, batch.num_rows)
            waiting.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1]) - past
            start, past = stop, int(ends[stop - 1])
            if size >= PORTION:
                yield pa.concat_batches(waiting)
                waiting, size = [], 0
    if waiting:
        yield pa.concat_batches(waiting)


def write_token_files(
    documents: DataFrame,
    path: str,
    tokenizer_path: str,
    key: str = "doc_id",
    text: str = "text",
    segment: int = SEGMENT,
) -> None:
    spark = documents.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        # A worker keeps a broadcast value, so what is added to this list lasts from task to task.
        tokenizer = spark.sparkContext.broadcast([f.read()])
    rows = (
        documents.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .repartitionByRange("key")
        .sortWithinPartitions("key", F.xxhash64("text"))
    )
    kind = rows.schema["key"].dataType.simpleString()
    key_type = pa.struct([("key", arrow_type(rows)), ("n_tokens", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer.value)
        file = TaskContext.get().partitionId()
        number = size = 0
        keys: list = []
        held: list[np.ndarray] = []
        full: list[tuple[list, np.ndarray]] = []  # segments that wait to be coded together

        def closed() -> None:
            documents_ = [{"key": k, "n_tokens": len(x)} for k, x in zip(keys, held)]
            full.append((documents_, np.concatenate(held)))

        def coded() -> Iterator[pa.RecordBatch]:
            data = encode_segments([ids for _, ids in full])
            for at, ((documents_, ids), of_segment) in enumerate(zip(full, data), number - len(full)):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file], pa.int32()),
                        pa.array([at], pa.int32()),
                        pa.array([len(ids)], pa.int64()),
                        pa.array([documents_], pa.list_(key_type)),
                        pa.array([of_segment], pa.binary()),
                    ],
                    names=["file", "segment", "n_tokens", "documents", "data"],
                )
            full.clear()

        for rows_ in portions(batches):
            for name, ids in zip(rows_.column(0).to_pylist(), encoder.encode(rows_.column(1))):
                if held and size + len(ids) > segment:
                    closed()
                    keys, held, number, size = [], [], number + 1, 0
                    if sum(len(x) for _, x in full) + segment > TOGETHER:
                        yield from coded()
                keys.append(name)
                held.append(ids)
                size += len(ids)
        if held:
            closed()
            number += 1
        if full:
            yield from coded()

    rows.mapInArrow(
        write,
        f"file int, segment int, n_tokens long, documents array<struct<key: {kind}, n_tokens: long>>, data binary",
    ).write.parquet(path)


def together(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Rows, one segment each, that have ``TOGETHER`` ids at most; a larger one alone."""
    waiting, size = [], 0
    for batch in batches:
        for row, n_tokens in enumerate(batch.column("n_tokens").to_pylist()):
            if waiting and size + n_tokens > TOGETHER:
                yield waiting
                waiting, size = [], 0
            waiting.append(batch.slice(row, 1))
            size += n_tokens
    if waiting:
        yield waiting


def arrow_type(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["key"].dataType)


def read_token_files(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(file, segment, nth, key, first, n_tokens, ids) of every document.

    ``first``: ids before it in its segment; ``ids``: little-endian unsigned 32-bit.
    """
    segments = spark.read.parquet(path).select("file", "segment", "n_tokens", "documents", "data")
    kind = segments.schema["documents"].dataType.elementType["key"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_ in together(batches):
            found = decode_segments([row.column("data")[0].as_py() for row in rows_])
            for row in rows_:
                yield from documents_of(row, found.pop(0))

    def documents_of(row: pa.RecordBatch, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = row.column("documents")[0].values
        lengths = found.field("n_tokens").to_numpy()
        ends = np.cumsum(lengths)
        data = ids.astype("<u4").tobytes()
        n = len(found)
        for a in range(0, n, 2000):
            b = min(a + 2000, n)
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array([row.column(c)[0].as_py()] * (b - a), pa.int32()) for c in ("file", "segment")),
                    pa.array(range(a, b), pa.int32()),
                    found.field("key").slice(a, b - a),
                    pa.array(ends[a:b] - lengths[a:b]),
                    pa.array(lengths[a:b]),
                    pa.array(
                        [data[4 * (e - s) : 4 * e] for e, s in zip(ends[a:b].tolist(), lengths[a:b].tolist())],
                        pa.binary(),
                    ),
                ],
                names=["file", "segment", "nth", "key", "first", "n_tokens", "ids"],
            )

    return segments.mapInArrow(
        read,
        f"file int, segment int, nth int, key {kind}, first long, n_tokens long, ids binary",
    ).withColumnRenamed("key", key)


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """(of_file, of_segment, before): ids of all segments before each."""
    segments = spark.read.parquet(path).select("file", "segment", "n_tokens")
    files = running_starts(
        segments.groupBy("file").agg(F.sum("n_tokens").alias("n_tokens")), "file", "n_tokens"
    )
    inside = segments.selectExpr(
        "file AS of_file",
        "segment AS of_segment",
        "sum(n_tokens) OVER (PARTITION BY file ORDER BY segment) - n_tokens AS inside",
    )
    return inside.join(files, F.col("of_file") == F.col("of_place")).select(
        "of_file", "of_segment", (F.col("before") + F.col("inside")).alias("before")
    )
