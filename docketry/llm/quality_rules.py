"""Quality rules per document, and line frequency across the documents of a host.

The rules count words, symbols, repeated lines and repeated 8-word windows of a
text. Lines are normalised (lower case, digits as 0, single spaces), hashed with
their host, and each document (id) counts once per line. A line in more than
``max_docs`` documents of its host, or in more than ``max_docs_long`` if it has more
than ``long_words`` words, is removed everywhere but in the host's document of the
smallest id that has it. Limits are counts of documents, so they mean the same in a
host of any size. A document that keeps less than ``min_left_percent`` of its words
is depleted.

Scale: texts are taken apart into lines once; the lines are stored as numbers.
Rows of a line are counted first, combined before the shuffle; only lines whose
rows exceed a limit are then counted by distinct document, spread by line and
document, so a line of a third of all documents is many groups. The stored lines
meet the few lines above the limits in a join whose hot keys adaptive execution
splits; only removed lines are gathered per document. The rules run in the row, over
Arrow batches.

Edge cases: null and empty texts have no words and fail the rules; null hosts
are one host; rows of one id are one document for the counts, rows without an id
one for each different text; rows of equal id, host and text share a verdict; a line
that only null ids hold is removed from all; an empty table gives no rows; other
columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.session import work_folder

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULE_TYPE = T.StructType([T.StructField(name, T.LongType()) for name in COUNTS])
BLANKS = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Limits:
    min_words: int = 20
    max_repeat_percent: int = 30
    max_docs: int = 20
    min_left_percent: int = 30
    long_words: int = 50
    max_docs_long: int = 3

    def exceeded(self, docs: Column, words: Column) -> Column:
        return (docs > self.max_docs) | ((words > self.long_words) & (docs > self.max_docs_long))


DEFAULT = Limits()


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in the list.

    Equal windows get equal numbers by doubling: numbers of two neighbouring
    runs make the number of the run twice as long. Exact, without hashes.
    ``window`` is a power of two.
    """
    if len(words) <= window:
        return 0
    seen: dict[bytes, int] = {}
    numbers = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    length = 1
    while length < window:
        pairs = numbers[:-length] * (int(numbers.max()) + 1) + numbers[length:]
        values, numbers = np.unique(pairs, return_inverse=True)
        if len(values) == len(pairs):
            return 0
        length *= 2
    starts = np.flatnonzero(np.bincount(numbers)[numbers] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def rule_counts(text: str | None) -> tuple[int, int, int, int, int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    blanks = len(data) - sum(map(len, words))
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text or "") - blanks,
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


@F.pandas_udf(RULE_TYPE)
def rule_features(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([rule_counts(t) for t in texts], columns=list(COUNTS), dtype="int64")


def normalised(line: Column) -> Column:
    digits = F.translate(F.lower(line), "123456789", "000000000")
    return F.btrim(F.regexp_replace(digits, BLANKS, " "))


def line_words(line: Column) -> Column:
    """Words of a normalised line."""
    return F.when(line == "", 0).otherwise(
        F.char_length(line) - F.char_length(F.replace(line, F.lit(" "))) + 1
    )


def line_hash(host: Column, line: Column) -> Column:
    return F.xxhash64(F.coalesce(host, F.lit("")), F.lit("\n"), line)


def content_key(key: str, text: str, host: str) -> Column:
    """One number for rows of equal id, host and text."""
    return F.xxhash64(F.col(key), F.col(host), F.col(text))


def stored_lines(documents: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """(row_key, doc_key, nth, words, line) of every line with a word; ``line`` is
    its hash with the host."""
    path = work_folder(documents.sparkSession, "lines")
    documents.select(
        content_key(key, text, host).alias("row_key"),
        F.col(key).alias("doc_key"),
        F.col(host).alias("doc_host"),
        F.posexplode(F.transform(F.split(F.col(text), "\n"), normalised)).alias("nth", "content"),
    ).where("content <> ''").select(
        "row_key",
        "doc_key",
        "nth",
        line_words(F.col("content")).alias("words"),
        line_hash(F.col("doc_host"), F.col("content")).alias("line"),
    ).write.parquet(path)
    return documents.sparkSession.read.parquet(path)


def frequent_lines(lines: DataFrame, limits: Limits) -> DataFrame:
    """(line, spared) of the lines above the limits."""
    rows = lines.groupBy("line").agg(F.count(F.lit(1)).alias("rows"), F.first("words").alias("words"))
    likely = rows.where(limits.exceeded(F.col("rows"), F.col("words"))).select("line")
    nameless = F.when(F.col("doc_key").isNull(), F.col("row_key"))
    return (
        lines.join(likely, "line", "left_semi")
        .groupBy("line", "doc_key", nameless.alias("nameless"))
        .agg(F.first("words").alias("words"))
        .groupBy("line")
        .agg(
            F.count(F.lit(1)).alias("docs"),
            F.min("doc_key").alias("spared"),
            F.first("words").alias("words"),
        )
        .where(limits.exceeded(F.col("docs"), F.col("words")))
        .select("line", "spared")
    )


def removed_lines(documents: DataFrame, limits: Limits, key: str, text: str, host: str) -> DataFrame:
    """(removed_from, removed_words, removed): hashes of the lines a row loses."""
    lines = stored_lines(documents, key, text, host)
    return (
        lines.join(frequent_lines(lines, limits), "line")
        .where(~F.coalesce(F.col("spared") == F.col("doc_key"), F.lit(False)))
        .select(F.col("row_key").alias("removed_from"), "nth", "words", "line")
        .distinct()  # rows of equal content
        .groupBy("removed_from")
        .agg(F.sum("words").alias("removed_words"), F.collect_set("line").alias("removed"))
    )


def judged(rows: DataFrame, limits: Limits) -> DataFrame:
    """Adds base_failed and kept to rows with the struct rules and removed_words."""
    words, lost = F.col("rules.n_words"), F.coalesce("removed_words", F.lit(0))
    failed = (words < limits.min_words) | (
        F.col("rules.n_repeat_words") * 100 > words * limits.max_repeat_percent
    )
    depleted = (words - lost) * 100 < words * limits.min_left_percent
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def quality_verdicts(
    documents: DataFrame,
    limits: Limits = DEFAULT,
    key: str = "doc_id",
    text: str = "text",
    host: str = "source",
) -> DataFrame:
    """(key, rules, removed_words, base_failed, kept) of every row; no text moves."""
    rows = documents.select(
        F.col(key),
        content_key(key, text, host).alias("row_key"),
        rule_features(F.col(text)).alias("rules"),
    ).join(
        removed_lines(documents, limits, key, text, host),
        F.col("row_key") == F.col("removed_from"),
        "left",
    )
    return judged(rows, limits).select(
        key, "rules", F.coalesce("removed_words", F.lit(0)).alias("removed_words"), "base_failed", "kept"
    )


def clean_documents(
    documents: DataFrame,
    limits: Limits = DEFAULT,
    key: str = "doc_id",
    text: str = "text",
    host: str = "source",
) -> DataFrame:
    """The kept rows in their own columns, without the removed lines."""
    rows = documents.select(
        F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("document"),
        content_key(key, text, host).alias("row_key"),
    ).join(
        removed_lines(documents, limits, key, text, host),
        F.col("row_key") == F.col("removed_from"),
        "left",
    )
    old, of = F.col(f"document.`{text}`"), F.col(f"document.`{host}`")
    new = F.when(F.col("removed").isNull(), old).otherwise(
        F.array_join(
            F.filter(
                F.split(old, "\n"),
                lambda line: ~F.array_contains(F.col("removed"), line_hash(of, normalised(line))),
            ),
            "\n",
        )
    )
    return (
        judged(rows.withColumn("rules", rule_features(old)), limits)
        .where("kept")
        .withColumn("document", F.col("document").withField(f"`{text}`", new))
        .select("document.*")
    )
