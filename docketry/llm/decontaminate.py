"""Benchmark decontamination by a positional inverted index, DataFrame functions only.

The texts are read once. Every word that also occurs in a test item becomes a
posting (term, row, pos); the index is written as segments, one for each input
split and sorted by term, without a shuffle. A *window* is ``size`` consecutive
words of an item, or the whole of a shorter one.

1. Word counts come from the index. Each window names its two rarest positions.
2. The rarest term's list is read, moved by its offset and intersected with the
   list of the second: what is left are candidate diagonals (row, item, shift).
3. Every word of a candidate's item is looked up at its place in the index.
   Unbroken runs of matches as long as a window are exact phrase matches, and
   their union is what is hit.

4. Proximity matches: the two rarest different terms of a window that occur in
the documents at all stand, in any order, at most ``slop`` words further apart
than in the item. They are reported; the verdict is by exact matches alone.

Scale: only words of test items are stored. The frequent terms, most of the
index, are only read for rows that have a candidate: a blocked Bloom filter of
those rows (2.6 MB at most) thins the index before the exact join. Joins are on
(row, pos), so neither a frequent term nor a passage that a third of all
documents share gathers in a task.

Edge cases: null texts have no words; an item without words has no window; items
of equal words are matched once and all their ids are reported, null ids are
not; repeated rows are judged each; an empty table on either side gives no
matches (and one row for each document); other columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import LOWER, UPPER, content_of
from docketry.llm.urls import BLOCKS, WORDS, bits_of, block_of, bloom_filter
from docketry.session import work_folder

SIZE = 13
# Every ASCII character that is no digit or letter separates words.
SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words_of(text: Column) -> Column:
    """Lower-case words: runs of digits, a-z and characters beyond ASCII."""
    plain = F.translate(text, UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS))
    return F.coalesce(
        F.filter(F.split(plain, " +"), lambda w: w != ""), F.array().cast("array<string>")
    )


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    path = work_folder(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


@dataclass(frozen=True)
class TestItems:
    """``items``: (item, ids, n); ``terms``: (word, term); ``places``: (item, at, term)."""

    items: DataFrame
    terms: DataFrame
    places: DataFrame


def read_items(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> TestItems:
    items = stored(
        benchmark.select(F.col(key).cast("string").alias("id"), words_of(F.col(text)).alias("words"))
        .where(F.size("words") > 0)
        .groupBy("words")
        .agg(F.collect_set("id").alias("ids"))
        .select(
            F.monotonically_increasing_id().alias("item"), "ids", F.size("words").alias("n"), "words"
        ),
        "test-items",
    )
    words = items.select("item", F.posexplode("words").alias("at", "word"))
    terms = stored(
        words.select("word").distinct().withColumn("term", F.monotonically_increasing_id()),
        "test-terms",
    )
    places = stored(words.join(terms, "word").select("item", "at", "term"), "test-places")
    return TestItems(items.drop("words"), terms, places)


def build_index(
    documents: DataFrame, items: TestItems, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Postings (term, row, pos, doc_key).

    Each row also has one entry of term -1 with its number of words as ``pos``
    and its id as ``doc_key``.
    """
    worded = documents.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).alias("doc_key"),
        words_of(F.col(text)).alias("words"),
    )
    lengths = F.struct(F.size("words").alias("pos"), F.lit(None).cast("string").alias("word"))
    entries = worded.select(
        "row",
        "doc_key",
        F.explode(
            F.concat(
                F.array(lengths),
                F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("word"))),
            )
        ).alias("entry"),
    ).select("row", "doc_key", "entry.pos", "entry.word")
    known = items.terms.unionByName(
        items.terms.sparkSession.sql("SELECT CAST(NULL AS STRING) AS word, -1L AS term")
    ).withColumnRenamed("word", "of_word")
    return stored(
        entries.join(known, F.col("word").eqNullSafe(F.col("of_word")))
        .select(
            "term",
            "row",
            F.col("pos").cast("int").alias("pos"),
            F.when(F.col("term") == -1, F.col("doc_key")).alias("doc_key"),
        )
        .sortWithinPartitions("term", "row", "pos"),
        "postings",
    )


def rarest_positions(index: DataFrame, items: TestItems, size: int = SIZE) -> DataFrame:
    """(item, at, term, next_at, next_term): the two rarest places of each window.

    Windows with a word that no document has are left out.
    """
    counts = index.where("term >= 0").groupBy("term").agg(F.count(F.lit(1)).alias("postings"))
    # counts first: a frequent term is one row for each place, not for each window
    placed = items.places.join(counts, "term").join(items.items.select("item", "n"), "item")
    # a place belongs to the windows that start up to size - 1 before it
    first = F.greatest(F.col("at") - (size - 1), F.lit(0))
    last = F.least(F.col("at"), F.greatest(F.col("n") - size, F.lit(0)))
    windows = placed.withColumn("window", F.explode(F.sequence(first, last)))
    return (
        windows.groupBy("item", "window")
        .agg(
            F.first("n").alias("n"),
            F.sort_array(F.collect_list(F.struct("postings", "at", "term"))).alias("places"),
        )
        .where(F.size("places") == F.least(F.col("n"), F.lit(size)))
        .select(
            "item",
            F.col("places")[0].alias("a"),
            F.coalesce(F.get("places", F.lit(1)), F.col("places")[0]).alias("b"),
        )
        .select(
            "item",
            F.col("a.at").alias("at"),
            F.col("a.term").alias("term"),
            F.col("b.at").alias("next_at"),
            F.col("b.term").alias("next_term"),
        )
        .distinct()
    )


def candidates(index: DataFrame, rarest: DataFrame) -> DataFrame:
    """(row, item, shift): both rare words of a window stand at their places."""
    postings = index.select("term", "row", "pos")
    seen = postings.join(rarest, "term").select(
        "row",
        "item",
        (F.col("pos") - F.col("at")).alias("shift"),
        (F.col("pos") - F.col("at") + F.col("next_at")).alias("pos"),
        F.col("next_term").alias("term"),
    )
    seconds = postings.join(
        rarest.select(F.col("next_term").alias("term")).distinct(), "term", "left_semi"
    )
    return seen.join(seconds, ["row", "pos", "term"], "left_semi").select("row", "item", "shift").distinct()


def thinned(index: DataFrame, rows: DataFrame) -> DataFrame:
    """Postings of the given rows, and of a few others by chance."""
    row = F.col("row").cast("string")
    kept = bloom_filter(rows.select(row.alias("row")).distinct(), "row")
    passes = F.lit(True)
    for w, bits in enumerate(bits_of(row)[:WORDS]):
        passes = passes & (F.col(f"bloom_{w}").bitwiseAND(bits) == bits)
    return (
        index.withColumn("block", block_of(row, BLOCKS))
        .join(F.broadcast(kept), F.col("block") == F.col("bloom_block"))
        .where(passes)
        .select("term", "row", "pos")
    )


def phrase_matches(index: DataFrame, items: TestItems, size: int = SIZE) -> DataFrame:
    """(row, item, start, stop): unbroken runs of at least a window, exactly."""
    # stored, so that its true size decides how it meets the postings
    rarest = stored(rarest_positions(index, items, size), "rarest")
    found = stored(candidates(index, rarest), "candidates")
    wanted = (
        found.join(items.places, "item")
        .where(F.col("shift") + F.col("at") >= 0)
        .select("row", "item", "shift", "at", "term", (F.col("shift") + F.col("at")).alias("pos"))
    )
    matched = wanted.join(
        thinned(index.where("term >= 0"), found.select("row")), ["row", "pos", "term"], "left_semi"
    )
    run = Window.partitionBy("row", "item", "shift").orderBy("at")
    return (
        matched.withColumn("run", F.col("at") - F.row_number().over(run))
        .groupBy("row", "item", "shift", "run")
        .agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"))
        .join(items.items.select("item", "n"), "item")
        .where(F.col("stop") - F.col("start") >= F.least(F.col("n"), F.lit(size)))
        .select("row", "item", "start", "stop")
    )


def rarest_pairs(index: DataFrame, items: TestItems, size: int = SIZE) -> DataFrame:
    """(item, a, b, apart): the two rarest different terms of each window among
    those that have postings, and their smallest distance in the window."""
    counts = index.where("term >= 0").groupBy("term").agg(F.count(F.lit(1)).alias("postings"))
    # equal counts in the order of the words, which no numbering of terms changes
    placed = (
        items.places.join(counts, "term")
        .join(items.terms, "term")
        .join(items.items.select("item", "n"), "item")
    )
    first = F.greatest(F.col("at") - (size - 1), F.lit(0))
    last = F.least(F.col("at"), F.greatest(F.col("n") - size, F.lit(0)))
    places = lambda term: F.filter("places", lambda p: p["term"] == F.col(term))
    return (
        placed.withColumn("window", F.explode(F.sequence(first, last)))
        .groupBy("item", "window")
        .agg(F.sort_array(F.collect_list(F.struct("postings", "word", "term", "at"))).alias("places"))
        .withColumn("a", F.col("places")[0]["term"])
        .withColumn("b", F.get(F.filter("places", lambda p: p["term"] != F.col("a")), F.lit(0))["term"])
        .where(F.col("b").isNotNull())
        .select(
            "item",
            "a",
            "b",
            F.array_min(
                F.transform(
                    places("a"),
                    lambda p: F.array_min(F.transform(places("b"), lambda q: F.abs(p["at"] - q["at"]))),
                )
            ).alias("apart"),
        )
        .groupBy("item", "a", "b")
        .agg(F.max("apart").alias("apart"))
    )


def proximity_matches(
    index: DataFrame, items: TestItems, slop: int = 5, size: int = SIZE
) -> DataFrame:
    """(row, item, distance): the smallest distance of the two rarest terms of a
    window, in any order, up to ``slop`` more than in the item itself."""
    pairs = stored(rarest_pairs(index, items, size), "rarest-pairs")
    postings = index.where("term >= 0").select("term", "row", "pos")
    # one row for each pair of terms, however many items have it
    wanted = pairs.groupBy("a", "b").agg((F.max("apart") + slop).alias("reach"))
    near = F.floor(F.col("pos") / (size + slop))
    left = postings.join(wanted, F.col("term") == F.col("a")).select(
        "row", "a", "b", "reach", F.col("pos").alias("left_pos"),
        F.explode(F.array(near - 1, near, near + 1)).alias("cell"),
    )
    right = postings.join(
        wanted.select(F.col("b").alias("term")).distinct(), "term", "left_semi"
    ).select("row", F.col("term").alias("b"), F.col("pos").alias("right_pos"), near.alias("cell"))
    distance = F.abs(F.col("left_pos") - F.col("right_pos"))
    found = (
        left.join(right, ["row", "b", "cell"])
        .where(distance <= F.col("reach"))
        .groupBy("row", "a", "b")
        .agg(F.min(distance).alias("distance"))
    )
    return (
        found.join(pairs, ["a", "b"])
        .where(F.col("distance") <= F.col("apart") + slop)
        .groupBy("row", "item")
        .agg(F.min("distance").alias("distance"))
    )


def ids_of(matches: DataFrame, items: TestItems, name: str) -> DataFrame:
    """(row, name): the ids of the items matched in a row, sorted as text."""
    return (
        matches.select("row", "item")
        .distinct()
        .join(items.items.select("item", "ids"), "item")
        .select("row", F.explode("ids").alias("id"))
        .groupBy("row")
        .agg(F.sort_array(F.collect_set("id")).alias(name))
    )


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    size: int = SIZE,
    percent: int = 5,
    key: str = "doc_id",
    text: str = "text",
    slop: int | None = 5,
) -> DataFrame:
    """(key, n_words, n_hit, n_items, items, contaminated, n_near, near_items) of every row.

    ``items``: ids of the items with exact matches, sorted as text; ``near_items``:
    of those with proximity matches, none sought if ``slop`` is null. Contaminated:
    at least ``percent`` of the words are hit.
    """
    items = read_items(benchmark)
    index = build_index(documents, items, key, text)
    matches = stored(phrase_matches(index, items, size), "matches")
    reached = Window.partitionBy("row").orderBy("start")
    hits = (
        matches.groupBy("row", "start")
        .agg(F.max("stop").alias("stop"))
        .withColumn(
            "before",
            F.coalesce(
                F.max("stop").over(reached.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .groupBy("row")
        .agg(
            F.sum(
                F.greatest(F.col("stop") - F.greatest(F.col("start"), F.col("before")), F.lit(0))
            ).alias("n_hit")
        )
    )
    named = ids_of(matches, items, "items")
    if slop is None:
        near = named.select("row", F.array().cast("array<string>").alias("near_items"))
    else:
        near = ids_of(stored(proximity_matches(index, items, slop, size), "near"), items, "near_items")
    n_words, n_hit = F.col("pos").cast("long"), F.coalesce("n_hit", F.lit(0)).cast("long")
    return (
        index.where("term = -1")
        .select("row", "doc_key", "pos")
        .join(hits, "row", "left")
        .join(named, "row", "left")
        .join(near, "row", "left")
        .withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
        .withColumn("near_items", F.coalesce("near_items", F.array().cast("array<string>")))
        .select(
            F.col("doc_key").alias(key),
            n_words.alias("n_words"),
            n_hit.alias("n_hit"),
            F.size("items").cast("long").alias("n_items"),
            "items",
            ((n_hit > 0) & (n_hit * 100 >= n_words * percent)).alias("contaminated"),
            F.size("near_items").cast("long").alias("n_near"),
            "near_items",
        )
    )


def drop_contaminated(
    documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows that are not contaminated themselves. The verdict depends on the text
    alone, so rows are matched by it (by two hashes), whatever their ids."""
    judged = documents.select(content_of(F.col(text)).alias("content"), F.col(text).alias("judged"))
    gone = (
        contamination(judged, benchmark, key="content", text="judged", slop=None)
        .where("contaminated")
        .select(F.col("content").alias("dropped"))
        .distinct()
    )
    return documents.join(gone, content_of(F.col(text)) == F.col("dropped"), "left_anti")
