"""Personal data: detection, context boost, second detector, redaction, audit.

Detection and redaction work inside the row, over the whole text, and need no
shuffle. Only the spans of a second detector are joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.recognizers import (
    CONTEXT_CHARS,
    FIRST_PASS,
    RECOGNIZERS,
    SECOND_PASS,
    SECOND_PASS_LABELS,
    SECOND_PASS_SCORE,
    Recognizer,
)
from docketry.functions.sql import case, let, quoted, struct
from docketry.functions.text import in_slices, match_texts, parts_of, passes_luhn, spans_in

SCORE = "decimal(3,2)"
SPAN_ROWS = f"array<struct<start:int,end:int,entity_type:string,score:{SCORE},recognizer:string>>"
# Characters of one block of the position axis in the overlap join.
BLOCK_CHARS = 1024


def spans_of(text: str = "text", recognizers: Sequence[Recognizer] = RECOGNIZERS) -> str:
    """Every match of every recognizer as an array, in order of start.

    Recognizers that share a pattern share its matches.
    """
    by_pattern: dict[str, list[Recognizer]] = {}
    for r in recognizers:
        by_pattern.setdefault(r.pattern, []).append(r)
    # A text is cut at the matches of each pattern; what stays whole has none.
    searches = ", ".join(
        f"struct({i} AS pattern, CASE WHEN {_worth_searching(text, *group)} THEN {parts_of(text, pattern)} END AS parts)"
        for i, (pattern, group) in enumerate(by_pattern.items())
    )
    found = f"filter(array({searches}), found_ -> size(found_.parts) > 1)"
    rows = case(
        [(f"found_.pattern = {i}", _rows_of(group, text)) for i, group in enumerate(by_pattern.values())]
    )
    placed = f"transform(matches_, found_ -> {let('hits_', spans_in('found_.parts'), rows)})"
    return let(
        "matches_",
        found,
        f"(CASE WHEN size(matches_) = 0 THEN cast(array() AS {SPAN_ROWS}) ELSE array_sort(flatten({placed})) END)",
    )


def _rows_of(recognizers: Sequence[Recognizer], text: str) -> str:
    """What the matches in ``hits_``, all of one pattern, become."""

    def rows(r: Recognizer) -> str:
        tests = []
        if r.luhn:
            tests.append(passes_luhn("m_.value"))
        if r.needs_context:
            tests.append(_in_context("m_.start", text, quoted(r.name), [r]))
        row = struct(
            start="m_.start", end="m_.end", entity_type=quoted(r.entity),
            score=f"cast({r.score} AS {SCORE})", recognizer=quoted(r.name),
        )
        kept = f"filter(hits_, m_ -> {' AND '.join(f'({t})' for t in tests)})" if tests else "hits_"
        return f"transform({kept}, m_ -> {row})"

    return f"concat({', '.join(map(rows, recognizers))})"


def _worth_searching(text: str, *recognizers: Recognizer) -> str:
    """False only where none of the recognizers can match."""
    if any(not r.literal for r in recognizers):
        return "true"
    return " OR ".join(f"contains({text}, {quoted(r.literal)})" for r in recognizers)


def _in_context(
    start: str, text: str, name: str, recognizers: Sequence[Recognizer], window_chars: int = CONTEXT_CHARS
) -> str:
    """Whether a context word of the named recognizer stands before ``start``."""
    tests = [
        f"{name} = {quoted(r.name)} AND ("
        + " OR ".join(f"contains(before_, {quoted(word)})" for word in r.context)
        + ")"
        for r in recognizers
        if r.context
    ]
    before = (
        f"lower(substring({text}, greatest({start} - {window_chars}, 0) + 1, "
        f"{start} - greatest({start} - {window_chars}, 0)))"
    )
    # Only recognizers with context words look around their matches.
    named = ", ".join(quoted(r.name) for r in recognizers if r.context) or "''"
    return case([(f"{name} IN ({named})", let("before_", before, f"({' OR '.join(tests) or 'false'})"))], "false")


def with_spans(documents: DataFrame, recognizers: Sequence[Recognizer] = RECOGNIZERS) -> DataFrame:
    return documents.withColumn("spans", F.expr(spans_of("text", recognizers)))


def _exploded(df: DataFrame, keys: Sequence[str], spans: Column | str) -> DataFrame:
    """One row per span. The outer form is used because the plain one would
    evaluate the spans a second time, in a filter of its own."""
    return df.select(*keys, F.inline_outer(spans)).where("start IS NOT NULL")


def detect_pii_spans(documents: DataFrame, recognizers: Sequence[Recognizer] = RECOGNIZERS) -> DataFrame:
    """One row per match: doc_id, entity_type, start, end, score, recognizer."""
    spans = with_spans(documents.select("doc_id", "text"), recognizers)
    return _exploded(spans, ["doc_id"], "spans").select(
        "doc_id", "entity_type", "start", "end", "score", "recognizer"
    )


def boosted(
    spans: str = "spans",
    text: str = "text",
    window_chars: int = CONTEXT_CHARS,
    boost: str = "0.35",
    recognizers: Sequence[Recognizer] = RECOGNIZERS,
) -> str:
    """The spans with in_context and boosted_score: raised (at most to 1) if a
    context word of their recognizer stands in the ``window_chars`` characters
    before them."""
    near = _in_context("s_.start", text, "s_.recognizer", recognizers, window_chars)
    raised = f"least(s_.score + cast({boost} AS {SCORE}), cast(1 AS {SCORE}))"
    row = struct(
        start="s_.start", end="s_.end", entity_type="s_.entity_type", recognizer="s_.recognizer",
        score="s_.score", in_context="near_",
        boosted_score=f"cast(CASE WHEN near_ THEN {raised} ELSE s_.score END AS {SCORE})",
    )
    return f"transform({spans}, s_ -> {let('near_', near, row)})"


def boost_spans_by_context(
    documents: DataFrame,
    window_chars: int = CONTEXT_CHARS,
    boost: str = "0.35",
    recognizers: Sequence[Recognizer] = RECOGNIZERS,
) -> DataFrame:
    """One row per match with its score before and after the look at its context."""
    spans = with_spans(documents.select("doc_id", "text"), recognizers)
    return _exploded(spans, ["doc_id"], F.expr(boosted("spans", "text", window_chars, boost, recognizers)))


def _blocks(start: str, end: str) -> Column:
    """The blocks of the position axis that [start, end) touches."""
    block = F.lit(BLOCK_CHARS)
    return F.sequence(
        F.floor(F.col(start) / block).cast("int"),
        F.floor((F.col(end) - 1) / block).cast("int"),
    )


def merge_second_pass_spans(first_pass: DataFrame, second_pass: DataFrame) -> DataFrame:
    """First-pass spans plus those of a second detector that overlap none.

    ``second_pass`` has doc_id, start, end, label. Two spans can only overlap
    inside a block of the position axis that both touch, so the anti join runs
    on (doc_id, block): a document with very many spans is spread over many
    keys, and a span is compared with its neighbours only. Equal spans are
    counted before the shuffle and multiplied out again at the end.
    """
    labels = F.create_map(*[F.lit(x) for pair in SECOND_PASS_LABELS.items() for x in pair])
    candidates = (
        second_pass.withColumn("entity_type", F.try_element_at(labels, F.col("label")))
        .where("entity_type IS NOT NULL")
        .groupBy("doc_id", "entity_type", "start", "end")
        .agg(F.count("*").alias("_copies"))
    )
    occupied = (
        first_pass.select("doc_id", "start", "end")
        .distinct()
        .select(
            "doc_id",
            F.col("start").alias("_start"),
            F.col("end").alias("_end"),
            F.explode(_blocks("start", "end")).alias("_block"),
        )
    )
    placed = candidates.withColumn("_touched", _blocks("start", "end")).select(
        "*", F.explode("_touched").alias("_block")
    )
    free_blocks = placed.join(
        occupied,
        (placed["doc_id"] == occupied["doc_id"])
        & (placed["_block"] == occupied["_block"])
        & (occupied["_start"] < placed["end"])
        & (occupied["_end"] > placed["start"]),
        "left_anti",
    )
    # A span in one block (nearly all) is settled; one that crosses a border
    # must be free in every block it touches.
    free = (
        free_blocks.groupBy("doc_id", "entity_type", "start", "end")
        .agg(F.count("*").alias("_free"), F.first("_copies").alias("_copies"), F.first(F.size("_touched")).alias("_all"))
        .where("_free = _all")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .select(
            "doc_id",
            "entity_type",
            "start",
            "end",
            F.lit(SECOND_PASS_SCORE).cast(SCORE).alias("score"),
            F.lit(SECOND_PASS).alias("detector"),
        )
    )
    kept = first_pass.select(
        "doc_id", "entity_type", "start", "end", "score", F.lit(FIRST_PASS).alias("detector")
    )
    return kept.unionByName(free)


# Covers per cut of a text: cutting a text walks to the place.
COVER_SLICE = 64


def _with_covers(df: DataFrame) -> DataFrame:
    """Add ``_covers``: the spans in ``_spans`` merged where they overlap, in
    order of start, each named after its span of the highest score (then the
    longest, then the first).

    A span starts a new cover if it starts at or after the end of all before it.
    """
    ordered = "array_sort(filter(_spans, s_ -> s_.start >= 0 AND s_.start < s_.end))"
    fresh = in_slices(
        "ordered_",
        "int(-1)",
        "array<boolean>",
        lambda top, span: f"struct(greatest({top}, {span}.end) AS next, {span}.start >= {top} AS out)",
    )
    heads = "filter(sequence(1, size(ordered_)), i_ -> fresh_[i_ - 1])"
    label = "struct(s_.score AS score, s_.end - s_.start AS length, -s_.start AS place, s_.entity_type AS entity_type)"
    cover = struct(
        start="group_[0].start",
        end="array_max(transform(group_, s_ -> s_.end))",
        entity_type=f"array_max(transform(group_, s_ -> {label})).entity_type",
    )
    upto = "coalesce(get(heads_, k_ + 1), size(ordered_) + 1)"
    covers = let(
        "heads_",
        let("fresh_", fresh, heads),
        f"transform(heads_, (h_, k_) -> {let('group_', f'slice(ordered_, h_, {upto} - h_)', cover)})",
    )
    alone = f"transform(ordered_, s_ -> {struct(start='s_.start', end='s_.end', entity_type='s_.entity_type')})"
    whole = let("ordered_", ordered, case([("size(ordered_) = 1", alone), ("size(ordered_) > 1", covers)]))
    return df.withColumn("_covers", F.expr(f"CASE WHEN size(_spans) > 0 THEN {whole} END"))


def _replaced(text: str = "text") -> str:
    """The text with every cover in ``_covers`` replaced by ``[ENTITY]``."""
    n = COVER_SLICE
    from_ = f"CASE WHEN i_ = 0 THEN 0 ELSE _covers[i_ * {n} - 1].end END"
    piece = f"substring({text}, from_ + 1, covers_[size(covers_) - 1].end - from_)"
    gap = "CASE WHEN k_ = 0 THEN from_ ELSE covers_[k_ - 1].end END"
    parts = (
        "array_join(transform(covers_, (c_, k_) -> concat("
        f"substring(piece_, {gap} - from_ + 1, c_.start - ({gap})), '[', c_.entity_type, ']')), '')"
    )
    cut = let("from_", from_, let("covers_", f"slice(_covers, i_ * {n} + 1, {n})", let("piece_", piece, parts)))
    whole = (
        f"concat(array_join(transform(sequence(0, int((size(_covers) - 1) div {n})), i_ -> {cut}), ''), "
        f"substring({text}, _covers[size(_covers) - 1].end + 1))"
    )
    return f"CASE WHEN size(_covers) > 0 THEN {whole} ELSE {text} END"


def _second_pass_lists(spans: DataFrame) -> DataFrame:
    """The spans of each document as one list; a document's spans are fewer
    than its characters."""
    return spans.groupBy(F.col("doc_id").alias("_doc")).agg(
        F.collect_list(
            F.struct(
                F.col("start").cast("int").alias("start"),
                F.col("end").cast("int").alias("end"),
                "entity_type",
                F.col("score").cast(SCORE).alias("score"),
            )
        ).alias("_more")
    )


def _with_all_spans(documents: DataFrame, second_pass: DataFrame | None, recognizers: Sequence[Recognizer]) -> DataFrame:
    """Add ``spans`` (first pass) and ``_spans``: those with their boosted
    scores, and the second pass where there is one."""
    found = with_spans(documents, recognizers).withColumn(
        "_spans",
        F.transform(
            F.expr(boosted("spans", "text", recognizers=recognizers)),
            lambda s: F.struct(
                s["start"].alias("start"),
                s["end"].alias("end"),
                s["entity_type"].alias("entity_type"),
                s["boosted_score"].alias("score"),
            ),
        ),
    )
    if second_pass is None:
        return found
    within = F.transform(
        "_more", lambda s: s.withField("end", F.least(s["end"], F.char_length("text")))
    )
    joined = found.join(
        _second_pass_lists(second_pass), F.col("doc_id") == F.col("_doc"), "left"
    ).withColumn("_more", within)
    return joined.withColumn("_spans", F.concat("_spans", F.coalesce("_more", F.slice("_spans", 1, 0)))).drop("_doc")


def redact_text(
    documents: DataFrame,
    second_pass: DataFrame | None = None,
    recognizers: Sequence[Recognizer] = RECOGNIZERS,
) -> DataFrame:
    """Add ``redacted_text``: no character of any span is left.

    Overlapping spans are merged to one cover, replaced by the type of its
    strongest span (scores after the look at the context). Without a second
    pass everything happens in the row. ``second_pass`` has doc_id, start, end,
    entity_type, score (see ``second_pass_spans``); only then are texts joined.
    """
    covered = _with_covers(_with_all_spans(documents, second_pass, recognizers))
    kept = [c for c in documents.columns if c != "redacted_text"]
    return covered.withColumn("redacted_text", F.expr(_replaced())).select(*kept, "redacted_text")


def second_pass_spans(merged: DataFrame) -> DataFrame:
    """What the second detector added to the first."""
    return merged.where(F.col("detector") == SECOND_PASS)


def redaction_audit(spans: DataFrame) -> DataFrame:
    """The span report without the raw values; sorted where the rows are, as the
    order only matters within a document."""
    return spans.select(
        "doc_id",
        "entity_type",
        "start",
        "end",
        (F.col("end") - F.col("start")).alias("char_count"),
        "detector",
    ).sortWithinPartitions("doc_id", "start", "end", "entity_type")


def entity_counts_of(text: str = "text", recognizers: Sequence[Recognizer] = RECOGNIZERS) -> str:
    """Matches per recognizer; only those that need their context are placed."""

    def row(r: Recognizer) -> str:
        if r.needs_context:
            count = f"size({spans_of(text, [r])})"
        elif r.luhn:
            count = f"size(filter({match_texts(text, r.pattern)}, hit_ -> {passes_luhn('hit_')}))"
        else:
            count = f"size({match_texts(text, r.pattern)})"
        count = case([(_worth_searching(text, r), count)], "0")
        return struct(entity_type=quoted(r.entity), matches=count)

    return f"filter(array({', '.join(map(row, recognizers))}), x_ -> x_.matches > 0)"


def entity_counts_per_document(documents: DataFrame, recognizers: Sequence[Recognizer] = RECOGNIZERS) -> DataFrame:
    """entity_count (overlaps included) and the sorted list of entity types,
    NULL if a document has none. Computed in the row: no shuffle."""
    counted = documents.select("doc_id", F.expr(entity_counts_of("text", recognizers)).alias("_found"))
    return counted.selectExpr(
        "doc_id",
        "coalesce(aggregate(_found, 0, (n_, x_) -> n_ + x_.matches), 0) AS entity_count",
        "CASE WHEN size(_found) > 0 THEN array_join(array_sort(array_distinct(_found.entity_type)), ',') END AS pii_types_found",
    )


def entity_counts_from_spans(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """The same from a table of spans, e.g. after the second pass."""
    per_document = spans.groupBy("doc_id").agg(
        F.count("*").alias("entity_count"),
        F.array_join(F.array_sort(F.collect_set("entity_type")), ",").alias("pii_types_found"),
    )
    return documents.select("doc_id").join(per_document, "doc_id", "left").select(
        "doc_id", F.coalesce("entity_count", F.lit(0)).alias("entity_count"), "pii_types_found"
    )


def entity_totals(spans: DataFrame) -> DataFrame:
    return spans.groupBy("entity_type").agg(F.count("*").alias("entities"))


def redacted_preview(documents: DataFrame, second_pass: DataFrame | None = None) -> DataFrame:
    """Redacted text next to its span report, an empty list if there is none;
    documents without a text are left out."""
    readable = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    return with_redacted_preview(readable, second_pass).drop("text")


def with_redacted_preview(documents: DataFrame, second_pass: DataFrame | None = None) -> DataFrame:
    """Add ``redacted_text`` and ``redaction_report``, both NULL without a text."""
    covered = _with_covers(_with_all_spans(documents, second_pass, RECOGNIZERS))

    def entries(spans: str, detector: str) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(
                s["entity_type"].alias("entity_type"),
                s["start"].alias("start"),
                s["end"].alias("end"),
                (s["end"] - s["start"]).alias("char_count"),
                F.lit(detector).alias("detector"),
            ),
        )

    report = entries("spans", FIRST_PASS)
    if second_pass is not None:
        more = entries("_more", SECOND_PASS)
        report = F.concat(report, F.coalesce(more, F.slice(report, 1, 0)))
    return covered.select(
        *documents.columns,
        F.expr(_replaced()).alias("redacted_text"),
        F.when(F.col("text").isNotNull(), report).alias("redaction_report"),
    )


def preview_from_artifacts(texts: DataFrame, reports: DataFrame) -> DataFrame:
    """Stored redacted texts with their stored reports (one row per document);
    a missing report becomes an empty list."""
    joined = texts.join(reports, "doc_id", "left")
    empty = F.from_json(F.lit("[]"), reports.schema["redaction_report"].dataType.simpleString())
    return joined.withColumn("redaction_report", F.coalesce("redaction_report", empty))
