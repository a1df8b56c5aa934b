"""Text rules: keyword hits, labelled amounts, pattern matches with offsets.

Each function takes the SQL of its input and returns SQL. Patterns get the
``(?U)`` flag: word boundaries, digits and blanks follow Unicode whatever the
JVM's default is (it changed between Java 17 and 21).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from docketry.functions.sql import let, quoted

MONEY = "decimal(18,2)"

# Matches per slice of a running total. Appending to an array copies it, so a
# text with very many matches is summed slice by slice.
SLICE = 256

# Stands around matches while a text is split; Unicode has no character there.
MARK = "\uffff"

# White space of any script.
BLANKS = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def unicode_aware(pattern: str, ignore_case: bool = False) -> str:
    return ("(?iU)" if ignore_case else "(?U)") + pattern


def keyword_hits(text: str, groups: Iterable[Iterable[str]]) -> str:
    """Per group, how many of its lower-case keywords occur in the text."""
    counts = [
        " + ".join(f"int(contains(lowered_, {quoted(word)}))" for word in words) for words in groups
    ]
    return let("lowered_", f"lower({text})", f"array({', '.join(counts)})")


def any_keyword(text: str, keywords: Iterable[str]) -> str:
    """Whether one of the lower-case keywords occurs; stops at the first."""
    tests = " OR ".join(f"contains(lowered_, {quoted(word)})" for word in keywords)
    return let("lowered_", f"lower({text})", f"({tests})")


def is_blank(text: str) -> str:
    """NULL, empty or nothing but white space."""
    return f"coalesce(btrim({text}, {quoted(BLANKS)}) = '', true)"


def first_amount(text: str, patterns: Iterable[str]) -> str:
    """The first pattern whose first match parses as an amount; NULL if none."""
    found = [
        f"try_cast(replace(regexp_extract({text}, {quoted(unicode_aware(p, ignore_case=True))}, 1), ',', '') AS {MONEY})"
        for p in patterns
    ]
    return f"coalesce({', '.join(found)})"


def match_texts(text: str, pattern: str) -> str:
    """All matches of a pattern, in order."""
    return f"regexp_extract_all({text}, {quoted(unicode_aware(pattern))}, 0)"


def parts_of(text: str, pattern: str) -> str:
    """The text cut at every match: text before the first match, the match, text up to
    the next, and so on, always an odd number.

    One search: matches are put between marks, and the text is split at the marks. A
    split takes its pattern anew for each row, so only texts that hold the mark
    themselves are split by the pattern, after a search of their own.
    """
    marked = f"regexp_replace({text}, {quoted(unicode_aware(pattern))}, '{MARK}$0{MARK}')"
    own = (
        f"flatten(zip_with(split({text}, {quoted(unicode_aware(pattern))}, -1), {match_texts(text, pattern)}, "
        "(gap_, hit_) -> CASE WHEN hit_ IS NULL THEN array(gap_) ELSE array(gap_, hit_) END))"
    )
    return f"(CASE WHEN contains({text}, '{MARK}') THEN {own} ELSE split({marked}, '{MARK}', -1) END)"


def spans_in(parts: str) -> str:
    """The matches in ``parts_of`` as an array of (start, end, value); start is 0-based,
    end exclusive. Sizes are added up slice by slice: linear in the number of matches."""
    starts = in_slices(
        "lengths_",
        "int(0)",
        "array<int>",
        lambda at, size: f"struct({at} + {size} AS next, {at} AS out)",
    )
    many = let(
        "starts_",
        let("lengths_", f"transform({parts}, part_ -> length(part_))", starts),
        f"transform(sequence(1, size({parts}) - 1, 2), i_ -> struct(starts_[i_] AS start, "
        f"starts_[i_ + 1] AS end, {parts}[i_] AS value))",
    )
    one = (
        f"array(struct(length({parts}[0]) AS start, length({parts}[0]) + length({parts}[1]) AS end, {parts}[1] AS value))"
    )
    return f"(CASE WHEN size({parts}) = 3 THEN {one} ELSE {many} END)"


def in_slices(items: str, start: str, outputs: str, step: Callable[[str, str], str]) -> str:
    """An output for each item, with a state that goes from one to the next.

    ``step`` turns (state, item) into a struct of the next state and the output.
    Appending to an array copies it, so outputs are gathered slice by slice.
    """
    nothing = f"cast(array() AS {outputs})"
    one = let("step_", step("acc_.state", "item_"), "struct(step_.next AS state, concat(acc_.out, array(step_.out)) AS out)")

    def through(some: str, state: str) -> str:
        return f"aggregate({some}, struct({state} AS state, {nothing} AS out), (acc_, item_) -> {one})"

    part = through(f"slice({items}, i_ * {SLICE} + 1, {SLICE})", "all_.state")
    whole = (
        f"aggregate(sequence(0, int((size({items}) - 1) div {SLICE})), "
        f"struct({start} AS state, cast(array() AS array<{outputs}>) AS out), "
        f"(all_, i_) -> {let('part_', part, 'struct(part_.state AS state, concat(all_.out, array(part_.out)) AS out)')}, "
        "all_ -> flatten(all_.out))"
    )
    return f"(CASE WHEN size({items}) <= {SLICE} THEN {through(items, start)}.out ELSE {whole} END)"


def passes_luhn(value: str) -> str:
    """Luhn check over the digits of a match, blanks and dashes ignored."""
    return f"luhn_check(replace(replace({value}, ' ', ''), '-', ''))"


def percent(ratio: str) -> str:
    """0.33 as ``33%``."""
    return f"concat(string(int(round({ratio} * 100))), '%')"


def money_text(amount: str) -> str:
    """1234.5 as ``1,234.50``."""
    return f"format_number({amount}, 2)"
