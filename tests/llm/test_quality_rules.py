import re
from dataclasses import replace

import corpus_pipeline
import pytest
from helpers import AWKWARD, documents, rows, with_clashing_columns
from hypothesis import given, settings
from hypothesis import strategies as st

from docketry.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_counts(text):
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        sum(line in lines[:i] for i, line in enumerate(lines)),
        len(covered),
    )


@given(st.lists(st.sampled_from(["a", "b", "é#", "|", "\n", " ", "\t", "\x1c", " "]), max_size=60))
@settings(max_examples=200, deadline=None)
def test_counts_equal_the_slow_ones(parts):
    text = " ".join(parts)
    assert Q.rule_counts(text) == slow_counts(text)


def test_lines_above_the_limits_are_removed(spark):
    own = [f"document {chr(97 + i % 26)}{chr(97 + i // 26)} has its own line of words " * 3 for i in range(40)]
    common = "Home | About | Contact us today for very many more details"
    data = [(i, f"{own[i]}\n{common}", "h") for i in range(30)]
    data += [(100 + i, "\n".join([common] * 9 + [f"only {own[i][9:11]}"]), "h") for i in range(3)]
    data += [(200, f"{common}\n{own[35]}", "other")]
    frame = documents(spark, data)
    limits = Q.Limits(max_repeat_percent=100)
    got = {r.doc_id: r for r in Q.quality_verdicts(frame, limits).collect()}
    assert got[0].removed_words == 0  # the host's first document keeps it
    assert all(got[i].removed_words == 12 and got[i].kept for i in range(1, 30))
    assert all(got[100 + i].removed_words == 108 and not got[100 + i].kept for i in range(3))
    assert got[200].removed_words == 0 and got[200].kept
    cleaned = {r.doc_id: r.text for r in Q.clean_documents(frame, limits).collect()}
    assert cleaned[1] == own[1] and cleaned[0] == data[0][1] and 100 not in cleaned and cleaned[200] == data[-1][1]


def test_limits_are_exclusive(spark):
    frame = documents(spark, [(i, f"shared line\nown{i}x") for i in range(20)])
    assert {r.removed_words for r in Q.quality_verdicts(frame).collect()} == {0}
    more = documents(spark, [(i, f"shared line\nown{i}x") for i in range(21)])
    assert rows(Q.quality_verdicts(more), "removed_words") == [(0,)] + [(2,)] * 20


@pytest.mark.parametrize("others", [0, 1_000])
def test_a_limit_means_the_same_in_a_hot_host(spark, others):
    passage = " ".join(f"p{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(51))
    letters = str.maketrans("0123456789", "abcdefghij")  # digits count as equal
    own = [" ".join(f"own{i}x{k}".translate(letters) for k in range(26)) for i in range(30 + others)]
    data = [(i, f"{own[i]}\nshared line", "h") for i in range(25)]
    data += [(i, f"{own[i]} {own[i][::-1]}\n{passage}", "h") for i in range(25, 29)]
    data += [(i, own[i], "h") for i in range(29, 30 + others)]
    data += [(5_000 + i, f"{own[i]} {own[i][::-1]}\n{passage}", "other") for i in range(3)]
    frame = documents(spark, data)
    limits = replace(Q.DEFAULT, max_repeat_percent=100)
    lost = {r.doc_id: r.removed_words for r in Q.quality_verdicts(frame, limits).collect()}
    assert {i: n for i, n in lost.items() if n} == dict.fromkeys(range(1, 25), 2) | dict.fromkeys(range(26, 29), 51)
    cleaned = {r.doc_id: r.text for r in corpus_pipeline.keep_regular(spark, frame, "").collect()}
    assert cleaned[0] == data[0][1] and all(cleaned[i] == own[i] for i in range(1, 25))
    with_passage = {i for i, t in cleaned.items() if passage in t}
    assert with_passage == {25, 5_000, 5_001, 5_002}


def test_awkward_rows(spark):
    frame = with_clashing_columns(documents(spark, AWKWARD))
    got = Q.quality_verdicts(frame).collect()
    assert len(got) == len(AWKWARD)
    assert all(r.base_failed and not r.kept for r in got)
    assert {r.rules.n_words for r in got if r.doc_id == 7} == {30_000}
    kept = Q.clean_documents(frame, Q.Limits(min_words=0, max_repeat_percent=100))
    assert kept.columns == frame.columns and kept.count() == len(AWKWARD)
    assert Q.quality_verdicts(documents(spark, [])).collect() == []


def test_documents_are_counted_by_id(spark):
    """Eleven documents, each there twice, are eleven; without ids each text is one."""
    shared = "a line that all of them share"
    twice = [(i % 11, f"{shared}\nown{chr(97 + i % 11)}") for i in range(22)]
    assert {r.removed_words for r in Q.quality_verdicts(documents(spark, twice)).collect()} == {0}
    more = [(i, f"{shared}\nown{chr(97 + i)}") for i in range(21)] * 2
    lost = [r.removed_words for r in Q.quality_verdicts(documents(spark, more)).collect()]
    assert sorted(lost) == [0] * 2 + [7] * 40
    nameless = [(None, f"{shared}\nown{chr(97 + i)}") for i in range(21)]
    assert {r.removed_words for r in Q.quality_verdicts(documents(spark, nameless)).collect()} == {7}
    same = [(None, f"{shared}\nown")] * 30
    assert {r.removed_words for r in Q.quality_verdicts(documents(spark, same)).collect()} == {0}


def test_repeated_rows_lose_each_line_once(spark):
    rows_ = [(i, "a common line of the host\n" + "w" * (i + 1)) for i in range(30)] + [
        (5, "a common line of the host\n" + "w" * 6)
    ]
    got = [r.removed_words for r in Q.quality_verdicts(documents(spark, rows_)).collect() if r.doc_id == 5]
    assert got == [6, 6]


@pytest.mark.parametrize("text", ["", "a", "a " * 8, "a " * 9])
def test_short_texts(text):
    assert Q.rule_counts(text) == slow_counts(text)
