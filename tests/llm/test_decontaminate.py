import random
import re

import pytest
from helpers import AWKWARD, documents, with_clashing_columns

from docketry.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(text, items, size=13):
    """(n_words, n_hit, ids) by trying every window at every place."""
    own, hit, ids = words(text), set(), set()
    for key, item in items:
        item = words(item)
        n = min(size, len(item))
        for i in range(len(item) - n + 1 if n else 0):
            for p in range(len(own) - n + 1):
                if own[p : p + n] == item[i : i + n]:
                    hit.update(range(p, p + n))
                    if key is not None:
                        ids.add(str(key))
    return len(own), len(hit), sorted(ids)


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def check(spark, data, items):
    got = sorted(
        (r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, r["items"], r.contaminated)
        for r in D.contamination(documents(spark, data), benchmark(spark, items)).collect()
    )
    wanted = []
    for key, text in data:
        n, hit, ids = slow(text, items)
        wanted.append((key if key is not None else -1, n, hit, ids, hit > 0 and 20 * hit >= n))
    assert got == sorted(wanted)
    return got


def test_equals_trying_every_window(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)] + ["the"] * 20
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 5, 12, 13, 14, 40])))) for i in range(12)]
    items[0] = (0, "Zebra quark")
    data = []
    for i in range(60):
        own = rng.choices(vocabulary, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            passage = words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(passage) - 13))
            at = rng.randint(0, len(own))
            own[at:at] = passage[a : a + rng.choice([12, 13, 14, 60])]
        data.append((i, " ".join(own).upper() if i % 2 else ", ".join(own)))
    got = check(spark, data, items)
    assert any(r[4] for r in got) and any(r[2] == 0 for r in got)


def test_periodic_and_equal_items(spark):
    items = [(1, "a b " * 10), (2, "a b " * 10), (3, "b a " * 7), (None, "x y z"), (5, None), (6, "!?")]
    data = [(1, "a b " * 30), (2, "a b " * 6), (3, "x y z"), (4, "z y x x y"), (5, "p x y z q")]
    check(spark, data, items)


def test_the_limit_is_a_twentieth(spark):
    passage = " ".join(f"p{i}" for i in range(13))
    data = [(n, passage + " o" * (n - 13)) for n in (259, 260, 261)]
    assert [r[4] for r in check(spark, data, [(1, passage)])] == [True, True, False]


def test_proximity(spark):
    items = D.read_items(benchmark(spark, [(1, "common rare common seldom")]))
    data = [(1, "rare x x seldom common"), (2, "seldom rare"), (3, "rare" + " x" * 9 + " seldom"), (4, "common rare")]
    index = D.build_index(documents(spark, data + [(5, "common " * 9)]), items)
    keys = {r.row: r.doc_key for r in index.where("term = -1").collect()}
    found = {keys[r.row]: r.distance for r in D.proximity_matches(index, items, slop=5).collect()}
    assert found == {1: 3, 2: 1}


def near(spark, data, items):
    found = D.contamination(documents(spark, data), benchmark(spark, items)).collect()
    return {r.doc_id: (r.n_near, r.near_items, r.n_hit) for r in found}


def test_proximity_of_words_far_apart_in_the_item(spark):
    item = "zebra the a of to in and is quark"
    filler = "the a of to in and is " * 9
    data = [(1, item), (2, "zebra the a of to to in and is quark"), (3, "zebra " + "x " * 13 + "quark"), (4, filler)]
    got = near(spark, data, [(1, item)])
    assert got == {1: (1, ["1"], 9), 2: (1, ["1"], 0), 3: (0, [], 0), 4: (0, [], 0)}


def test_proximity_with_a_word_that_no_document_has(spark):
    data = [(1, "zebra of quark"), (2, "quark zebra"), (3, "of of zebra of")]
    got = near(spark, data, [(1, "zebra unheard of quark")])
    assert got == {1: (1, ["1"], 0), 2: (1, ["1"], 0), 3: (0, [], 0)}


def test_proximity_by_window_and_repeated_terms(spark):
    item = "alpha beta " + "the " * 20 + "gamma delta"
    data = [(1, "gamma x delta"), (2, "beta x x alpha"), (3, "alpha delta"), (4, "the the the the")]
    got = near(spark, data, [(7, item), (8, item), (9, "the the")])
    assert got[1][:2] == got[2][:2] == (2, ["7", "8"]) and got[3][0] == got[4][0] == 0


def test_awkward_rows(spark):
    frame = with_clashing_columns(documents(spark, AWKWARD))
    tests = benchmark(spark, [(1, "same words here"), (2, "text without an id"), (3, "long " * 13)])
    got = {}
    for r in D.contamination(frame, tests).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_hit, r["items"]))
    assert got[None] == [(5, 4, ["2"])]
    assert got[4] == [(7, 3, ["1"])] * 2 and got[1] == got[2] == got[3] == [(0, 0, [])]
    assert got[7] == [(30_000, 30_000, ["3"])]
    kept = D.drop_contaminated(frame, tests)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 6]  # also the one without an id goes


@pytest.mark.parametrize("items", [[], [(1, None)]])
def test_empty_tables(spark, items):
    assert [r.n_hit for r in D.contamination(documents(spark, [(1, "a b c")]), benchmark(spark, items)).collect()] == [0]
    assert D.contamination(documents(spark, []), benchmark(spark, [(1, "a")])).collect() == []
