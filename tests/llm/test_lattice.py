import math
import re
from collections import Counter
from functools import cache

import numpy as np
import pytest
from helpers import AWKWARD, documents, with_clashing_columns
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketry.llm import lattice as L
from docketry.llm import lattice_lm as M
from docketry.llm import sampling as S
from docketry.llm.queries import PIECES, tokenizer_path

PATH = tokenizer_path(PIECES)


@cache
def vocabulary():
    return L.load_vocabulary(PATH)


@cache
def names():
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=PATH)
    return {
        model.id_to_piece(i): i
        for i in range(model.get_piece_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
    }


def segmentations(text):
    """Every list of ids that spells the text."""
    if not text:
        yield []
        return
    single = text[0] in names() and text[0] != "\0"
    for n in range(1, min(16, len(text)) + 1):
        if text[:n] in names() and "\0" not in text[:n]:
            for rest in segmentations(text[n:]):
                yield [names()[text[:n]], *rest]
    if not single:
        raw = "▁" if text[0] == "\0" else text[0]
        for rest in segmentations(text[1:]):
            yield [*vocabulary().byte_ids[list(raw.encode())].tolist(), *rest]


def slow_log_sum(text, weights):
    sums = [weights[ids].sum() for ids in map(list, segmentations(text))]
    return np.logaddexp.reduce(sums)


@pytest.mark.parametrize("word", ["a", "the", "hello", "naïve", "x☃y", "don't", "▁▁", "12:30"])
def test_marginal_is_the_sum_over_all_segmentations(word):
    weights = vocabulary().zipf_weights()
    got = M.log_marginals(vocabulary(), [word, "other"], weights)[0]
    assert got == pytest.approx(slow_log_sum("▁" + word.replace("▁", "\0"), weights), abs=1e-9)


def test_weights_are_probabilities():
    assert np.exp(vocabulary().zipf_weights()).sum() == pytest.approx(1)


def test_expected_pieces_equal_enumeration():
    weights = vocabulary().zipf_weights()
    words, counts = ["hello", "na☃"], np.array([3, 2])
    wanted = np.zeros(vocabulary().size)
    for word, count in zip(words, counts):
        found = list(segmentations("▁" + word))
        whole = slow_log_sum("▁" + word, weights)
        for ids in found:
            for i in ids:
                wanted[i] += count * math.exp(weights[ids].sum() - whole)
    assert M.expected_pieces(vocabulary(), words, counts, weights) == pytest.approx(wanted, abs=1e-9)


def test_more_rounds_are_likelier():
    words, counts = ["hello", "help", "yellow", "shell"], np.array([5, 4, 2, 3])
    weights, last = vocabulary().zipf_weights(), -np.inf
    for _ in range(4):
        likelihood = (counts * M.log_marginals(vocabulary(), words, weights)).sum()
        assert likelihood >= last
        last = likelihood
        uses = M.expected_pieces(vocabulary(), words, counts, weights) + 1e-12
        weights = np.log(uses / uses.sum())


def slow_scores(data, held):
    def tokens(text):
        return (text or "").encode().lower().split() + [b"\n"]

    counts = Counter(t for key, text in data if key not in held for t in tokens(text))
    n, v = counts.total(), len(counts)
    return sorted(
        (
            -1 if key is None else key,
            len(tokens(text)),
            sum(counts[t] > 0 for t in tokens(text)),
            n,
            round(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(text)), 6),
        )
        for key, text in data
    )


@pytest.mark.parametrize("head", [3, 50_000])
def test_scores_do_not_depend_on_the_head(spark, head):
    data = [(100 + i, f"The cat {i} sat on THE mat{' again' * (i % 3)}") for i in range(30)] + AWKWARD
    held = {3, 5, 7, 103, 110}
    training = F.coalesce(~F.col("doc_id").isin(*held), F.lit(True))
    frame = with_clashing_columns(documents(spark, data))
    got = M.score_documents(frame, training, PATH, head=head).collect()
    assert slow_scores(data, held) == sorted(
        (-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
        for r in got
    )
    by_id = {r.doc_id or -1: r.score for r in got}
    again = {r.doc_id or -1: r.score for r in M.score_documents(frame, training, PATH, head=1).collect()}
    assert by_id == pytest.approx(again)
    assert all(s < 0 for s in by_id.values()) and by_id[7] < by_id[100]


def test_nothing_to_learn_from(spark):
    assert M.score_documents(documents(spark, []), F.lit(True), PATH).collect() == []
    row = M.score_documents(documents(spark, [(1, "a b")]), F.lit(False), PATH).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and row.score < 0


# --- sampled segmentations ---------------------------------------------------------


@given(st.lists(st.text(st.sampled_from("ab ▁é²._\n\t☃\U0001f600\x1c\xa0"), max_size=30), max_size=4))
@settings(max_examples=60, deadline=None)
def test_samples_decode_to_the_text(texts):
    import re

    tables = S.Lattices(vocabulary(), vocabulary().zipf_weights())
    pattern = re.compile(vocabulary().units)
    pieces = S.piece_bytes(PATH)
    split = [S.units_of(t, pattern) for t in texts]
    assert ["".join(u) for u in split] == [" " + t if t else "" for t in texts]
    for text, search in zip(texts, S.sampled_paths(tables, split, np.arange(len(texts), dtype=np.uint64), 3)):
        found = [
            tuple(S.piece_ids(tables, r.path[r.bounds[i] : r.bounds[i + 1]]).tolist()) for r, i in search.paths
        ]
        assert len(set(found)) == len(found) >= 1
        for ids in found:
            assert b"".join(pieces[i] for i in ids).removeprefix(b" ").decode() == text


def samples_of(text, runs, k):
    import re

    tables = S.Lattices(vocabulary(), vocabulary().zipf_weights())
    units = S.units_of(text, re.compile(vocabulary().units))
    seeds = S.mixed(np.arange(1, runs + 1, dtype=np.uint64))
    out = []
    for search in S.sampled_paths(tables, [units] * runs, seeds, k):
        threshold = search.best()[0]
        out.append(
            [
                (
                    tuple(S.piece_ids(tables, r.path[r.bounds[i] : r.bounds[i + 1]]).tolist()),
                    float(r.log_prob[i]),
                    float(r.values[i]),
                    threshold,
                )
                for r, i in search.paths
            ]
        )
    return out


def test_distribution_without_replacement():
    weights = vocabulary().zipf_weights()
    every = [tuple(s) for s in segmentations("▁ab▁at")]
    shares = np.exp([weights[list(s)].sum() for s in every])
    shares /= shares.sum()
    runs = samples_of("ab at", 6000, 2)
    first = Counter(r[0][0] for r in runs)
    second = Counter((r[0][0], r[1][0]) for r in runs)
    assert set(first) <= set(every)
    for s, p in zip(every, shares):
        assert first[s] / len(runs) == pytest.approx(p, abs=4 * math.sqrt(p * (1 - p) / len(runs)) + 1e-3)
    for a, p in zip(every, shares):
        for b, q in zip(every, shares):
            if a != b:
                both = p * q / (1 - p)
                assert second[a, b] / len(runs) == pytest.approx(both, abs=4 * math.sqrt(both / len(runs)) + 1e-3)
    for r in runs:
        assert r[0][2] >= r[1][2] >= r[1][3]
        for ids, log_prob, _, _ in r:
            assert log_prob == pytest.approx(math.log(shares[every.index(ids)]), abs=1e-9)


def test_inclusion_scores_estimate_sums_without_bias():
    """Sum of f / inclusion over the samples has the mean sum of f (here p)."""
    runs = samples_of("ab at", 6000, 3)
    estimates = [
        sum(math.exp(lp - S.log_inclusion(lp, t)) for _, lp, _, t in r) for r in runs
    ]
    assert np.mean(estimates) == pytest.approx(1, abs=0.02)


def test_fewer_segmentations_than_samples(spark):
    got = S.encode(documents(spark, [(1, "☃"), (2, ""), (3, None)]), PATH, samples=5).collect()
    by_key = {}
    for r in got:
        by_key.setdefault(r.doc_id, []).append(r)
    assert [len(r.ids) for r in by_key[2]] == [len(r.ids) for r in by_key[3]] == [0]
    assert all(r.log_inclusion == 0 for r in by_key[2])
    assert 1 <= len(by_key[1]) < 5 and all(r.log_inclusion == 0 for r in by_key[1])


def test_samples_do_not_depend_on_the_neighbours(spark):
    data = [(i, f"some words of document {i} and more of them") for i in range(40)]
    one = {(r.doc_id, r.sample): r.ids for r in S.encode(documents(spark, data), PATH).collect()}
    two = {(r.doc_id, r.sample): r.ids for r in S.encode(documents(spark, data[::-1][:7]), PATH).collect()}
    assert two == {k: one[k] for k in two} and len(two) == 14
    other = {(r.doc_id, r.sample): r.ids for r in S.encode(documents(spark, data), PATH, seed=12).collect()}
    assert other != one


def test_awkward_rows(spark):
    frame = with_clashing_columns(documents(spark, AWKWARD))
    out = S.encode(frame, PATH).withColumn("text", S.decode(spark, F.col("ids"), PATH))
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, set()).add(r.text)
    assert got == {k: {t or ""} for k, t in AWKWARD}
    assert S.encode(documents(spark, []), PATH).collect() == []


def test_lattices_that_do_not_fit_start_again(monkeypatch):
    import re

    monkeypatch.setattr(S, "MAX_NODES", 60)
    monkeypatch.setattr(S, "MAX_EDGES", 400)
    tables = S.Lattices(vocabulary(), vocabulary().zipf_weights())
    pattern = re.compile(vocabulary().units)
    pieces = S.piece_bytes(PATH)
    for text in ["one two three", "four five six seven", "x" * 300, "one two"]:
        (search,) = S.sampled_paths(tables, [S.units_of(text, pattern)], np.ones(1, np.uint64), 2)
        for r, i in search.paths:
            ids = S.piece_ids(tables, r.path[r.bounds[i] : r.bounds[i + 1]])
            assert b"".join(pieces[j] for j in ids.tolist()).decode() == " " + text


def test_texts_without_underscore_are_cut_alike():
    units = vocabulary().units
    pattern = re.compile(units)
    plain = re.compile(units.replace(L.WORD, r"\w").replace(L.SIGN, r"[^\w \n]"))
    for text in ["a b  c", "x1 -- y!\n\n z", "ü日本 ٣٤ ²½", "tab\there ▁ ", "", " ", "don't <s>[1]", "é 😀!"]:
        assert S.units_of(text, pattern, plain) == S.units_of(text, pattern)


def test_ids_of_many_paths_are_those_of_each():
    tables = S.Lattices(vocabulary(), vocabulary().zipf_weights())
    texts = ["plain words", "", "▁ and 😀😀 ü\x01", "more \x02 \x01"]
    searches = S.sampled_paths(
        tables, [S.units_of(t, re.compile(vocabulary().units)) for t in texts], np.arange(4, dtype=np.uint64), 1
    )
    found = searches[0].paths[0][0]
    together = S.split_ids(tables, found.path, found.bounds)
    each = [S.piece_ids(tables, found.path[a:b]) for a, b in zip(found.bounds[:-1], found.bounds[1:])]
    assert [x.tolist() for x in together] == [x.tolist() for x in each]


def test_units_met_again_outlive_those_met_once(monkeypatch):
    monkeypatch.setattr(S, "MAX_NODES", 120)
    monkeypatch.setattr(S, "MAX_EDGES", 800)
    tables = S.Lattices(vocabulary(), vocabulary().zipf_weights())
    built, add = [], tables.add
    monkeypatch.setattr(tables, "add", lambda units: add(units) and not built.extend(units))
    for i in range(40):
        units = [" often", f" once{i}", " also", "\n", f" 日{i}ü"]
        numbers = tables.ids(units)
        assert [list(tables.unit_ids)[n] for n in numbers] == units
        for unit, number in zip(units, numbers):
            alone = S.Lattices(vocabulary(), vocabulary().zipf_weights())
            alone.ids([unit])
            a, b = tables.first[number], alone.first[0]
            nodes = len(unit) + 1
            assert (tables.is_end[a : a + nodes] == alone.is_end[b : b + nodes]).all()
            e, f = tables.begin[a : a + nodes + 1], alone.begin[b : b + nodes + 1]
            assert (e - e[0] == f - f[0]).all()
            ours, wanted = slice(e[0], e[-1]), slice(f[0], f[-1])
            assert (tables.target[ours] - a == alone.target[wanted] - b).all()
            assert (tables.piece[ours] == alone.piece[wanted]).all()
            assert np.allclose(tables.log_share[ours], alone.log_share[wanted])
            assert np.allclose(tables.upto[ours], alone.upto[wanted], atol=1e-5)
    assert built.count(" often") == built.count(" also") == 1
    assert built.count(" once3") == 1


def test_ids_are_spelled_in_portions(monkeypatch):
    monkeypatch.setattr(S, "PORTION", 7)
    pieces = S.piece_bytes(PATH)
    letters = np.frombuffer(b"".join(pieces), np.uint8)
    ids = np.random.default_rng(5).integers(0, len(pieces), 100).astype(np.int32)
    for some in (ids, ids[:7], ids[:0]):
        data, ends = S.spelled(letters, np.array([len(p) for p in pieces]), some)
        assert [data[a:b] for a, b in zip(ends, ends[1:])] == [pieces[i] for i in some]
