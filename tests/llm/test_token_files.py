import zlib

import numpy as np
import pytest
from helpers import AWKWARD, documents, with_clashing_columns
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docketry.llm import idcodec as C
from docketry.llm import token_files as T
from docketry.llm.queries import WORD_PIECES, tokenizer_path

PATH = tokenizer_path(WORD_PIECES)


@given(st.lists(st.sampled_from([0, 1, 2, 3, 7, 49_407, 2**32 - 1]), max_size=400), st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_round_trip(ids, repeat):
    ids = np.array(ids * repeat, np.int64)
    assert (C.decode_segment(C.encode_segment(ids)) == ids).all()


@pytest.mark.parametrize("table", [100, C.TABLE])
def test_many_blocks_in_several_groups(monkeypatch, table):
    monkeypatch.setattr(C, "TABLE", table)
    rng = np.random.default_rng(2)
    ids = np.concatenate([rng.zipf(1.3, 9000).clip(max=60_000), np.arange(500), np.tile([5, 6, 7], 900)])
    data = C.encode_segment(ids)
    assert (C.decode_segment(data) == ids).all()
    assert len(data) < 2 * len(ids) + 4 * len(np.unique(ids))


def test_predictions_pay():
    rng = np.random.default_rng(3)
    loop = np.tile(rng.integers(0, 1000, 50), 200)
    mixed = rng.permutation(loop)
    assert len(C.encode_segment(loop)) < len(C.encode_segment(mixed)) / 3


def test_damage_is_found():
    ids = np.random.default_rng(1).integers(0, 300, 5000)
    data = bytearray(C.encode_segment(ids))
    for at in (0, 4, len(data) // 2, len(data) - 9):
        broken = data.copy()
        broken[at] ^= 1
        with pytest.raises(C.Corrupt):
            C.decode_segment(bytes(broken))
    with pytest.raises(C.Corrupt):
        C.decode_segment(bytes(data[:-2]))


def test_blocks_are_independent():
    """A block's words do not change with the blocks before it."""
    rng = np.random.default_rng(4)
    tail = np.r_[rng.integers(0, 50, C.LEAST_BLOCK), np.arange(50)]
    a = C.encode_segment(np.r_[rng.integers(0, 50, C.LEAST_BLOCK - 50), np.arange(50), tail])
    b = C.encode_segment(np.r_[rng.integers(0, 50, C.LEAST_BLOCK - 50), np.arange(50), tail])
    index = 20 + 4 * 50
    words = [2 * int(np.frombuffer(x, "<u4", 6, index)[1::2][1:].sum()) for x in (a, b)]
    assert words[0] == words[1] and a[-words[0] :] == b[-words[1] :]


def encoded_whole(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


TEXTS = [
    "Hello, world! it's  two   spaces",
    "a\tb\r\nc\x0bd\xa0e f　g",
    "<|endoftext|> in a text <|startoftext|>",
    "don't we'll \n they've\n\n",
    "é ́x \U0001f600\U0001f600",
    " lead and trail ",
    "ÀÉÎ ß İ",
]


def test_words_give_the_ids_of_the_whole_text():
    with open(PATH, encoding="utf-8") as f:
        encoder = T.Encoder(f.read())
    for _ in range(2):
        for text, ids in zip(TEXTS, encoder.encode(TEXTS)):
            assert ids.tolist() == encoded_whole(text)


@pytest.mark.parametrize("segment", [10, T.SEGMENT])
def test_files_hold_the_corpus_in_order(spark, tmp_path, segment):
    data = [(i * 7 % 101, TEXTS[i % len(TEXTS)] + f" {i}") for i in range(101)]
    path = f"{tmp_path}/files"
    T.write_token_files(documents(spark, data), path, PATH, segment=segment)
    starts = {(r.of_file, r.of_segment): r.before for r in T.segment_starts(spark, path).collect()}
    got = sorted(
        (starts[r.file, r.segment] + r.first, r.doc_id, np.frombuffer(r.ids, "<u4").tolist())
        for r in T.read_token_files(spark, path).collect()
    )
    place, wanted = 0, []
    for key, text in sorted(data):
        ids = encoded_whole(text)
        wanted.append((place, key, ids))
        place += len(ids)
    assert got == wanted


def test_awkward_rows(spark, tmp_path):
    path = f"{tmp_path}/files"
    T.write_token_files(with_clashing_columns(documents(spark, AWKWARD)), path, PATH)
    got = [
        (-1 if r.doc_id is None else r.doc_id, zlib.crc32(r.ids)) for r in T.read_token_files(spark, path).collect()
    ]
    wanted = [
        (-1 if k is None else k, zlib.crc32(np.array(encoded_whole(t), "<u4").tobytes())) for k, t in AWKWARD
    ]
    assert sorted(got) == sorted(wanted)


def test_no_documents(spark, tmp_path):
    path = f"{tmp_path}/files"
    T.write_token_files(documents(spark, []), path, PATH)
    assert T.read_token_files(spark, path).collect() == []
    assert T.segment_starts(spark, path).collect() == []


def test_tasks_of_a_worker_share_an_encoder():
    with open(PATH, encoding="utf-8") as f:
        held = [f.read()]
    first, texts = T.encoder_of(held), ["one two", "", "two"]
    found = first.encode(texts)
    again = T.encoder_of(held)
    assert again is first
    for now, then, alone in zip(again.encode(texts), found, T.Encoder(held[0]).encode(texts)):
        assert now.tolist() == then.tolist() == alone.tolist()


def test_only_a_reader_builds_the_table_of_owners():
    """It is as large as all shares of all lanes; the bytes written do not need it."""
    assert not hasattr(C.Model(3, 7, reading=False), "owner")
    assert len(C.Model(3, 7, reading=True).owner) == 3 << C.LEAST_SHARES
    ids = np.random.default_rng(6).zipf(1.4, 5000).clip(max=900)
    data = C.encode_segment(ids)
    assert (len(data), zlib.crc32(data)) == (4934, 2242836251)  # as before
    assert (C.decode_segment(data) == ids).all()


ENCODERS = {}
CHARACTERS = "aZeEß'’stSTvmd09.,-!<|>&×÷ªºµÀÖØÞàöøÿœİıŉſḰ̌JjΣσςдЙ中 \u0085\t\x1f\x7f😀 \n"


@given(st.lists(st.text(st.sampled_from(CHARACTERS), max_size=12), min_size=1, max_size=20))
@settings(max_examples=150, deadline=None)
def test_words_are_cut_as_the_tokenizer_cuts_them(texts):
    if PATH not in ENCODERS:
        with open(PATH, encoding="utf-8") as f:
            ENCODERS[PATH] = T.Encoder(f.read()), Tokenizer.from_file(PATH)
    encoder, whole = ENCODERS[PATH]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == [*whole.encode(text, add_special_tokens=False).ids, 1]


def test_a_part_is_merged_once_whatever_stands_beside_it(monkeypatch):
    with open(PATH, encoding="utf-8") as f:
        encoder = T.Encoder(f.read())
    merged, seen = encoder.merged, []
    monkeypatch.setattr(encoder, "merged", lambda part: seen.append(part) or merged(part), raising=False)
    texts = ["Wherever, wherever", "(WHEREVER) wherever.", "wherever!"]
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode(texts)):
            assert ids.tolist() == encoded_whole(text)
    assert sorted(seen) == ["!", "(", ")", ",", ".", "wherever"]


def test_parts_forgotten_are_learned_again(monkeypatch):
    monkeypatch.setattr(T, "KNOWN_PARTS", 5)
    with open(PATH, encoding="utf-8") as f:
        encoder = T.Encoder(f.read())
    for a in range(0, 60, 10):
        texts = [f"word{i} {'x' * i} und{i}" for i in range(a, a + 10)] + TEXTS
        assert [x.tolist() for x in encoder.encode(texts)] == [encoded_whole(t) for t in texts]
        assert len(encoder.parts) < 60


def test_portions_join_batches_and_cut_long_ones(monkeypatch):
    monkeypatch.setattr(T, "PORTION", 10)
    texts = ["abc"] * 7 + ["", "x" * 25, "", "abcdefghij", "ab"]
    rows = [T.pa.record_batch([list(range(a, b)), texts[a:b]], names=["key", "text"]) for a, b in ((0, 2), (2, 2), (2, 12))]
    rows = [r.cast(T.pa.schema([("key", T.pa.int64()), ("text", T.pa.string())])) for r in rows]
    got = [x.column(1).to_pylist() for x in T.portions(rows)]
    assert [t for x in got for t in x] == texts
    assert [len(x) for x in got] == [4, 5, 2, 1]


def test_large_alphabets_leave_lanes_together():
    """Fewer lanes at once cost as many steps for each of more groups."""
    assert len(C.lane_groups(1024, 10_000)) == 1
    assert len(C.lane_groups(1024, 49_408)) <= 4


@pytest.mark.parametrize("size", [1, 2, 70, 900, 5000])
def test_owners_are_those_of_the_shares(size):
    rng = np.random.default_rng(size)
    seen = rng.zipf(1.3, (64, 3)).clip(max=size) - 1
    model = C.Model(3, size, reading=True)
    for steps in (0, 64):
        model.sum_up(seen[:steps])
        for lane, owner in enumerate(model.owner.reshape(3, -1)):
            counts = np.bincount(seen[:steps, lane], minlength=size)
            edges = C.below(np.r_[0, np.cumsum(counts)], np.arange(size + 1), steps, size)
            assert (owner == np.repeat(np.arange(size), np.diff(edges))).all()


@pytest.mark.parametrize("together", [1500, C.TOGETHER])
def test_segments_in_step_have_the_bytes_of_each_alone(monkeypatch, together):
    monkeypatch.setattr(C, "TOGETHER", together)
    rng = np.random.default_rng(8)
    sizes = [(3000, 40), (0, 1), (2100, 20_000), (1, 1), (5000, 700), (1024, 5)]
    segments = [rng.zipf(1.3, n).clip(max=most) for n, most in sizes]
    data = C.encode_segments(segments)
    assert data == [C.encode_segment(ids) for ids in segments]
    assert zlib.crc32(data[4]) == 570743110  # as before
    for ids, found in zip(segments, C.decode_segments(data), strict=True):
        assert (ids == found).all()


def test_segments_in_step_take_the_steps_of_one(monkeypatch):
    """Steps cost as much for few lanes as for many."""
    steps, settle = [], C.Coder.settle
    monkeypatch.setattr(C.Coder, "settle", lambda coder, lanes: steps.append(lanes) or settle(coder, lanes))
    segments = [np.random.default_rng(i).integers(0, 90, 3000) for i in range(4)]
    data = C.encode_segments(segments)
    assert (len(steps), max(steps)) == (1024, 12)
    C.decode_segments(data)
    assert (len(steps), max(steps)) == (2048, 12)


@pytest.mark.parametrize("most", [0, 1, 3, 1000])
def test_predictions_are_those_a_table_learns(most):
    rng = np.random.default_rng(most)
    symbols, places = rng.integers(0, most + 1, (3, 400)), rng.integers(0, 5, (3, 400)).astype(np.uint16)
    found = C.predictions(places, symbols, np.uint16)
    for lane in range(3):
        table = dict.fromkeys(range(5), (0, 0))
        for place, symbol, entry in zip(*(x[lane].tolist() for x in (places, symbols, found))):
            guess, trust = table[place]
            assert entry == 4 * guess + trust
            if guess == symbol:
                table[place] = guess, min(trust + 1, 3)
            else:
                table[place] = (guess, trust - 1) if trust > 1 else (symbol, 1)


def test_small_segments_are_read_together(monkeypatch):
    monkeypatch.setattr(T, "TOGETHER", 10)
    batches = [T.pa.record_batch([x], names=["n_tokens"]) for x in ([4, 5, 2], [], [8, 30, 1])]
    got = [[row.column(0)[0].as_py() for row in rows] for rows in T.together(batches)]
    assert got == [[4, 5], [2, 8], [30], [1]]


@pytest.mark.parametrize("at_once", [1, 3, 40])
def test_texts_are_put_together_in_pieces(monkeypatch, at_once):
    monkeypatch.setattr(T, "WORDS_GATHERED", at_once)
    with open(PATH, encoding="utf-8") as f:
        encoder = T.Encoder(f.read())
    texts = ["", *TEXTS, "", "one two three " * 9, "", ""]
    assert [ids.tolist() for ids in encoder.encode(texts)] == [encoded_whole(t) for t in texts]
