import random
import re

import numpy as np
import pytest
import xxhash
from helpers import AWKWARD, documents, rows, with_clashing_columns

from docketry.llm import simhash as S


def slow_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """print -> smallest index reachable."""
    order = list(prints)
    root = {p: p for p in order}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(order):
        for b in order[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    return {p: find(p) for p in order}


@pytest.mark.parametrize("text", ["", "One", "A b C", "a b c d", "A b c d e É", "x y " * 500, "  a\x1cb c"])
def test_fingerprint(text):
    assert S.fingerprint(text) == slow_fingerprint(text)


def family(seed, n):
    """Random prints with chains and balls of close ones."""
    rng = random.Random(seed)
    prints = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(n // 3):
            prints.append(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
        for _ in range(n // 8):
            x ^= sum(1 << b for b in rng.sample(range(64), 4))
            prints.append(x)
    return sorted(set(prints))


@pytest.mark.parametrize("chunk", [20_000, 10])
def test_components_equal_all_pairs(spark, chunk):
    prints = family(3, 150)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    links = S.candidate_links(spark.createDataFrame([(p,) for p in signed], "print long"), chunk=chunk)
    stars = {r.node: r.root for r in S.star_components(links).collect()}
    groups, wanted = {}, {}
    for p in signed:
        groups.setdefault(stars.get(p, p), set()).add(p % 2**64)
    for p, root in slow_components(prints).items():
        wanted.setdefault(root, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_near_copies_share_a_component(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(99)) for _ in range(400)) for _ in range(20)]
    data = [(i, t) for i, t in enumerate(base)] + [(100 + i, t.upper()) for i, t in enumerate(base)]
    data += [(200 + i, t + " end") for i, t in enumerate(base)]
    got = {r.doc_id: r for r in S.near_duplicates(documents(spark, data)).collect()}
    prints = {d: slow_fingerprint(t) for d, t in data}
    assert {d: r.print % 2**64 for d, r in got.items()} == prints
    roots = slow_components(dict.fromkeys(prints.values()))
    least = {}
    for d in sorted(prints):
        least.setdefault(roots[prints[d]], d)
    assert {d: r.component_id for d, r in got.items()} == {d: least[roots[p]] for d, p in prints.items()}
    kept = S.drop_near_duplicates(documents(spark, data))
    assert rows(kept, "doc_id") == sorted(((d,) for d in set(least.values())), key=repr)


def test_awkward_rows(spark):
    frame = with_clashing_columns(documents(spark, AWKWARD))
    got = S.near_duplicates(frame)
    assert got.count() == len(AWKWARD)
    component = {r.doc_id: r.component_id for r in got.collect()}
    assert component[1] == component[2] == component[3] == 1 and component[5] == component[4] == 4
    assert component[None] is None
    kept = S.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 4, 6, 7]  # one of the two rows alike
    assert S.near_duplicates(documents(spark, [])).collect() == []


def test_group_spread_over_batches():
    import pyarrow as pa

    prints = np.arange(30, dtype=np.int64)
    keys = np.repeat([5, 9], [28, 2]).astype(np.int64)
    batches = [
        pa.RecordBatch.from_arrays([pa.array(keys[i : i + 4]), pa.array(prints[i : i + 4])], names=["g", "p"])
        for i in range(0, 30, 4)
    ]
    links = [tuple(r.values()) for b in S.verify_links(4)(iter(batches)) for r in b.to_pylist()]
    assert len(links) == 28
