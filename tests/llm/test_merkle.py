import hashlib
from collections import defaultdict

import pytest
from helpers import AWKWARD, documents, with_clashing_columns
from pyspark.sql import functions as F

from docketry.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    parts = []
    for name in FIELDS:
        value = row[name]
        parts.append("-" if value is None else f"{len(str(value).encode())}:{value}")
    return sha("".join(parts))


def climb(leaves, fanout):
    """The root, and of each leaf the siblings on its way."""
    at, siblings, level = list(range(len(leaves))), [[] for _ in leaves], leaves
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for i, place in enumerate(at):
            run = runs[place // fanout]
            siblings[i] += run[: place % fanout] + run[place % fanout + 1 :]
            at[i] = place // fanout
        level = [sha("".join(run)) for run in runs]
    return level[0], siblings


def expected(rows, fanout):
    trees = defaultdict(list)
    for row in rows:
        trees[row["source"]].append((row["doc_id"] is not None, row["doc_id"] or 0, leaf(row), row["doc_id"]))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    roots, inner = [], {}
    for name in names:
        held = sorted(trees[name], key=lambda x: x[:3])
        root, siblings = climb([x[2] for x in held], fanout)
        roots.append(root)
        inner[name] = (held, siblings)
    if not names:
        return []
    root, upper = climb(roots, fanout)
    out = []
    for i, name in enumerate(names):
        held, siblings = inner[name]
        for x, below in zip(held, siblings):
            out.append((x[3], name, x[2], roots[i], root, sha("".join(below + upper[i]))))
    return sorted(out, key=repr)


def found(frame, **options):
    made = merkle.manifest(frame, merkle.leaf_of(*map(F.col, FIELDS)), **options)
    rows = made.select(
        "doc_id",
        "source",
        "leaf",
        "subroot",
        "root",
        merkle.proof_of(F.col("path")).alias("proof"),
        (merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("verified"),
    ).collect()
    assert all(r.verified for r in rows)
    return sorted((tuple(r)[:6] for r in rows), key=repr)


@pytest.mark.parametrize("fanout, levels", [(3, 1), (3, 2), (2, 1), (4, 3)])
def test_against_brute_force(spark, fanout, levels):
    """Trees of 1 to 60 leaves: every shape of a short last subtree, many rounds."""
    sizes = {"a": 1, "b": 2, "c": 3, "d": 4, "é": 10, "Z": 28, "hot": 60, None: 7, "": 9}
    rows = [
        (1000 * k + i * 7 % 101, f"text {i % 5}" if i % 4 else None, s)
        for k, (s, n) in enumerate(sizes.items())
        for i in range(n)
    ]
    frame = documents(spark, rows).repartition(5)
    assert found(frame, fanout=fanout, levels=levels) == expected(frame.collect(), fanout)


def test_repeated_rows_are_many_leaves(spark):
    rows = [(7, "same", "s")] * 40 + [(7, "other", "s")] * 3 + [(None, "no id", "s")] * 5
    frame = documents(spark, rows).repartition(4)
    assert found(frame, levels=1) == expected(frame.collect(), 3)


def test_awkward_rows(spark):
    frame = with_clashing_columns(documents(spark, AWKWARD))
    for name in ("tree", "block", "place", "leaves", "path", "leaf", "members", "key_", "part", "line"):
        frame = frame.withColumn(name, F.lit("x"))
    assert found(frame, levels=1) == expected(frame.collect(), 3)
    assert found(documents(spark, [])) == []
    assert found(documents(spark, [(1, "alone")])) == expected(documents(spark, [(1, "alone")]).collect(), 3)


def test_tampering_breaks_the_proof(spark):
    frame = documents(spark, [(i, f"line\n{i}") for i in range(30)])
    fields = [F.col(c) for c in FIELDS[:-1]]
    made = merkle.manifest(
        frame,
        merkle.leaf_of(*fields, F.col("text")),
        carry={"shown": merkle.leaf_of(*fields, F.replace("text", F.when(F.col("doc_id") < 10, "\n").otherwise("#")))},
        levels=1,
    )
    rows = made.select("doc_id", (merkle.folded(F.col("shown"), F.col("path")) == F.col("root")).alias("ok"))
    assert {r.doc_id for r in rows.collect() if not r.ok} == set(range(10))


def test_field(spark):
    row = spark.range(1).select(
        merkle.field(F.lit("é\n")).alias("a"), merkle.field(F.lit(None)).alias("b"), merkle.field(F.lit(-12)).alias("c")
    ).first()
    assert tuple(row) == ("3:é\n", "-", "3:-12")
