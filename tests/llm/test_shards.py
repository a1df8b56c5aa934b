import re
import zlib
from collections import Counter

import pytest
from helpers import AWKWARD, documents, with_clashing_columns
from pyspark.sql import functions as F

from docketry.llm import shards


@pytest.mark.parametrize("bucket_bytes", [1 << 20, 2_000])
def test_every_row_has_its_place(spark, tmp_path, bucket_bytes):
    rows = [(i, "copy" if i % 3 else f"text number {i}") for i in range(500)]
    out = shards.shuffle_into_shards(
        documents(spark, rows), f"{tmp_path}/a", shards=7, bucket_bytes=bucket_bytes
    ).collect()
    assert sorted((r.record.doc_id, r.record.text) for r in out) == rows
    counts = Counter(r.shard for r in out)
    assert sorted(counts) == list(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    again = shards.shuffle_into_shards(
        documents(spark, rows), f"{tmp_path}/b", shards=7, bucket_bytes=bucket_bytes
    ).collect()
    place = {r.record.doc_id: (r.shard, r.slot) for r in out}
    assert place == {r.record.doc_id: (r.shard, r.slot) for r in again}
    other = shards.shuffle_into_shards(
        documents(spark, rows), f"{tmp_path}/c", shards=7, seed=8, bucket_bytes=bucket_bytes
    ).collect()
    assert place != {r.record.doc_id: (r.shard, r.slot) for r in other}


def test_order_is_mixed(spark, tmp_path):
    out = shards.shuffle_into_shards(
        documents(spark, [(i, "x" * 50) for i in range(2000)]), f"{tmp_path}/a", shards=10, bucket_bytes=6_600
    ).collect()
    ids = [r.record.doc_id for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    neighbours = sum(abs(a - b) == 1 for a, b in zip(ids, ids[1:]))
    assert neighbours < 12
    chi = sum((n - 20) ** 2 / 20 for n in Counter((r.shard, r.record.doc_id // 200) for r in out).values())
    assert chi < 160


@pytest.mark.parametrize("hot", [None, 7])
def test_a_repeated_id_is_many_buckets(spark, tmp_path, hot):
    rows = [(hot, "the same text " * 4)] * 1_000 + [(100 + i, f"text {i} " * 6) for i in range(1_000)]
    out = shards.shuffle_into_shards(documents(spark, rows), f"{tmp_path}/a", shards=5, bucket_bytes=10_000)
    got = out.withColumn("file", F.input_file_name()).collect()
    assert Counter((r.record.doc_id, r.record.text) for r in got) == Counter(rows)
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(400))
    tasks = Counter(re.search(r"part-(\d+)", r.file)[1] for r in got)
    assert max(tasks.values()) < 300


def test_awkward_rows(spark, tmp_path):
    frame = with_clashing_columns(documents(spark, AWKWARD))
    out = shards.shuffle_into_shards(frame, f"{tmp_path}/a", shards=40, bucket_bytes=1_000)
    assert len(out.columns) == 3
    got = Counter((r.record.doc_id, zlib.crc32((r.record.text or "").encode())) for r in out.collect())
    assert got == Counter((i, zlib.crc32((t or "").encode())) for i, t in AWKWARD)
    assert shards.shuffle_into_shards(documents(spark, []), f"{tmp_path}/b").collect() == []
