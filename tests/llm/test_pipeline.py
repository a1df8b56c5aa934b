import corpus_pipeline
import pytest
from helpers import AWKWARD, documents
from pyspark.sql import functions as F

from docketry.llm import decontaminate, quality_rules
from docketry.llm.common import table


@pytest.fixture(scope="module")
def stages(spark, tables, tmp_path_factory):
    docs, out = table(spark, tables, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name))
        result = stage(spark, docs, tables)
        result.write.mode("overwrite").parquet(path)
        out[name] = docs, spark.read.parquet(path)
        docs = out[name][1]
    return out


def ids(frame):
    return {r.doc_id for r in frame.select("doc_id").collect()}


def test_all_but_the_last_keep_the_columns(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns, name
        assert after.dtypes == before.dtypes, name
        assert ids(after) <= ids(before)


def test_classifier_rejects_marked_documents(stages, spark, tables):
    before, after = stages["quality_classifier"]
    labels = {r.doc_id: r.quality for r in table(spark, tables, "labels").collect()}
    kept = ids(after)
    right = [(i in kept) == (labels[i] == 1) for i in ids(before) if i in labels]
    assert sum(right) >= 0.95 * len(right)


def test_rules_follow_the_verdicts(stages):
    before, after = stages["quality_rules"]
    kept = {r.doc_id for r in quality_rules.quality_verdicts(before).where("kept").collect()}
    assert ids(after) == kept
    assert after.where(F.col("n_chars") != F.char_length("text")).count() == 0


def test_one_of_each_group_stays(stages):
    from test_simhash import slow_components, slow_fingerprint

    before, after = stages["simhash_near_dedup"]
    prints = {r.doc_id: slow_fingerprint(r.text) for r in before.collect()}
    roots = slow_components(dict.fromkeys(prints.values()))
    least = {}
    for d in sorted(prints):
        least.setdefault(roots[prints[d]], d)
    assert ids(after) == set(least.values())


def test_contaminated_go(stages, spark, tables):
    from test_decontaminate import slow

    before, after = stages["benchmark_decontamination"]
    items = [(r.item_id, r.text) for r in table(spark, tables, "benchmark").collect()]
    clean = set()
    for r in before.collect():
        n, hit, _ = slow(r.text, items)
        if not (hit and 20 * hit >= n):
            clean.add(r.doc_id)
    assert ids(after) == clean
    found = decontaminate.contamination(before, table(spark, tables, "benchmark"))
    assert found.count() == before.count()


def test_every_document_is_encoded(stages):
    before, after = stages["sentencepiece"]
    assert ids(after) == ids(before)
    assert after.where("text_crc32 <> decoded_crc32").count() == 0
    assert after.groupBy("doc_id").agg(F.countDistinct("ids").alias("n")).where("n < 1").count() == 0


A = "the quick brown fox jumps over the lazy dog and runs far away from here"
B = "an entirely different text about boats that sail on the wide open sea at night"


def test_near_duplicates_are_decided_by_row(spark):
    """One row for each group, whatever ids its rows share with other groups."""
    rows = [(1, A), (2, A), (2, B), (1, A), (None, A)]
    kept = corpus_pipeline.keep_one_of_each(spark, documents(spark, rows), "").collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, A), (2, B)]
    nameless = corpus_pipeline.keep_one_of_each(spark, documents(spark, [(None, A), (None, A), (None, B)]), "").collect()
    assert sorted((r.doc_id, r.text) for r in nameless) == sorted([(None, A), (None, B)])
    sources = documents(spark, [(3, A, "x"), (3, A, "y"), (3, A, "y"), (3, A, None)])
    assert corpus_pipeline.keep_one_of_each(spark, sources, "").count() == 1


def test_contamination_is_decided_by_row(spark, tmp_path):
    from helpers import written

    item = spark.createDataFrame([(1, A)], "item_id long, text string")
    folder = written(spark, item, tmp_path, "benchmark")
    rows = [(1, A), (1, B), (None, A), (None, B), (None, None), (2, B), (2, B), (3, f"{B} {A}")]
    kept = corpus_pipeline.keep_unseen(spark, documents(spark, rows), folder).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted(
        [(1, B), (None, B), (None, None), (2, B), (2, B)], key=repr
    )


@pytest.mark.parametrize("data", [[], AWKWARD])
def test_stages_take_awkward_tables(spark, tables, data):
    docs = documents(spark, data)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        out.collect()
        if name != "sentencepiece":
            assert out.columns == docs.columns


def test_samples_are_decoded_in_a_stage_of_their_own(spark, tables):
    """A task of the last stage has one Python worker, not one for each of two steps."""
    from contextlib import redirect_stdout
    from io import StringIO

    out = corpus_pipeline.encode(spark, documents(spark, [(1, A), (2, B), (3, None)]), tables)
    with redirect_stdout(StringIO()) as plan:
        out.explain("simple")
    assert plan.getvalue().count("ArrowEvalPython") == 1
    assert "MapInArrow" not in plan.getvalue()
    assert out.where("text_crc32 <> decoded_crc32").count() == 0
    assert sorted(r.doc_id for r in out.where("sample = 0").collect()) == [1, 2, 3]


def test_decoding_keeps_nulls(spark):
    from docketry.llm import sampling
    from docketry.llm.queries import PIECES, tokenizer_path

    path = tokenizer_path(PIECES)
    lists = spark.createDataFrame([(1, None), (2, []), (3, [])], "n int, ids array<int>")
    texts = lists.select("n", sampling.decode(spark, F.col("ids"), path).alias("text")).collect()
    assert sorted((r.n, r.text) for r in texts) == [(1, None), (2, ""), (3, "")]
