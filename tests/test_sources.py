"""Files in and out: raw objects, pages, artifacts, model results."""

from pyspark.sql import functions as F

from docketry.functions import fixed_values as V
from docketry.operators.gates import guardrail_screen
from docketry.operators.extraction import extraction_conformance, output_pii_scan, stamp_provenance
from docketry.sources import artifacts, raw_objects
from docketry.sources.extractions import load_extractions
from docketry.sources.pages import assemble_pages
from docketry.sources.raw_objects import scan_raw_documents


def test_scan(spark, tmp_path, monkeypatch):
    for doc, name, content in [("7", "bank.pdf", b"%PDF-1.4 x"), ("8", "pay.pdf", b"PN"), ("9", "big.pdf", b"%PDF" + b" " * 100)]:
        folder = tmp_path / "raw" / doc
        folder.mkdir(parents=True)
        (folder / name).write_bytes(content)
    monkeypatch.setattr(V, "MAX_FILE_BYTES", 50)
    monkeypatch.setattr(V, "MIN_FILE_BYTES", 5)
    found = scan_raw_documents(spark, str(tmp_path / "raw"), "*.pdf").orderBy("doc_id")
    assert [(r.doc_id, r.filename, r.size_bytes, bytes(r.magic)) for r in found.collect()] == [
        ("7", "bank.pdf", 10, b"%PDF"), ("8", "pay.pdf", 2, b"PN"), ("9", "big.pdf", 104, b"%PDF"),
    ]
    documents = found.withColumns(
        {"content_type": F.lit("application/pdf"), "magic": F.decode("magic", "UTF-8"), "text": F.lit("net pay")}
    )
    assert [r.reason for r in guardrail_screen(documents).orderBy("doc_id").collect()] == [
        None, V.REJECT_MAGIC, V.REJECT_TOO_LARGE,
    ]


def test_scan_reads_four_bytes_of_a_file_of_any_size(spark, tmp_path):
    folder = tmp_path / "raw" / "a doc %41 #1"
    folder.mkdir(parents=True)
    with open(folder / "b\u00fcg file.pdf", "wb") as file:
        file.write(b"%PDF-1.7")
        file.truncate(3 << 30)  # sparse: over the 2 GB that a whole content may have
    (folder / "empty.pdf").write_bytes(b"")
    found = {r.filename: (r.doc_id, r.size_bytes, bytes(r.magic)) for r in scan_raw_documents(spark, str(tmp_path / "raw")).collect()}
    assert found == {
        "b\u00fcg file.pdf": ("a doc %41 #1", 3 << 30, b"%PDF"), "empty.pdf": ("a doc %41 #1", 0, b""),
    }


def test_scan_lists_below_many_entries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(raw_objects, "ENTRIES_IN_A_TASK", 3)
    for doc in range(10):
        folder = tmp_path / "raw" / str(doc) / "v1"
        folder.mkdir(parents=True)
        (folder / "f.pdf").write_bytes(b"%PDF")
        (folder / "_f.pdf").write_bytes(b"%PDF")
        (folder / "f.txt").write_bytes(b"text")
    (tmp_path / "raw" / "loose.pdf").write_bytes(b"12")
    (tmp_path / "none").mkdir()
    found = scan_raw_documents(spark, str(tmp_path / "raw"), "*.pdf")
    assert found.rdd.getNumPartitions() == 4
    assert sorted((r.doc_id, r.filename, r.size_bytes) for r in found.collect()) == (
        [("raw", "loose.pdf", 2)] + [("v1", "f.pdf", 4)] * 10
    )
    assert scan_raw_documents(spark, "file:" + str(tmp_path / "none")).count() == 0


def test_scan_by_whole_content_agrees(spark, tmp_path):
    for doc in range(5):
        folder = tmp_path / "raw" / str(doc)
        folder.mkdir(parents=True)
        (folder / "f.pdf").write_bytes(b"%PDF-1.4"[: doc * 2 + 1])
    ranged, whole = (
        sorted((r.doc_id, r.filename, r.size_bytes, bytes(r.magic)) for r in scan_raw_documents(spark, str(tmp_path / "raw"), ranged=x).collect())
        for x in (True, False)
    )
    assert ranged == whole and len(ranged) == 5


def test_pages(spark):
    pages = spark.createDataFrame([(1, 2, "two"), (1, 1, "one"), (1, 10, None), (2, 1, "x")], "doc_id long, page_num long, text string")
    assert {r.doc_id: (r.text, r.first_page_text) for r in assemble_pages(pages).collect()} == {
        1: ("--- Page 1 ---\none\n\n--- Page 2 ---\ntwo\n\n--- Page 10 ---\n", "one"), 2: ("--- Page 1 ---\nx", "x"),
    }


def test_artifacts_of_a_rerun_win(spark, tmp_path):
    path = str(tmp_path / "a")
    results = spark.createDataFrame([(1, "old"), (2, "old")], "doc_id long, value string")
    artifacts.write_step_artifacts(results, "redact", path)
    artifacts.write_step_artifacts(results, "redact", path)  # the same run again replaces itself
    artifacts.write_step_artifacts(results.where("doc_id = 1").withColumn("value", F.lit("new")), "redact", path, run=1)
    artifacts.write_step_artifacts(results, "classify", path)
    found = artifacts.read_step_artifacts(spark, path, "redact").orderBy("doc_id").collect()
    assert [(r.doc_id, r.body) for r in found] == [(1, '{"doc_id":1,"value":"new"}'), (2, '{"doc_id":2,"value":"old"}')]
    assert {r.step: r.documents for r in artifacts.manifest(spark, path).collect()} == {"redact": 2, "classify": 2}


def test_steps_of_one_pass(spark, tmp_path):
    path = str(tmp_path / "a")
    results = spark.createDataFrame([(1, "t", None, 5), (2, None, None, 6)], "doc_id long, text string, note string, n int")
    rows = artifacts.artifact_rows(results, {"parse": ["text"], "both": ["note", "n"], "all": None})
    artifacts.write_artifact_rows(rows, path)
    found = artifacts.read_step_artifacts(spark, path).collect()
    assert sorted((r.step, r.doc_id, r.body) for r in found) == [
        ("all", 1, '{"doc_id":1,"text":"t","n":5}'), ("all", 2, '{"doc_id":2,"n":6}'),
        ("both", 1, '{"doc_id":1,"n":5}'), ("both", 2, '{"doc_id":2,"n":6}'), ("parse", 1, '{"doc_id":1,"text":"t"}'),
    ]


GOOD = (
    '{"document_type":"paystub","income":{"monthly_net_estimated":null,"sources":["a"],"frequency":"weekly"},'
    '"account_summary":{"opening_balance":null,"closing_balance":null,"average_daily_balance_estimated":null,"statement_period_months":null},'
    '"risk_flags":{"overdraft_occurrences":0,"nsf_fee_occurrences":0,"large_cash_withdrawals":false,"gambling_transactions":false,'
    '"irregular_large_deposits":false,"document_integrity_flag":false},"recurring_expenses":[]}'
)


def bodies(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, body string")


def test_load(spark):
    rows = load_extractions(bodies(spark, GOOD, "{not json", None, GOOD.replace('"weekly"', "5"))).orderBy("doc_id").collect()
    assert rows[0].extraction.income.sources == ["a"] and rows[0].extraction.risk_flags.notes is None
    assert rows[1].extraction is None and rows[2].extraction is None
    assert rows[3].extraction.document_type == "paystub"


def test_conformance(spark):
    cases = {
        GOOD: [],
        "{not json": ["invalid_json"],
        GOOD.replace('"weekly"', '"hourly"'): ["enum:income.frequency"],
        GOOD.replace('"weekly"', "5"): ["type:income.frequency"],
        GOOD.replace('"sources":["a"]', '"sources":[1]'): ["type:income.sources"],
        GOOD.replace('"sources":["a"]', '"sources":[]'): [],
        GOOD.replace('"gambling_transactions":false', '"gambling_transactions":null'): ["type:risk_flags.gambling_transactions"],
        GOOD.replace('"nsf_fee_occurrences":0', '"nsf_fee_occurrences":0.5'): ["type:risk_flags.nsf_fee_occurrences"],
        GOOD.replace('"recurring_expenses":[]', '"recurring_expenses":[{"category":"rent"},{"category":"x","frequency":"daily"}]'):
            ["missing:recurring_expenses.frequency", "enum:recurring_expenses.frequency"],
        GOOD.replace('"recurring_expenses":[]', '"recurring_expenses":[{"category":5,"average_monthly_amount":"abc","frequency":"weekly"}]'):
            ["type:recurring_expenses.category", "type:recurring_expenses.average_monthly_amount"],
        GOOD.replace('"recurring_expenses":[]', '"recurring_expenses":[{"category":"a","average_monthly_amount":null,"frequency":"weekly"},{"frequency":null}]'):
            ["missing:recurring_expenses.category", "type:recurring_expenses.frequency"],
        GOOD.replace('"recurring_expenses":[]', '"recurring_expenses":[7]'): ["type:recurring_expenses[]"],
        "{}": ["missing:document_type", "missing:income", "missing:account_summary", "missing:risk_flags", "missing:recurring_expenses"],
        "[]": ["missing:document_type", "missing:income", "missing:account_summary", "missing:risk_flags", "missing:recurring_expenses"],
    }
    found = extraction_conformance(bodies(spark, *cases)).orderBy("doc_id").collect()
    assert [r.violations for r in found] == list(cases.values())


def test_leaks(spark):
    df = spark.createDataFrame(
        [(0, "clean"), (1, "ssn 123-45-6789, mail " + "a" * 40 + "@example.com, ABA no 021000021"), (2, "**** **** **** 1234 (800) 555-0192")],
        "doc_id long, text string",
    )
    rows = output_pii_scan(df).orderBy("doc_id").collect()
    assert (rows[0].blocked, rows[0].warnings) == (False, [])
    assert rows[1].warnings == [
        "Potential SSN found in LLM output: '123-45-6789'",
        "Potential EMAIL found in LLM output: '" + "a" * 30 + "'",
        "Potential ROUTING found in LLM output: 'ABA no 021000021'",
    ]
    assert [w.split()[1] for w in rows[2].warnings] == ["PHONE_HYPHENS", "ACCOUNT_MASKED"]


def test_provenance(spark):
    df = spark.createDataFrame([(1, 2)], "doc_id long, job_id long")
    assert stamp_provenance(df, "m", "v1").first()._meta.asDict() == {"model": "m", "prompt_version": "v1", "doc_id": 1, "job_id": 2}


def test_artifacts_are_compressed_and_cut_down_where_they_are_read(spark, tmp_path):
    path = tmp_path / "a"
    results = spark.createDataFrame([(1, "x" * 50), (2, "y"), (2, "y")], "doc_id long, value string")
    artifacts.write_step_artifacts(results, "redact", str(path))
    files = [f.name for f in path.rglob("part-*")]
    assert files and all(name.endswith(".json.gz") for name in files)
    value = F.get_json_object("body", "$.value")
    found = artifacts.read_step_artifacts(spark, str(path), "redact", body=F.length(value)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.body) for r in found] == [(1, 50), (2, 1)]
