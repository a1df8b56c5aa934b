"""Hot groups: one key with a large part of all rows, against brute force."""

import random
from collections import Counter
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from docketry.operators import extraction, gates, lifecycle, redaction
from docketry.operators.application import application_authenticity, application_flags, quoted_flags
from docketry.operators.quantiles import exact_quantile


@pytest.mark.parametrize("percent", [0, 5, 50, 95, 100])
def test_exact_quantile(spark, percent):
    rng = random.Random(percent)
    rows = [("hot", Decimal(rng.randrange(-99999, 9999999)) / 100) for _ in range(4000)]
    rows += [("hot", Decimal("12.50"))] * 1500
    rows += [(f"k{i % 40}", Decimal(rng.randrange(0, 500)) / 100) for i in range(300)]
    rows += [("one", Decimal("7.00")), ("none", None)]
    df = spark.createDataFrame(rows, "key string, value decimal(18,2)").repartition(16)
    found = {r.key: r.q for r in exact_quantile(df, ["key"], "value", percent, "q").collect()}
    groups = {}
    for key, value in rows:
        if value is not None:
            groups.setdefault(key, []).append(value)
    assert set(found) == set(groups)
    for key, values in groups.items():
        values.sort()
        rank = (len(values) - 1) * percent
        low, rest = divmod(rank, 100)
        high = low + (rest > 0)
        expected = values[low] + (values[high] - values[low]) * rest / 100
        assert found[key] == expected.quantize(Decimal("0.0001")), key


def test_second_pass_on_a_hot_document(spark):
    """Spans over block borders, copies, and one document with most of them."""
    rng = random.Random(1)

    def spans(n, longest):
        return [(0 if rng.random() < 0.8 else rng.randrange(1, 5), s, s + rng.randrange(1, longest))
                for s in (rng.randrange(0, 30000) for _ in range(n))]

    first = spans(600, 30)
    second = [(*s, rng.choice(["PERSON", "GPE", "LOC", "ORG"])) for s in spans(1500, 3000)]
    second += second[:50]
    merged = redaction.merge_second_pass_spans(
        spark.createDataFrame(
            [(d, "US_SSN", s, e) for d, s, e in first], "doc_id long, entity_type string, start int, end int"
        ).withColumn("score", F.lit("0.85").cast("decimal(3,2)")),
        spark.createDataFrame(second, "doc_id long, start int, end int, label string"),
    )
    found = Counter((r.doc_id, r.entity_type, r.start, r.end) for r in merged.where("detector = 'second_pass'").collect())
    names = {"PERSON": "PERSON", "GPE": "LOCATION", "LOC": "LOCATION"}
    expected = Counter(
        (d, names[label], s, e)
        for d, s, e, label in second
        if label in names and not any(d == fd and fs < e and fe > s for fd, fs, fe in first)
    )
    assert found == expected and len(expected) > 20
    assert merged.where("detector = 'first_pass'").count() == len(first)


def test_hot_batch_is_cut_before_the_shuffle(spark):
    jobs = spark.range(20000).selectExpr(
        "id AS job_id", "IF(id % 3 = 0, 1, id) AS document_id", "timestamp_seconds(id % 1000) AS created_at", "'RUNNING' AS status"
    )
    latest = lifecycle.latest_job_per_document(jobs)
    row = latest.where("document_id = 1").collect()
    assert len(row) == 1 and row[0].job_id == min(i for i in range(20000) if i % 3 == 0 and i % 1000 == 999)
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_quoted_flags_of_a_hot_batch(spark):
    reports = spark.range(9000).selectExpr(
        "id AS doc_id", "IF(id % 3 = 0, id, 7L) AS batch_id", "timestamp_seconds(id % 500) AS created_at",
        "true AS authentic", "cast(0.9 AS decimal(4,2)) AS confidence",
        "IF(id % 2 = 0, array(concat('f', id), concat('g', id)), cast(array() AS array<string>)) AS flags",
    )
    found = application_authenticity(reports).where("batch_id = 7").first()
    quoted = quoted_flags(reports).where("batch_id = 7").first()
    everything = (
        application_flags(reports).where("batch_id = 7").orderBy("created_at", "doc_id", "position").collect()
    )
    assert found.flag_count == len(everything) > 5000
    assert quoted.auth_flags == [r.flag for r in everything[:3]]


def test_repeated_files_of_a_hot_hash(spark):
    files = spark.range(6000).selectExpr(
        "id AS doc_id", "IF(id % 3 = 0, 'hot', cast(id % 50 AS string)) AS batch_id", "concat('f', id) AS filename",
        "IF(id % 3 = 0, 'same', cast(id % 2000 AS string)) AS content",
    )
    found = gates.duplicate_files_in_batch(gates.with_content_hash(files)).collect()
    rows = [(r.doc_id, r.batch_id, r.content) for r in files.collect()]
    first = {}
    for doc, batch, content in sorted(rows):
        first.setdefault((batch, content), doc)
    assert {(r.doc_id, r.first_doc_id) for r in found} == {
        (doc, first[batch, content]) for doc, batch, content in rows if first[batch, content] != doc
    }


def test_daily_balance_by_brute_force(spark):
    rng = random.Random(2)
    start = date(2024, 2, 20)
    statements = [(i, Decimal(rng.randrange(0, 500000)) / 100, start, start + timedelta(days=rng.randrange(0, 70))) for i in range(12)]
    txns = [
        (0 if rng.random() < 0.5 else rng.randrange(1, 11), start + timedelta(days=rng.randrange(-5, 80)),
         Decimal(rng.randrange(-90000, 90000)) / 100)
        for _ in range(800)
    ]
    found = {
        r.doc_id: r.average_daily_balance
        for r in extraction.average_daily_balance(
            spark.createDataFrame(statements, "doc_id long, opening_balance decimal(18,2), period_start date, period_end date"),
            spark.createDataFrame(txns, "doc_id long, txn_date date, amount decimal(18,2)"),
        ).collect()
    }
    for doc, opening, first, last in statements:
        days = [first + timedelta(days=d) for d in range((last - first).days + 1)]
        total = sum(
            opening + sum(a for d, t, a in txns if d == doc and first <= t <= day) for day in days
        )
        assert abs(found[doc] - total / len(days)) <= Decimal("0.005"), doc


def test_recurring_cadence(spark):
    start = date(2025, 1, 1)
    plans = {"weekly": 7, "biweekly": 14, "monthly": 30, "irregular": 50}
    txns = [(1, start + timedelta(days=step * i), Decimal("-10.00"), name) for name, step in plans.items() for i in range(5)]
    txns += [(1, start, Decimal("-10.00"), "weekly")] * 3  # same day again
    txns += [(2, start + timedelta(days=7 * i), Decimal("-1.00"), "other type") for i in range(5)]
    txns += [(1, start, Decimal("-99.00"), "once"), (1, start, Decimal("5.00"), "income")]
    found = {
        r.category: (r.frequency, r.average_monthly_amount)
        for r in extraction.recurring_expenses(
            spark.createDataFrame([(1, "bank_statement"), (2, "paystub")], "doc_id long, document_type string"),
            spark.createDataFrame(txns, "doc_id long, txn_date date, amount decimal(18,2), description string")
        ).collect()
    }
    assert {name: f for name, (f, _) in found.items()} == {name: name for name in plans}
    assert found["weekly"][1] == Decimal("80.00")


def test_expenses_whose_description_changes(spark):
    txns = [
        (1, date(2025, month, 1), Decimal("-900.00"), f"{name} 0{month}/01 REF 100{month}")
        for month, name in ((1, "RENT"), (2, "Rent"), (3, "RENT"))
    ]
    txns += [(1, date(2025, 1, day), Decimal("-5.00"), f"Card 4{day} - 9.{day}") for day in (1, 8, 15)]
    txns += [(1, date(2025, 1, day), Decimal("-1.00"), "4711") for day in (1, 3)] + [(1, date(2025, 1, 9), Decimal("-1.00"), "4712")]
    found = extraction.recurring_expenses(
        spark.createDataFrame([(1, "bank_statement")], "doc_id long, document_type string"),
        spark.createDataFrame(txns, "doc_id long, txn_date date, amount decimal(18,2), description string"),
    ).collect()
    assert sorted((r.category, r.average_monthly_amount, r.frequency) for r in found) == [
        ("4711", Decimal("2.00"), "irregular"), ("Card", Decimal("15.00"), "weekly"), ("RENT", Decimal("900.00"), "monthly"),
    ]


def test_texts_are_searched_in_even_tasks(spark, tables):
    """However few tasks the scan of the narrow rows has."""
    from docketry.plans.registry import accepted_documents
    from docketry.plans.views import Catalog

    cores = spark.sparkContext.defaultParallelism
    documents = accepted_documents(Catalog(spark, tables))
    assert documents.select("doc_id").rdd.getNumPartitions() == 4 * cores
