"""Scorecards of the sample applicants, of edge cases, and what must always hold."""

import pytest
from pyspark.sql import functions as F

from docketry.functions import fixed_values as V
from docketry.operators import application, scoring

EXTRACTION = """doc_id long, batch_id long, created_at timestamp, document_type string,
income struct<monthly_net_estimated: decimal(18,2), annual_gross: decimal(18,2), sources: array<string>, frequency: string>,
account_summary struct<opening_balance: decimal(18,2), closing_balance: decimal(18,2), statement_period_months: int>,
risk_flags struct<overdraft_occurrences: int, nsf_fee_occurrences: int, large_cash_withdrawals: boolean,
gambling_transactions: boolean, irregular_large_deposits: boolean, document_integrity_flag: boolean, notes: string>"""
REPORT = "doc_id long, batch_id long, created_at timestamp, authentic boolean, confidence decimal(4,2), flags array<string>"


def bank(net="2150.00", months=3, nsf=0, overdrafts=0, gambling=False, **change):
    base = {
        "document_type": "bank_statement", "net": net, "gross": None, "sources": ["employer"], "frequency": "biweekly",
        "opening": "4200.00", "closing": "4850.00", "months": months, "nsf": nsf, "overdrafts": overdrafts,
        "cash": False, "gambling": gambling, "irregular": False, "integrity": False, "notes": None,
    }
    return {**base, **change}


def extractions(spark, cases, batches=None):
    from datetime import datetime
    from decimal import Decimal

    def money(x):
        return None if x is None else Decimal(x)

    rows = [
        (i, (batches or range(len(cases)))[i], datetime(2025, 1, 1 + i % 28), c["document_type"],
         (money(c["net"]), money(c["gross"]), c["sources"], c["frequency"]),
         (money(c["opening"]), money(c["closing"]), c["months"]),
         (c["overdrafts"], c["nsf"], c["cash"], c["gambling"], c["irregular"], c["integrity"], c["notes"]))
        for i, c in enumerate(cases)
    ]
    return spark.createDataFrame(rows, EXTRACTION)


def reports(spark, cases, batches=None):
    from datetime import datetime
    from decimal import Decimal

    rows = [
        (i, (batches or range(len(cases)))[i], datetime(2025, 1, 1 + i % 28), a, None if c is None else Decimal(c), f)
        for i, (a, c, f) in enumerate(cases) if (a, c, f) != (None, None, None)
    ]
    return spark.createDataFrame(rows, REPORT)


GOOD = (True, "1.00", [])
CASES = [
    # the five sample applicants
    (bank(), GOOD, 100, "PASS", []),
    (bank("1850.00", nsf=3, overdrafts=2), GOOD, 85, "PASS", ["NSF_FEES_HIGH", "OVERDRAFTS"]),
    (bank("2700.00", months=1), GOOD, 100, "NEEDS_REVIEW", ["INSUFFICIENT_HISTORY"]),
    (bank("2350.00", gambling=True), GOOD, 95, "PASS", ["GAMBLING_TRANSACTIONS"]),
    (bank("4950.00", months=6), GOOD, 100, "PASS", []),
    # edge cases
    (bank(months=None), GOOD, 100, "NEEDS_REVIEW", ["INSUFFICIENT_HISTORY"]),
    (bank(net="0.00"), GOOD, 94, "PASS", ["INCOME_ZERO"]),
    (bank(net="-1.00"), GOOD, 90, "PASS", ["INCOME_MISSING"]),
    (bank(net=None), GOOD, 87, "PASS", ["INCOME_MISSING"]),
    (bank(), (True, "0.79", ["a", "b", "c"]), 93, "PASS", ["AUTH_LOW_CONFIDENCE"]),
    (bank(), (True, "0.59", []), 85, "NEEDS_REVIEW", ["AUTH_FAILED"]),
    (bank(), (None, None, None), 85, "NEEDS_REVIEW", ["AUTH_FAILED"]),
    (bank(integrity=True, notes="sums differ"), GOOD, 90, "NEEDS_REVIEW", ["INTEGRITY_FAIL"]),
    (bank(gambling=True, irregular=True, cash=True), GOOD, 90, "PASS",
     ["GAMBLING_TRANSACTIONS", "IRREGULAR_DEPOSITS", "LARGE_CASH_WITHDRAWALS"]),
    (bank(document_type="unknown"), GOOD, 95, "NEEDS_REVIEW", ["DOC_TYPE_UNKNOWN"]),
    (bank(sources=[], frequency="unknown"), GOOD, 97, "PASS", []),
    (bank(sources=None, frequency="unknown", opening=None, closing=None), GOOD, 79, "NEEDS_REVIEW",
     ["BALANCE_DATA_MISSING", "LOW_FIELD_COVERAGE"]),
]


@pytest.fixture(scope="module")
def cards(spark):
    found = scoring.scorecard(extractions(spark, [c[0] for c in CASES]), reports(spark, [c[1] for c in CASES]))
    return {r.doc_id: r for r in found.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_card(cards, i):
    _, _, points, recommendation, flags = CASES[i]
    card = cards[i]
    assert (card.total_earned, card.total_possible, card.recommendation, card.flags) == (points, 100, recommendation, flags)
    assert float(card.score) == points / 100
    assert sum(row.points_earned for row in card.breakdown) == points
    assert sum(row.points_possible for row in card.breakdown) == 100
    assert all(0 <= row.points_earned <= row.points_possible for row in card.breakdown)


def test_words(cards):
    assert [r.detail for r in cards[13].breakdown if r.code == "BEHAVIORAL_FLAGS"] == [
        "Gambling transactions present; unexplained large deposits; large cash withdrawals (>$1,000)"
    ]
    assert [r.detail for r in cards[9].breakdown if r.category == "integrity"][0] == (
        "Passed checks but auth confidence low (0.79): a; b"
    )
    assert [r.detail for r in cards[12].breakdown if r.code == "INTEGRITY_FAIL"] == ["Document integrity issue: sums differ"]
    assert cards[0].breakdown[2].detail == "Opening $4,200.00 → Closing $4,850.00"


def test_routing(spark, cards):
    found = scoring.scorecard(extractions(spark, [c[0] for c in CASES]), reports(spark, [c[1] for c in CASES]))
    routed = {r.doc_id: (r.status, r.error_message) for r in scoring.review_routing(found).collect()}
    assert routed[0] == ("SUCCEEDED", None)
    assert routed[2] == ("NEEDS_REVIEW", V.REVIEW_MESSAGES["INSUFFICIENT_HISTORY"])
    assert routed[16] == ("NEEDS_REVIEW", V.REVIEW_MESSAGES["BALANCE_DATA_MISSING"])


def test_findings_worst_first(spark):
    case = bank(net=None, integrity=True, nsf=1)
    found = scoring.review_findings(scoring.scorecard(extractions(spark, [case]), reports(spark, [GOOD])))
    assert [r.code for r in found.orderBy("place").collect()] == [
        "INTEGRITY_FAIL", "INCOME_MISSING", "NSF_FEES_LOW", "PARTIAL_FIELD_COVERAGE",
    ]


def test_application(spark):
    """The paystub gives the income, the statement the risk; one bad report spoils all."""
    paystub = bank(document_type="paystub", net="3000.00", opening=None, closing=None, months=None)
    w2 = {**paystub, "document_type": "w2", "net": None}
    batches = [1, 1, 2, 3, 3]
    cases = [bank(net="10.00", nsf=3), paystub, w2, paystub, bank()]
    auth = [GOOD, (True, "0.70", ["x"]), (False, "0.40", ["y"]), GOOD, (None, None, ["z"])]
    e, a = extractions(spark, cases, batches), reports(spark, auth, batches)
    jobs = e.select(
        F.col("doc_id").alias("job_id"), F.col("doc_id").alias("document_id"), "batch_id", "created_at",
        F.lit("SUCCEEDED").alias("status"),
    )
    all_batches = spark.createDataFrame([(1,), (2,), (3,), (4,)], "batch_id long")
    found = {r.batch_id: r for r in application.application_decision(all_batches, jobs, e, a).collect()}
    assert found[1].income_source_document == "paystub" and float(found[1].income.monthly_net_estimated) == 3000
    assert (found[1].authentic, float(found[1].confidence), found[1].flags) == (True, 0.7, ["AUTH_LOW_CONFIDENCE", "NSF_FEES_HIGH"])
    assert [r.code for r in found[1].breakdown][:2] == ["DOC_SET_COMPLETE", "INCOME_SOURCE"]
    # Four of the six fields a W-2 needs are filled: below 70 %.
    assert found[2].flags == ["INCOME_MISSING", "AUTH_FAILED", "LOW_FIELD_COVERAGE", "DOC_SET_MISSING_BANK_STATEMENT"]
    assert (found[3].authentic, float(found[3].confidence)) == (False, 0.0)
    assert (found[4].status, found[4].score) == ("EMPTY", None)


def test_risk_bands(spark):
    df = spark.sql("SELECT cast(x AS decimal(5,4)) AS score FROM VALUES (null), (0.9), (0.8999), (0.8), (0.7999) AS t(x)")
    assert [r.risk_band for r in scoring.risk_bands(df).collect()] == [
        "Unknown", "Low Risk", "Moderate Risk", "Moderate Risk", "Elevated Risk",
    ]
