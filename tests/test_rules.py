"""Sample texts with a known outcome: relevance, screening, authenticity, redaction."""

import random
import re
from dataclasses import replace
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketry.functions import fixed_values as V
from docketry.functions.recognizers import RECOGNIZERS, Recognizer
from docketry.operators import authenticity, gates, redaction
from docketry.sources.pages import assemble_pages

BANK = """Quillmark Savings, member notice
Account number ending 9027, routing number 118844225
Statement period 2031-02-01 to 2031-02-28
Beginning balance: $812.40 Ending balance: $1,066.15
One withdrawal at the ferry terminal"""
PAYSTUB = """Tidewater Kites Ltd, earnings statement no. 77
Pay period 14, pay date 2031-07-11, hours worked 61.5
Gross pay $1,908.00 Deductions $311.50 Net pay $1,596.50"""
W2 = """Wage and Tax Statement, Form W-2, year 2031
Employer identification 55-0192837
Wages, tips $40,118.00 Medicare wages $40,118.00 Social security wages $40,118.00"""
TAX = """Form 1040 for 2031, filing status: head of household
Adjusted gross income $61,240.00 less standard deduction leaves taxable income $39,015.00"""
RECEIPT = "Lantern Cafe, two soups and a pot of tea, 18.75 paid in coins, see you soon"
LEASE = "The tenant keeps the garden and pays 900 a month to the owner of the mill."


def frame(spark, texts, **columns):
    rows = [(i, text) for i, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({name: F.lit(value) for name, value in columns.items()})


def ordered(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("doc_id").collect()]


def test_relevance(spark):
    first_two = " ".join(V.RELEVANCE_KEYWORDS["bank_statement"][:2])
    texts = [
        BANK, PAYSTUB, W2, TAX, BANK.upper(), PAYSTUB + "\naccount balance\n", first_two,
        RECEIPT, LEASE, "", "an account balance, nothing else", "only a routing number", None,
    ]
    expected = ["bank_statement", "paystub", "w2", "tax_return", "bank_statement", "paystub", "bank_statement"]
    found = ordered(gates.relevance_classify(frame(spark, texts)), "is_financial", "category")
    assert found == [(True, c) for c in expected] + [(False, "unknown")] * 6


def test_quarantine_splits_completely(spark):
    classified = gates.relevance_classify(frame(spark, [BANK, RECEIPT, None]))
    accepted, rejected = gates.relevance_quarantine(classified)
    assert [r.doc_id for r in accepted.collect()] == [0]
    assert ordered(rejected, "doc_id", "status") == [(1, "FAILED"), (2, "FAILED")]


@pytest.mark.parametrize(
    "change, reason",
    [
        ({}, None),
        ({"content_type": "text/plain"}, V.REJECT_CONTENT_TYPE),
        ({"magic": "PNG!"}, V.REJECT_MAGIC),
        ({"size_bytes": 1023}, V.REJECT_TOO_SMALL),
        ({"size_bytes": 1024}, None),
        ({"size_bytes": 52428800}, None),
        ({"size_bytes": 52428801}, V.REJECT_TOO_LARGE),
        ({"text": " \n\t  "}, V.REJECT_NO_TEXT),
        ({"text": "a heron stands in the reeds"}, V.REJECT_NOT_FINANCIAL),
        ({"text": "x 611-22-3333 y 612-22-3333"}, V.REJECT_NOT_FINANCIAL),
        ({"text": "x 611-22-3333 y 612-22-3333 z 613-22-3333"}, "3 SSNs found"),
        ({"text": "balance 611-22-3333 y 612-22-3333 z 613-22-3333"}, None),
        # The first broken rule wins.
        ({"content_type": "text/plain", "magic": "PNG!", "size_bytes": 1}, V.REJECT_CONTENT_TYPE),
    ],
)
def test_screening(spark, change, reason):
    good = {"content_type": "application/pdf", "magic": "%PDF", "size_bytes": 2048, "text": BANK, **change}
    row = gates.guardrail_screen(frame(spark, [good.pop("text")], **good)).first()
    assert row.accepted == (reason is None)
    assert row.reason == reason or reason in row.reason


def test_upload_rules_look_at_page_one(spark):
    pages = spark.createDataFrame(
        [(1, 1, "cover"), (1, 2, BANK), (2, 2, "x"), (2, 1, " "), (3, 1, BANK), (3, 2, None)],
        "doc_id long, page_num long, text string",
    )
    documents = assemble_pages(pages).withColumns(
        {"content_type": F.lit("application/pdf"), "magic": F.lit("%PDF"), "size_bytes": F.lit(2048)}
    )
    assert [r.reason for r in gates.guardrail_screen(documents).orderBy("doc_id").collect()] == [
        V.REJECT_NOT_FINANCIAL, V.REJECT_NO_TEXT, None,
    ]
    assert [r.strong_hits > 0 for r in gates.financial_keyword_screen(documents).orderBy("doc_id").collect()] == [
        False, False, True,
    ]


def test_batch_gate(spark):
    rows = [
        (1, 1, "bank.pdf", BANK), (2, 1, "pay.pdf", PAYSTUB),            # complete
        (3, 2, "bank.pdf", BANK), (4, 2, "pay.pdf", PAYSTUB), (5, 2, "copy.pdf", BANK),  # a repeated file
        (6, 3, "bank.pdf", BANK), (7, 3, "x.pdf", RECEIPT),              # incomplete, one rejected
    ]
    documents = spark.createDataFrame(rows, "doc_id long, batch_id long, filename string, text string").withColumns(
        {"content_type": F.lit("application/pdf"), "magic": F.lit("%PDF"), "size_bytes": F.lit(2048)}
    )
    assert ordered(gates.batch_gate(documents), "gate_outcome", "gate_reason") == [
        (None, None), (None, None), *[("REJECTED", "Duplicate file detected: copy.pdf")] * 3,
        ("NEEDS_REVIEW", V.MISSING_DOCUMENTS_MESSAGE), ("REJECTED", V.REJECT_NOT_FINANCIAL),
    ]


STATEMENT = (
    "Routing number 118844225 Account number 9027 Statement period February 2031 Opening balance $1,300.25 "
    "Total deposits $2,750.50 Total withdrawals $1,900.75 Closing balance ${} one transaction"
)


def report(spark, text, producer=None, creation=None, modified=None):
    df = frame(spark, [text]).withColumns(
        {name: F.lit(v).cast("string") for name, v in
         {"producer": producer, "creation_date": creation, "mod_date": modified}.items()}
    )
    return authenticity.authenticity_report(df).first()


def test_clean_statement(spark):
    r = report(spark, STATEMENT.format("2,150.00"))
    assert (r.authentic, r.document_type, r.reconciled, float(r.confidence), r.flags) == (
        True, "bank_statement", True, 1.0, [])


def test_tampered_statement(spark):
    r = report(spark, STATEMENT.format("2,900.10"))
    assert (r.authentic, r.reconciled, float(r.confidence), float(r.delta)) == (False, False, 0.55, 750.1)
    assert r.flags == ["Balance mismatch: Balance mismatch: expected 2150.00, found 2900.10 (delta $750.10)"]


def test_tolerance_is_inclusive(spark):
    assert report(spark, STATEMENT.format("2,151.00")).reconciled is True
    assert report(spark, STATEMENT.format("2,151.01")).reconciled is False


def test_missing_figures(spark):
    r = report(spark, "bank statement with deposit and withdrawal and transaction")
    assert (r.reconciled, float(r.confidence)) == (None, 0.9)
    assert r.flags == [V.FLAG_BALANCE_MISSING]


def test_unknown_type(spark):
    r = report(spark, RECEIPT)
    assert (r.authentic, r.document_type, float(r.confidence)) == (False, "unknown", 0.55)


def test_metadata(spark):
    r = report(spark, STATEMENT.format("2,150.00"), "Adobe Acrobat Pro", "D:1", "D:2")
    assert (float(r.confidence), r.suspicious_producer, r.metadata_modified, r.authentic) == (0.5, True, True, False)
    assert report(spark, TAX, "Core Banking", "D:1", "").metadata_modified is False


def test_weak_type(spark):
    r = report(spark, "one overtime word")
    assert r.flags == ["Low confidence on document type (paystub, 33%)"]


def test_negative_closing_balance_has_no_amount(spark):
    row = authenticity.extract_amounts(frame(spark, ["Closing Balance $-5.00", "Closing Balance , none"])).collect()
    assert [r.closing_balance for r in row] == [None, None]


REDACTED = [
    ("lent to K. Adeyemi on Friday", "lent to [PERSON] on Friday"),
    ("from Ingrid B. , the printer", "from [PERSON] , the printer"),
    ("ssn (last 4) - 0418", "[SSN_LAST4]"),
    ("the number 611-22-3333 again", "the number [US_SSN] again"),
    ("aba routing 118844225", "aba routing [ROUTING_NUMBER]"),
    ("SSN 118844225", "SSN [US_SSN]"),  # the context decides
    ("card **** **** **** 9027 lost", "card [ACCOUNT_NUMBER] lost"),
    ("1609 Juniper Lane, Unit 7C behind the mill", "[LOCATION] behind the mill"),
    ("ring 1-206-555-0147 at noon", "ring [PHONE_NUMBER] at noon"),
    ("(206) 555-0147", "[PHONE_NUMBER]"),
    ("KIOSK #00998811 4.20", "KIOSK #00998811 4.20"),
    ("part 44556677 x 2", "part 44556677 x 2"),
    ("2031-02-01 Opening balance 1,300.25", "2031-02-01 Opening balance 1,300.25"),
    ("C217 Nadia Okafor 611-22-3333", "C217 [PERSON] [US_SSN]"),
    ("C218 Nadia Q. Okafor 611-22-3333", "C218 [PERSON] [US_SSN]"),
    ("C2190 Ruben Castellan 611-22-3333", "C2190 [PERSON] [US_SSN]"),
    ("paid to Nadia Q. Okafor", "paid to [PERSON]"),  # two names overlap in Q.
    ("write to reed.heron@example.org now", "write to [EMAIL_ADDRESS] now"),
    ("card 5555 5555 5555 4444 ok", "card [CREDIT_CARD] ok"),
    ("card 5555 5555 5555 4445 no", "card 5555 5555 5555 4445 no"),
    ("card 41 11 11 11 11 11 11 11", "card [CREDIT_CARD]"),
    ("card 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "card [CREDIT_CARD]"),
    ("card 41-11 11-11 11 1 1-1 1 11", "card [CREDIT_CARD]"),
    ("account 4455667788 at the bank", "account [US_BANK_NUMBER] at the bank"),
    ("in a savings book 00998811", "in a savings book [US_BANK_NUMBER]"),
    ("", ""),
    (None, None),
]


def test_redaction(spark):
    df = redaction.redact_text(frame(spark, [text for text, _ in REDACTED]))
    assert [r.redacted_text for r in df.orderBy("doc_id").collect()] == [out for _, out in REDACTED]


def expected_redaction(text, spans):
    """Character by character: spans are (start, end, score, entity)."""
    covered = [any(a <= i < b for a, b, *_ in spans) for i in range(len(text))]
    out, i = [], 0
    while i < len(text):
        if not covered[i]:
            out.append(text[i])
            i += 1
            continue
        stop = i + 1
        # touching spans that share no character stay apart
        while stop < len(text) and covered[stop] and any(a < stop < b for a, b, *_ in spans):
            stop += 1
        inside = [s for s in spans if i <= s[0] and s[1] <= stop]
        out.append("[" + max(inside, key=lambda s: (s[2], s[1] - s[0], -s[0], s[3]))[3] + "]")
        i = stop
    return "".join(out)


def test_no_character_of_a_span_survives(spark):
    """Random texts with spans of both passes, more than a slice of them in one."""
    rng = random.Random(8)
    words = ["Nadia", "Q.", "Okafor", "C217", "118844225", "611-22-3333", "ssn", "routing", "a", "é", "x@example.org", "9"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(60)] + [" ".join(rng.choices(words, k=3000))]
    df = frame(spark, texts)
    more = []
    for i, text in enumerate(texts):
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(0, max(0, len(text) - 3))
            more.append((i, a, a + rng.randint(0, 9), rng.choice(["PERSON", "LOCATION"]), Decimal("0.65")))
    second = spark.createDataFrame(more, "doc_id long, start int, end int, entity_type string, score decimal(3,2)")
    spans = {i: [] for i in range(len(texts))}
    for r in redaction.boost_spans_by_context(df).collect():
        spans[r.doc_id].append((r.start, r.end, r.boosted_score, r.entity_type))
    for i, a, b, entity, score in more:
        if a < min(b, len(texts[i])):
            spans[i].append((a, min(b, len(texts[i])), score, entity))
    found = {r.doc_id: r.redacted_text for r in redaction.redact_text(df, second).collect()}
    for i, text in enumerate(texts):
        assert found[i] == expected_redaction(text, spans[i]), (text, spans[i])


def _luhn(value):
    digits = [int(d) for d in re.sub("[ -]", "", value)][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def test_spans_equal_a_plain_search(spark):
    """Also with accents and astral characters, and more matches than a slice."""
    texts = [text or "" for text, _ in REDACTED]
    texts += ["é611-22-3333 ü 612-22-3333 \U0001f600 K. Adeyemi, éK. Adeyemi", "x 123456789 " * 700, BANK + PAYSTUB + W2 + TAX]
    found = {
        (r.doc_id, r.recognizer, r.start, r.end) for r in redaction.detect_pii_spans(frame(spark, texts)).collect()
    }
    expected = {
        (i, r.name, m.start(), m.end())
        for i, text in enumerate(texts)
        for r in RECOGNIZERS
        for m in re.finditer(r.pattern, text)
        if not r.luhn or _luhn(m.group())
        if not r.needs_context or any(w in text[max(0, m.start() - 40) : m.start()].lower() for w in r.context)
    }
    assert found == expected
    assert len([f for f in found if f[0] == len(REDACTED) + 1]) == 1400


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_no_literal_rejects_what_its_pattern_matches(data):
    """Also where the match stands in a text; the empty literal rejects nothing."""
    r = data.draw(st.sampled_from([r for r in RECOGNIZERS if r.literal]))
    ahead = data.draw(st.sampled_from(["C217 ", "C2170 ", "ssn ", ""]))
    text = ahead + data.draw(st.from_regex(re.compile(r.pattern), alphabet=st.characters(codec="latin-1")))
    for match in re.finditer(r.pattern, text):
        assert r.literal in match.group()


def test_generated_matches_are_found(spark):
    """Texts made from every pattern, one of the user's own among them, and a plain search."""
    rows = (*RECOGNIZERS, Recognizer("ticket", "TICKET", "0.90", r"\bT(?P<n>\d)-(?:[a-z]{2}){1,3}\b", literal="T"))
    java = tuple(replace(r, pattern=r.pattern.replace("(?P<", "(?<")) for r in rows)
    rng, texts = random.Random(4), []
    digits = ["4111111111111111", "5555555555554444", "4222222222222", "123456789", "12345678901234567"]
    for _ in range(150):
        value = rng.choice(digits)
        broken = "".join(d + rng.choice(["", "", " ", "-"]) for d in value[:-1]) + value[-1]
        names = rng.choice(["Nadia Q. Okafor", "C217 Nadia Okafor", "1609 Juniper Lane, Unit 7C", "T4-abcd", "a@b.co", "(206) 555-0147"])
        texts.append(f"{rng.choice(['bank', 'ssn', ''])} {broken} {names} {rng.choice(digits)}")
    found = {
        (r.doc_id, r.recognizer, r.start, r.end)
        for r in redaction.detect_pii_spans(frame(spark, texts), java).collect()
    }
    expected = {
        (i, r.name, m.start(), m.end())
        for i, text in enumerate(texts)
        for r in rows
        for m in re.finditer(r.pattern, text)
        if not r.luhn or _luhn(m.group())
        if not r.needs_context or any(w in text[max(0, m.start() - 40) : m.start()].lower() for w in r.context)
    }
    assert found == expected
    assert sum(f[1] == "credit_card" for f in found) > 40


def test_counts_equal_spans(spark):
    df = frame(spark, [t for t, _ in REDACTED] + [BANK])
    in_row = ordered(redaction.entity_counts_per_document(df), "doc_id", "entity_count", "pii_types_found")
    by_span = ordered(
        redaction.entity_counts_from_spans(df, redaction.detect_pii_spans(df)), "doc_id", "entity_count", "pii_types_found"
    )
    assert in_row == by_span


def test_context_raises_the_score(spark):
    rows = redaction.boost_spans_by_context(
        frame(spark, ["routing 118844225", "nothing 118844225", "ssn " + "x" * 50 + " 118844225"])
    ).collect()
    raised = {(r.doc_id, r.recognizer): (float(r.score), float(r.boosted_score)) for r in rows}
    assert raised[0, "routing_9digit"] == (0.6, 0.95)
    assert raised[1, "routing_9digit"] == (0.6, 0.6)
    assert raised[2, "ssn_nodashes"] == (0.4, 0.4)


def test_preview_keeps_no_value(spark):
    row = redaction.redacted_preview(frame(spark, ["ssn (last 4) - 0418", "nothing", None])).orderBy("doc_id").collect()
    assert [r.doc_id for r in row] == [0, 1]
    assert [e.entity_type for e in row[0].redaction_report] == ["SSN_LAST4"]
    assert row[1].redaction_report == []
    assert "0418" not in str(row[0])


def test_preview_from_stored_parts(spark):
    texts = spark.createDataFrame([(0, "[US_SSN]"), (1, "plain")], "doc_id long, redacted_text string")
    reports = redaction.redacted_preview(frame(spark, ["611-22-3333"])).drop("redacted_text")
    rows = redaction.preview_from_artifacts(texts, reports).orderBy("doc_id").collect()
    assert [len(r.redaction_report) for r in rows] == [1, 0]


def test_spans_of_texts_that_hold_the_mark(spark):
    """Marks that a text holds itself are characters like others; places are code points."""
    from docketry.functions.text import MARK

    texts = ["\U0001f600 a@b.co, c@d.co x@y.org", f"{MARK} a@b.co{MARK} c@d.co {MARK}{MARK} x@y.org", "none", "a@b.co", None]
    email = [r for r in RECOGNIZERS if r.name == "email"]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = redaction.detect_pii_spans(documents, email).orderBy("doc_id", "start").collect()
    wanted = [
        (i, m.start(), m.end()) for i, t in enumerate(texts) for m in re.finditer(r"[a-z]@[a-z]\.[a-z]+", t or "")
    ]
    assert [(r.doc_id, r.start, r.end) for r in found] == wanted


def test_batch_gate_takes_hashes_that_are_there(spark):
    names = [("bank_1.pdf", "Opening balance one"), ("paystub_2.pdf", "Net pay two")]
    rows = [(i, 1, n, "application/pdf", "%PDF", 5000, t, "same") for i, (n, t) in enumerate(names)]
    documents = spark.createDataFrame(
        rows, "doc_id long, batch_id long, filename string, content_type string, magic string, size_bytes long, text string, content_hash string"
    )
    assert [r.gate_outcome for r in gates.batch_gate(documents).collect()] == ["REJECTED", "REJECTED"]
    assert [r.gate_outcome for r in gates.batch_gate(documents.drop("content_hash")).collect()] == [None, None]
