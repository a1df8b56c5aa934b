"""The recognizer table: one row per pattern. Users extend it by adding rows."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Recognizer:
    name: str
    entity: str
    score: str  # two decimals, kept as text and cast to a decimal in the plan
    pattern: str
    context: tuple[str, ...] = ()
    luhn: bool = False  # keep a match only if its digits pass the Luhn check
    needs_context: bool = False  # keep a match only if a context word stands before it
    literal: str = ""  # a string every match contains: other texts are not searched; may be left empty


# Characters before a match in which its context words count.
CONTEXT_CHARS = 40


# Entity, score, pattern and context words of every recognizer.
RECOGNIZERS: tuple[Recognizer, ...] = (
    Recognizer(
        "us_street_address", "LOCATION", "0.80",
        r"\b\d{3,5}\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"
        r"\s+(?:Street|St|Avenue|Ave|Drive|Dr|Road|Rd|"
        r"Boulevard|Blvd|Lane|Ln|Way|Court|Ct|Place|Pl|Circle|Cir)"
        r"(?:\s*,\s*(?:Apt|Suite|Ste|Unit|#)\s*\w+)?\b",
    ),
    Recognizer(
        "initial_then_surname", "PERSON", "0.70",
        r"\b[A-Z]\.\s+[A-Z][a-z]{2,}\b",
        literal=".",
    ),
    Recognizer(
        "firstname_then_initial", "PERSON", "0.70",
        r"\b[A-Z][a-z]{2,}\s+[A-Z]\.(?=\s|$|,)",
        literal=".",
    ),
    Recognizer(
        "tabular_name_after_c3", "PERSON", "0.85",
        r"(?<=C\d\d\d )[A-Z][a-z]{2,}(?:\s+[A-Z]\.)?\s+[A-Z][a-z]{2,}",
    ),
    Recognizer(
        "tabular_name_after_c4", "PERSON", "0.85",
        r"(?<=C\d\d\d\d )[A-Z][a-z]{2,}(?:\s+[A-Z]\.)?\s+[A-Z][a-z]{2,}",
    ),
    Recognizer(
        "routing_9digit", "ROUTING_NUMBER", "0.60", r"\b\d{9}\b",
        context=("routing", "aba", "rtn", "transit", "number"),
    ),
    Recognizer(
        "masked_account", "ACCOUNT_NUMBER", "0.90",
        r"\*{4}\s\*{4}\s\*{4}\s\d{4}",
        literal="****",
    ),
    Recognizer(
        "ssn_last4_labeled", "SSN_LAST4", "0.95",
        r"(?i)ssn\s*\(last\s*4\)\s*[:\-]?\s*\d{4}",
        literal="(",
    ),
    Recognizer(
        "ssn_dashes", "US_SSN", "0.85", r"\b\d{3}-\d{2}-\d{4}\b",
        context=("ssn", "social security", "social security number"),
        literal="-",
    ),
    Recognizer(
        "ssn_nodashes", "US_SSN", "0.40", r"\b\d{9}\b",
        context=("ssn", "social security", "social security number"),
    ),
    Recognizer(
        "phone_hyphens", "PHONE_NUMBER", "0.75",
        r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b",
    ),
    Recognizer(
        "phone_parens", "PHONE_NUMBER", "0.75",
        r"\(\d{3}\)\s*\d{3}[-.\s]\d{4}",
        literal="(",
    ),
    Recognizer(
        "email", "EMAIL_ADDRESS", "0.80",
        r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
        literal="@",
    ),
    # Pattern of our own: 13 to 16 digits, single blanks or dashes between them.
    Recognizer(
        "credit_card", "CREDIT_CARD", "1.00", r"\b\d(?:[ -]?\d){12,15}\b",
        luhn=True,
    ),
    # Score and context words of our own; only next to a word for an account.
    Recognizer(
        "us_bank_number", "US_BANK_NUMBER", "0.05", r"\b\d{8,17}\b",
        context=("bank", "account", "acct", "checking", "savings"),
        needs_context=True,
    ),
)

# Labels of the second detector that are redacted, and the score they get.
SECOND_PASS_LABELS = {"PERSON": "PERSON", "GPE": "LOCATION", "LOC": "LOCATION"}
SECOND_PASS_SCORE = "0.65"
FIRST_PASS = "first_pass"
SECOND_PASS = "second_pass"
