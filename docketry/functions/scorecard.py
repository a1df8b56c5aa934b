"""The 100-point scorecard: every check as SQL.

A check yields one row (code, category, points, severity, detail) and the flags
it raises. Codes and flags are not the same thing: a check may pass without a
flag, and some flags are named differently from the code of their row.

Input columns are those of an extraction (document_type and the structs income,
account_summary, risk_flags) and of its report (authentic, confidence,
auth_flags), plus the derived ones of ``DERIVED``, which several outcomes use.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from docketry.functions import fixed_values as V
from docketry.functions.sql import NO_STRINGS, case, quoted, struct
from docketry.functions.text import money_text

KIND = "_kind"
IS_BANK = f"{KIND} = 'bank_statement'"


# Signal, flag, points lost, wording.
BEHAVIOR_SIGNALS = (
    ("gambling_transactions", "GAMBLING_TRANSACTIONS", 5, "gambling transactions present"),
    ("irregular_large_deposits", "IRREGULAR_DEPOSITS", 3, "unexplained large deposits"),
    ("large_cash_withdrawals", "LARGE_CASH_WITHDRAWALS", 2, "large cash withdrawals (>$1,000)"),
)

# Required fields, counted if filled: an empty ``sources`` list is filled, the
# frequency ``unknown`` is not.
_REQUIRED_FIELDS = (
    "income.monthly_net_estimated IS NOT NULL",
    "coalesce(income.frequency, 'unknown') <> 'unknown'",
    "income.sources IS NOT NULL",
    "risk_flags.overdraft_occurrences IS NOT NULL",
    "risk_flags.document_integrity_flag IS NOT NULL",
    f"({IS_BANK} AND account_summary.opening_balance IS NOT NULL)",
    f"({IS_BANK} AND account_summary.closing_balance IS NOT NULL)",
    f"({KIND} IN ('w2', 'tax_return') AND income.annual_gross IS NOT NULL)",
)

# Columns the checks share, in two steps as the second uses the first.
DERIVED = (
    {KIND: "coalesce(document_type, 'unknown')"},
    {
        "_filled": " + ".join(f"int({field})" for field in _REQUIRED_FIELDS),
        "_required": f"5 + 2 * int({IS_BANK}) + int({KIND} IN ('w2', 'tax_return'))",
        "_lost": " + ".join(
            f"{points} * int(coalesce(risk_flags.{signal}, false))" for signal, _, points, _ in BEHAVIOR_SIGNALS
        ),
    },
)


@dataclass(frozen=True)
class Outcome:
    """``earned``, ``severity`` and ``detail`` are SQL; ``flag`` is plain text."""

    code: str
    earned: str
    severity: str
    detail: str
    flag: str = ""


@dataclass(frozen=True)
class Check:
    """Outcomes in order; the first whose condition holds applies, and the last
    one needs none.

    ``applies`` limits the check to some documents; elsewhere its row is NULL
    and it raises no flag. ``flags`` replaces the outcomes' flags where one
    outcome may raise several.
    """

    category: str
    possible: int
    outcomes: tuple[tuple[str, Outcome], ...]
    applies: str = ""
    flags: str = ""

    def _choose(self, value_of: Callable[[Outcome], str], elsewhere: str) -> str:
        *conditional, (_, last) = self.outcomes
        chosen = case([(c, value_of(o)) for c, o in conditional], value_of(last))
        return case([(self.applies, chosen)], elsewhere) if self.applies else chosen

    def row(self) -> str:
        return self._choose(
            lambda o: struct(
                code=quoted(o.code),
                category=quoted(self.category),
                points_earned=f"int({o.earned})",
                points_possible=str(self.possible),
                severity=o.severity,
                detail=o.detail,
            ),
            "NULL",
        )

    def points(self) -> str:
        return self._choose(lambda o: f"int({o.earned})", "0")

    def points_possible(self) -> str:
        return case([(self.applies, str(self.possible))], "0") if self.applies else str(self.possible)

    def raised(self) -> str:
        return self.flags or self._choose(
            lambda o: f"array({quoted(o.flag)})" if o.flag else NO_STRINGS, NO_STRINGS
        )


def _text(*parts: str) -> str:
    """Concatenate; parts starting with ``=`` are SQL, the others plain text."""
    return "concat(" + ", ".join(p[1:] if p.startswith("=") else quoted(p) for p in parts) + ")"


NONE, MEDIUM, HIGH, CRITICAL = (quoted(s) for s in ("none", "medium", "high", "critical"))


# Fixed values in all checks below: codes, categories, points, severities and the
# wording of each row.
def document_type_check() -> Check:
    return Check("completeness", 5, (
        (f"{KIND} <> 'unknown'", Outcome(
            "DOC_TYPE_IDENTIFIED", "5", NONE, _text("Document classified as ", f"={KIND}"),
        )),
        ("", Outcome(
            "DOC_TYPE_UNKNOWN", "0", HIGH,
            quoted("Document type could not be determined — classification failed"), "DOC_TYPE_UNKNOWN",
        )),
    ))


def income_check() -> Check:
    income = "income.monthly_net_estimated"
    return Check("completeness", 10, (
        (f"{income} > 0", Outcome(
            "INCOME_VERIFIED", "10", NONE, _text("Monthly net income present: $", f"={money_text(income)}"),
        )),
        (f"{income} = 0", Outcome(
            "INCOME_ZERO", "4", MEDIUM,
            quoted("Income field present but reported as $0 — verify with source"), "INCOME_ZERO",
        )),
        ("", Outcome(
            "INCOME_MISSING", "0", HIGH,
            quoted("Monthly net income could not be extracted from document"), "INCOME_MISSING",
        )),
    ))


def balance_data_check() -> Check:
    opening, closing = "account_summary.opening_balance", "account_summary.closing_balance"
    return Check("completeness", 10, (
        (f"{KIND} <> 'bank_statement'", Outcome(
            "BALANCE_DATA_NA", "10", NONE, _text("Balance data not applicable for ", f"={KIND}"),
        )),
        (f"{opening} IS NOT NULL AND {closing} IS NOT NULL", Outcome(
            "BALANCE_DATA_PRESENT", "10", NONE,
            _text("Opening $", f"={money_text(opening)}", " → Closing $", f"={money_text(closing)}"),
        )),
        ("", Outcome(
            "BALANCE_DATA_MISSING", "0", MEDIUM,
            quoted("Opening or closing balance not found in bank statement"), "BALANCE_DATA_MISSING",
        )),
    ))


def history_depth_check(min_months: int = V.MIN_STATEMENT_MONTHS) -> Check:
    months = "account_summary.statement_period_months"
    shown = f"=string({months})"
    return Check("completeness", 0, (
        (f"{months} IS NULL", Outcome(
            "HISTORY_DEPTH_UNKNOWN", "0", MEDIUM,
            quoted("Statement period could not be determined from document"), "INSUFFICIENT_HISTORY",
        )),
        (f"{months} < {min_months}", Outcome(
            "INSUFFICIENT_HISTORY", "0", HIGH,
            _text("Bank statement covers ", shown, f" month(s); {min_months} months required for underwriting"),
            "INSUFFICIENT_HISTORY",
        )),
        ("", Outcome(
            "HISTORY_DEPTH_OK", "0", NONE,
            _text("Bank statement covers ", shown, " months — meets minimum"),
        )),
    ), applies=IS_BANK)


def authenticity_check() -> Check:
    """A missing report counts as not authentic."""
    trust = "cast(coalesce(confidence, 0) AS decimal(4,2))"

    def passed(least: str) -> str:
        return f"coalesce(authentic, false) AND {trust} >= {least}"

    def listed(count: int, otherwise: str) -> str:
        joined = f"array_join(slice(coalesce(auth_flags, {NO_STRINGS}), 1, {count}), '; ')"
        return "=" + f"coalesce(nullif({joined}, ''), {quoted(otherwise)})"

    return Check("integrity", 15, (
        (passed(V.AUTH_FULL_CONFIDENCE), Outcome(
            "AUTH_PASSED", "15", NONE,
            _text("Passed all authenticity checks (auth confidence: ", f"=string({trust})", ")"),
        )),
        (passed(V.AUTHENTIC_MIN_CONFIDENCE), Outcome(
            "AUTH_LOW_CONFIDENCE", "8", MEDIUM,
            _text("Passed checks but auth confidence low (", f"=string({trust})", "): ", listed(2, "minor anomalies")),
            "AUTH_LOW_CONFIDENCE",
        )),
        ("", Outcome(
            "AUTH_FAILED", "0", HIGH, _text("Authentication failed: ", listed(3, "unknown reason")), "AUTH_FAILED",
        )),
    ))


def integrity_check() -> Check:
    notes = "=coalesce(nullif(risk_flags.notes, ''), 'figures are self-contradictory')"
    return Check("integrity", 10, (
        ("NOT coalesce(risk_flags.document_integrity_flag, false)", Outcome(
            "INTEGRITY_OK", "10", NONE,
            quoted("No mathematical inconsistencies or self-contradictions detected"),
        )),
        ("", Outcome("INTEGRITY_FAIL", "0", CRITICAL, _text("Document integrity issue: ", notes), "INTEGRITY_FAIL")),
    ))


def nsf_check() -> Check:
    events = "coalesce(risk_flags.nsf_fee_occurrences, 0)"
    return Check("risk", 10, (
        (f"{events} = 0", Outcome("NO_NSF_FEES", "10", NONE, quoted("No NSF fee events"))),
        (f"{events} <= 2", Outcome(
            "NSF_FEES_LOW", "5", MEDIUM,
            _text(f"=string({events})", " NSF fee event(s) — moderate risk signal"), "NSF_FEES",
        )),
        ("", Outcome(
            "NSF_FEES_HIGH", "0", HIGH, _text(f"=string({events})", " NSF fee events — elevated risk"), "NSF_FEES_HIGH",
        )),
    ))


def overdraft_check() -> Check:
    events = "coalesce(risk_flags.overdraft_occurrences, 0)"
    return Check("risk", 10, (
        (f"{events} = 0", Outcome("NO_OVERDRAFTS", "10", NONE, quoted("No overdraft events"))),
        (f"{events} <= 2", Outcome(
            "OVERDRAFTS_LOW", "5", MEDIUM, _text(f"=string({events})", " overdraft event(s)"), "OVERDRAFTS",
        )),
        ("", Outcome(
            "OVERDRAFTS_HIGH", "0", HIGH,
            _text(f"=string({events})", " overdraft events — elevated risk"), "OVERDRAFTS_HIGH",
        )),
    ))


def behavior_check() -> Check:
    """Three signals share one row; each raises a flag of its own."""

    def present(values: list[tuple[str, str]]) -> str:
        listed = ", ".join(case([(f"risk_flags.{signal}", quoted(v))]) for signal, v in values)
        return f"array_compact(array({listed}))"

    words = f"array_join({present([(s, text) for s, _, _, text in BEHAVIOR_SIGNALS])}, '; ')"
    sentence = f"concat(upper(left({words}, 1)), lower(substring({words}, 2)))"
    return Check(
        "risk", 10,
        (
            ("_lost = 0", Outcome(
                "BEHAVIORAL_CLEAN", "10", NONE,
                quoted("No gambling, irregular deposits, or large cash withdrawals"),
            )),
            ("", Outcome(
                "BEHAVIORAL_FLAGS", "greatest(10 - _lost, 0)", case([("_lost >= 5", HIGH)], MEDIUM), sentence,
            )),
        ),
        flags=present([(s, flag) for s, flag, _, _ in BEHAVIOR_SIGNALS]),
    )


def field_coverage_check() -> Check:
    """20 points by the share of required fields that are filled, compared and
    rounded in whole numbers."""
    filled, required = "_filled", "_required"
    points = f"({filled} * 40 + {required}) div ({required} * 2)"
    gaps = _text(
        f"=string({required} - {filled})", " of ", f"=string({required})", " required fields missing or null"
    )
    return Check("coverage", 20, (
        (f"{filled} = {required}", Outcome(
            "FULL_FIELD_COVERAGE", "20", NONE,
            _text("All ", f"=string({required})", " required fields populated by LLM"),
        )),
        (f"{filled} * 10 >= {required} * 7", Outcome("PARTIAL_FIELD_COVERAGE", points, MEDIUM, gaps)),
        ("", Outcome("PARTIAL_FIELD_COVERAGE", points, HIGH, gaps, "LOW_FIELD_COVERAGE")),
    ))


def all_checks(min_months: int = V.MIN_STATEMENT_MONTHS) -> dict[str, Check]:
    """Every check by name, in the order of the scorecard."""
    return {
        "document_type": document_type_check(),
        "income": income_check(),
        "balance_data": balance_data_check(),
        "history_depth": history_depth_check(min_months),
        "authenticity": authenticity_check(),
        "integrity": integrity_check(),
        "nsf": nsf_check(),
        "overdrafts": overdraft_check(),
        "behavior": behavior_check(),
        "field_coverage": field_coverage_check(),
    }


def risk_band(score: str = "score", threshold: str = V.SCORE_THRESHOLD) -> str:
    return case(
        [
            (f"{score} IS NULL", "'Unknown'"),
            (f"{score} >= {V.LOW_RISK_SCORE}", "'Low Risk'"),
            (f"{score} >= {threshold}", "'Moderate Risk'"),
        ],
        "'Elevated Risk'",
    )


def severity_rank(severity: str) -> str:
    """0 for critical to 4 for none; unheard-of severities rank last."""
    ranks = [(f"{severity} = {quoted(name)}", str(i)) for i, name in enumerate(V.SEVERITY_ORDER)]
    return case(ranks, str(len(V.SEVERITY_ORDER) - 1))
