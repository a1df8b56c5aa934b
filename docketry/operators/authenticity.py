"""Authenticity: document type, balance arithmetic, file metadata, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions import fixed_values as V
from docketry.functions.sql import case, let, quoted, strings, struct
from docketry.functions.text import any_keyword, first_amount, keyword_hits, percent

CONFIDENCE = "decimal(4,2)"
MONEY = "decimal(18,2)"
AMOUNTS = tuple(V.AMOUNT_PATTERNS)


def document_type(text: str = "text") -> str:
    """struct<document_type, type_confidence>.

    A type's score is hits / 3, at most 1, so the best score belongs to the
    most hits after capping at three; ties go to the type listed first. One hit
    (0.33) is above the 0.15 floor, so only zero hits mean ``unknown``.
    """
    full = V.TYPE_FULL_HITS
    capped = f"transform({keyword_hits(text, V.TYPE_KEYWORDS.values())}, n_ -> least(n_, {full}))"
    some = "coalesce(array_max(hits_) > 0, false)"
    winner = f"get({strings(V.TYPE_KEYWORDS)}, int(array_position(hits_, array_max(hits_)) - 1))"
    confidence = f"cast(round(cast(array_max(hits_) AS decimal(4,0)) / {full}, 2) AS {CONFIDENCE})"
    return let(
        "hits_",
        capped,
        struct(
            document_type=case([(some, winner)], "'unknown'"),
            type_confidence=case([(some, confidence)], f"cast(0 AS {CONFIDENCE})"),
        ),
    )


def classify_document_type(documents: DataFrame) -> DataFrame:
    return documents.withColumn("_type", F.expr(document_type())).select(
        *documents.columns, "_type.document_type", "_type.type_confidence"
    )


def extract_amounts(documents: DataFrame) -> DataFrame:
    """Add the four labelled amounts of a statement's text."""
    return documents.withColumns(
        {name: F.expr(first_amount("text", patterns)) for name, patterns in V.AMOUNT_PATTERNS.items()}
    )


def reconciliation(amounts: str) -> str:
    """struct<reconciled, delta, note> of a struct of the four amounts;
    reconciled is true, false or NULL."""
    opening, closing, deposits, withdrawals = (f"{amounts}.{name}" for name in AMOUNTS)
    expected = f"cast({opening} + {deposits} - {withdrawals} AS {MONEY})"
    reconciled = f"delta_ <= cast({V.BALANCE_TOLERANCE} AS {MONEY})"
    mismatch = (
        f"concat('Balance mismatch: expected ', string(expected_), ', found ', string({closing}), "
        "' (delta $', string(delta_), ')')"
    )
    note = case(
        [("delta_ IS NULL", quoted(V.NOTE_BALANCE_MISSING)), (reconciled, quoted(V.NOTE_BALANCE_OK))],
        mismatch,
    )
    result = struct(reconciled=reconciled, delta="delta_", note=note)
    return let(
        "expected_", expected, let("delta_", f"cast(abs(expected_ - {closing}) AS {MONEY})", result)
    )


def reconcile_balances(amounts: DataFrame) -> DataFrame:
    """Add reconciled, delta and note."""
    both = let("amounts_", struct(**{name: name for name in AMOUNTS}), reconciliation("amounts_"))
    return amounts.withColumn("_result", F.expr(both)).select(
        *amounts.columns, "_result.reconciled", "_result.delta", "_result.note"
    )


def suspicious_producer(producer: str = "producer") -> str:
    return any_keyword(f"coalesce({producer}, '')", V.SUSPICIOUS_PRODUCERS)


def metadata_modified(creation_date: str = "creation_date", mod_date: str = "mod_date") -> str:
    """Both dates present and different."""
    created, modified = (f"trim(coalesce({c}, ''))" for c in (creation_date, mod_date))
    return f"({created} <> '' AND {modified} <> '' AND {created} <> {modified})"


def inspect_document_metadata(documents: DataFrame) -> DataFrame:
    """Add suspicious_producer and metadata_modified."""
    return documents.withColumns(
        {
            "suspicious_producer": F.expr(suspicious_producer()),
            "metadata_modified": F.expr(metadata_modified()),
        }
    )


def report(text: str = "text") -> str:
    """The whole authenticity report of a document as one struct."""
    is_bank = "kind_.document_type = 'bank_statement'"
    # Amounts are searched in bank statements only.
    base = struct(
        suspicious=suspicious_producer(),
        modified=metadata_modified(),
        **{
            name: case([(is_bank, first_amount(text, patterns))])
            for name, patterns in V.AMOUNT_PATTERNS.items()
        },
    )
    unknown = "kind_.document_type = 'unknown'"
    weak = "(kind_.document_type <> 'unknown' AND kind_.type_confidence < 0.50)"
    mismatch = f"({is_bank} AND NOT coalesce(balance_.reconciled, true))"
    missing = f"({is_bank} AND balance_.reconciled IS NULL)"
    costs = (
        (unknown, V.DEDUCT_UNKNOWN_TYPE),
        (weak, V.DEDUCT_WEAK_TYPE),
        (mismatch, V.DEDUCT_BALANCE_MISMATCH),
        (missing, V.DEDUCT_BALANCE_MISSING),
        ("base_.suspicious", V.DEDUCT_EDITING_TOOL),
        ("base_.modified", V.DEDUCT_MODIFIED),
    )
    lost = " + ".join(case([(condition, amount)], "0.00") for condition, amount in costs)
    weak_text = (
        "concat('Low confidence on document type (', kind_.document_type, ', ', "
        f"{percent('kind_.type_confidence')}, ')')"
    )
    before, after = V.FLAG_EDITING_TOOL
    flags = (
        (unknown, quoted(V.FLAG_TYPE_UNKNOWN)),
        (weak, weak_text),
        (mismatch, "concat('Balance mismatch: ', balance_.note)"),
        (missing, quoted(V.FLAG_BALANCE_MISSING)),
        ("base_.suspicious", f"concat({quoted(before)}, trim(producer), {quoted(after)})"),
        ("base_.modified", quoted(V.FLAG_MODIFIED)),
    )
    verdict = struct(
        authentic=f"confidence_ >= {V.AUTHENTIC_MIN_CONFIDENCE}",
        confidence="confidence_",
        flags=f"array_compact(array({', '.join(case([flag]) for flag in flags)}))",
        document_type="kind_.document_type",
        type_confidence="kind_.type_confidence",
        **{name: f"base_.{name}" for name in AMOUNTS},
        **{name: case([(is_bank, f"balance_.{name}")]) for name in ("reconciled", "delta", "note")},
        suspicious_producer="base_.suspicious",
        metadata_modified="base_.modified",
    )
    body = let("confidence_", f"cast(greatest(1.00 - ({lost}), 0.00) AS {CONFIDENCE})", verdict)
    body = let("base_", base, let("balance_", reconciliation("base_"), body))
    return let("kind_", document_type(text), body)


def with_authenticity(documents: DataFrame) -> DataFrame:
    """Add ``report``, computed in the row: no shuffle.

    ``documents`` has text, producer, creation_date, mod_date.
    """
    return documents.withColumn("report", F.expr(report()))


def authenticity_report(documents: DataFrame) -> DataFrame:
    """One report per document; keys of the input are kept."""
    keys = [c for c in ("doc_id", "batch_id", "created_at") if c in documents.columns]
    return with_authenticity(documents).select(*keys, "report.*")
