"""Model results from JSON under a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fields and types of a model result.
EXTRACTION_SCHEMA = (
    "struct<document_type: string, analysis_period: string, "
    "income: struct<monthly_net_estimated: decimal(18,2), annual_gross: decimal(18,2), "
    "sources: array<string>, frequency: string>, "
    "account_summary: struct<opening_balance: decimal(18,2), closing_balance: decimal(18,2), "
    "average_daily_balance_estimated: decimal(18,2), statement_period_months: int>, "
    "risk_flags: struct<overdraft_occurrences: int, nsf_fee_occurrences: int, "
    "large_cash_withdrawals: boolean, gambling_transactions: boolean, "
    "irregular_large_deposits: boolean, document_integrity_flag: boolean, notes: string>, "
    "recurring_expenses: array<struct<category: string, average_monthly_amount: decimal(18,2), "
    "frequency: string>>>"
)


def load_extractions(raw: DataFrame, body: str = "body") -> DataFrame:
    """Add ``extraction``: the parsed result, NULL where the JSON is unreadable.

    A field of the wrong type is NULL by itself; the rest of the row stays.
    """
    readable = F.try_parse_json(body).isNotNull()
    parsed = F.from_json(F.col(body), EXTRACTION_SCHEMA, {"mode": "PERMISSIVE"})
    return raw.withColumn("extraction", F.when(readable, parsed)).drop(body)
