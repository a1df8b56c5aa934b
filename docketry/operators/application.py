"""One loan application = one batch: merge its documents into one decision.

Everything per batch is an aggregate with partial sums, minima or a short
ranking, so a batch that holds a large part of all documents never has to fit
into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import fixed_values as V
from docketry.functions.sql import NO_STRINGS
from docketry.operators.lifecycle import latest_job_per_document
from docketry.operators.scoring import RESULT_COLUMNS, score_columns

# The scorecard quotes at most three authenticity flags.
QUOTED_FLAGS = 3


def _priority(kind: Column) -> Column:
    chain = F
    for rank, name in enumerate(V.INCOME_SOURCE_PRIORITY):
        chain = chain.when(kind == name, rank)
    return chain


def _income_choice() -> tuple[Column, Column]:
    """Best income by source priority, and the first document's as a fallback.

    "First" is by created_at, then doc_id.
    """
    usable = F.col("income.monthly_net_estimated").isNotNull() & _priority(F.col("document_type")).isNotNull()
    ranked = F.struct(
        _priority(F.col("document_type")).alias("rank"), "created_at", "doc_id", "document_type", "income"
    )
    first = F.struct("created_at", "doc_id", "document_type", "income")
    return F.min(F.when(usable, ranked)), F.min(first)


def application_income(extractions: DataFrame) -> DataFrame:
    """Income of the batch and the type of document it came from."""
    best, first = _income_choice()
    return extractions.groupBy("batch_id").agg(best.alias("_best"), first.alias("_first")).select(
        "batch_id", *_income_columns()
    )


def _income_columns() -> list[Column]:
    chosen = F.col("_best").isNotNull()
    return [
        F.when(chosen, F.col("_best.document_type"))
        .otherwise(F.col("_first.document_type"))
        .alias("income_source_document"),
        F.when(chosen, F.col("_best.income")).otherwise(F.col("_first.income")).alias("income"),
    ]


# What a profile without a bank statement shows.
DEFAULT_RISK_FLAGS = (
    "named_struct('overdraft_occurrences', 0, 'nsf_fee_occurrences', 0, "
    "'large_cash_withdrawals', false, 'gambling_transactions', false, "
    "'irregular_large_deposits', false, 'document_integrity_flag', false, "
    "'notes', cast(null AS string))"
)


def application_profile(extractions: DataFrame) -> DataFrame:
    """One profile per batch, shaped like a single extraction.

    ``documents_received`` counts the documents of every type that occurs, in
    order of the first upload. Documents are reduced per batch and type first,
    so a batch of any size meets as one row per type; ``documents_in_order``
    lists them all.
    """
    best, first = _income_choice()
    upload = F.struct("created_at", "doc_id")
    bank = F.struct("created_at", "doc_id", "account_summary", "risk_flags")
    per_type = extractions.groupBy("batch_id", "document_type").agg(
        best.alias("_best"),
        first.alias("_first"),
        F.min(F.when(F.col("document_type") == "bank_statement", bank)).alias("_bank"),
        F.min(upload).alias("_upload"),
        F.count("*").alias("_documents"),
    )
    named = F.when(
        F.col("document_type") != "",
        F.struct("_upload", "document_type", F.col("_documents").alias("documents")),
    )
    grouped = per_type.groupBy("batch_id").agg(
        F.min("_best").alias("_best"),
        F.min("_first").alias("_first"),
        F.min("_bank").alias("_bank"),
        F.array_sort(F.collect_list(named)).alias("_received"),
    )
    defaults = F.expr(DEFAULT_RISK_FLAGS).cast(extractions.schema["risk_flags"].dataType)
    return grouped.select(
        "batch_id",
        F.when(F.col("_bank").isNotNull(), "bank_statement")
        .otherwise(F.coalesce("_first.document_type", F.lit("unknown")))
        .alias("document_type"),
        F.transform(
            "_received", lambda e: F.struct(e["document_type"].alias("document_type"), e["documents"].alias("documents"))
        ).alias("documents_received"),
        *_income_columns(),
        F.col("_bank.account_summary").alias("account_summary"),
        F.coalesce("_bank.risk_flags", defaults).alias("risk_flags"),
    )


def documents_in_order(extractions: DataFrame) -> DataFrame:
    """The list of received documents in long form; upload order is by
    created_at, then doc_id. Rows are only sorted where they are."""
    return (
        extractions.where("document_type <> ''")
        .select("batch_id", "created_at", "doc_id", "document_type")
        .sortWithinPartitions("batch_id", "created_at", "doc_id")
    )


def application_flags(reports: DataFrame) -> DataFrame:
    """All authenticity flags of a batch in long form; the combined list is
    these rows by created_at, doc_id, position."""
    # The outer form, as the plain one would evaluate the flags twice.
    return reports.select(
        "batch_id", "created_at", "doc_id", F.posexplode_outer("flags").alias("position", "flag")
    ).where("flag IS NOT NULL")


def application_authenticity(reports: DataFrame) -> DataFrame:
    """Authentic only if every report is; confidence is the lowest; the number
    of flags. The flags themselves, all of them, are ``application_flags``."""
    return reports.groupBy("batch_id").agg(
        F.bool_and(F.coalesce("authentic", F.lit(False))).alias("authentic"),
        F.min(F.coalesce("confidence", F.lit(0).cast("decimal(4,2)"))).alias("confidence"),
        F.sum(F.size(F.coalesce("flags", F.expr(NO_STRINGS)))).alias("flag_count"),
    )


def quoted_flags(reports: DataFrame) -> DataFrame:
    """The flags that a scorecard quotes, ``auth_flags``: the first three of the
    batch. The ranking is cut to three per batch before the shuffle."""
    in_order = Window.partitionBy("batch_id").orderBy("created_at", "doc_id", "position")
    return (
        application_flags(reports)
        .withColumn("_place", F.row_number().over(in_order))
        .where(F.col("_place") <= QUOTED_FLAGS)
        .groupBy("batch_id")
        .agg(F.array_sort(F.collect_list(F.struct("_place", "flag"))).alias("_quoted"))
        .select("batch_id", F.transform("_quoted", lambda q: q["flag"]).alias("auth_flags"))
    )


def document_set_signals(extractions: DataFrame) -> DataFrame:
    """Which kind of evidence a batch has."""
    grouped = extractions.groupBy("batch_id").agg(
        F.coalesce(F.bool_or(F.col("document_type") == "bank_statement"), F.lit(False)).alias("has_bank"),
        F.coalesce(
            F.bool_or(F.col("document_type").isin("paystub", "w2", "tax_return")), F.lit(False)
        ).alias("has_income"),
    )
    return grouped.select(
        "batch_id", document_set_code(F.col("has_income"), F.col("has_bank")).alias("signal")
    )


def document_set_code(has_income: Column, has_bank: Column) -> Column:
    return (
        F.when(has_income & has_bank, "DOC_SET_COMPLETE")
        .when(has_income, "DOC_SET_MISSING_BANK_STATEMENT")
        .when(has_bank, "DOC_SET_MISSING_INCOME_DOCUMENT")
        .otherwise("DOC_SET_INCOMPLETE")
    )


def batch_status(batches: DataFrame, jobs: DataFrame) -> DataFrame:
    """Status of every batch from the newest job of each document."""
    return status_of_batches(batches, latest_job_per_document(jobs).select("batch_id", "status"))


def status_of_batches(batches: DataFrame, statuses: DataFrame) -> DataFrame:
    """EMPTY, else the first that occurs of FAILED, RUNNING (or QUEUED),
    NEEDS_REVIEW, SUCCEEDED."""
    seen = statuses.groupBy("batch_id").agg(
        F.bool_or(F.col("status") == "FAILED").alias("failed"),
        F.bool_or(F.col("status").isin("RUNNING", "QUEUED")).alias("running"),
        F.bool_or(F.col("status") == "NEEDS_REVIEW").alias("review"),
        F.count("*").alias("jobs"),
    )
    return batches.select("batch_id").join(seen, "batch_id", "left").select(
        "batch_id",
        F.when(F.col("jobs").isNull(), "EMPTY")
        .when(F.col("failed"), "FAILED")
        .when(F.col("running"), "RUNNING")
        .when(F.col("review"), "NEEDS_REVIEW")
        .otherwise("SUCCEEDED")
        .alias("status"),
        F.coalesce("jobs", F.lit(0)).alias("jobs"),
    )


def application_decision(
    batches: DataFrame,
    jobs: DataFrame,
    extractions: DataFrame,
    reports: DataFrame,
    threshold: str = V.SCORE_THRESHOLD,
    min_months: int = V.MIN_STATEMENT_MONTHS,
) -> DataFrame:
    """Status of every batch and, where extractions and reports exist, the
    combined scorecard.

    The document-set row and the income-source row go in front of the
    breakdown. A set that is not complete adds its code to the flags after the
    recommendation is made, and so never changes it.
    """
    profile = (
        application_profile(extractions)
        .join(application_authenticity(reports), "batch_id", "inner")
        .join(quoted_flags(reports), "batch_id", "left")
        .withColumn("auth_flags", F.coalesce("auth_flags", F.expr(NO_STRINGS)))
    )
    scored = score_columns(profile, threshold, min_months)

    def received(*names: str) -> Column:
        return F.exists("documents_received", lambda entry: entry["document_type"].isin(*names))

    signal = document_set_code(received("paystub", "w2", "tax_return"), received("bank_statement"))

    def note(code: Column, category: str, severity: Column, detail: Column) -> Column:
        return F.struct(
            code.alias("code"),
            F.lit(category).alias("category"),
            F.lit(0).alias("points_earned"),
            F.lit(0).alias("points_possible"),
            severity.alias("severity"),
            detail.alias("detail"),
        )

    complete = F.col("signal") == "DOC_SET_COMPLETE"
    set_row = note(
        F.col("signal"),
        "completeness",
        F.when(complete, "none").otherwise("medium"),
        F.when(complete, V.DOC_SET_COMPLETE_DETAIL).otherwise(V.DOC_SET_INCOMPLETE_DETAIL),
    )
    source_row = F.when(
        F.col("income_source_document").isNotNull(),
        note(
            F.lit("INCOME_SOURCE"),
            "provenance",
            F.lit("none"),
            F.concat(F.lit("Income figure sourced from "), F.col("income_source_document")),
        ),
    )
    combined = scored.withColumn("signal", signal).withColumns(
        {
            "flags": F.when(complete, F.col("flags")).otherwise(
                F.concat("flags", F.array("signal"))
            ),
            "breakdown": F.concat(F.array_compact(F.array(set_row, source_row)), F.col("breakdown")),
        }
    )
    return batch_status(batches, jobs).select("batch_id", "status").join(
        combined.select(
            "batch_id", "document_type", "income_source_document", "income", "authentic",
            "confidence", *RESULT_COLUMNS,
        ),
        "batch_id",
        "left",
    )


def per_document_summary(
    documents: DataFrame, jobs: DataFrame, extractions: DataFrame, scorecards: DataFrame
) -> DataFrame:
    """Job, file name, status, message, time, type, score and flags of every
    document with a job."""
    newest = latest_job_per_document(jobs).select(
        F.col("document_id").alias("doc_id"), "job_id", "status", "error_message", "created_at"
    )
    none = F.expr(NO_STRINGS)
    return (
        newest.join(documents.select("doc_id", "batch_id", "filename"), "doc_id", "inner")
        .join(extractions.select("doc_id", "document_type"), "doc_id", "left")
        .join(scorecards.select("doc_id", "score", "flags"), "doc_id", "left")
        .withColumn("flags", F.coalesce("flags", none))
        .select(
            "batch_id", "doc_id", "job_id", "filename", "status", "error_message", "created_at",
            "document_type", "score", "flags",
        )
    )
