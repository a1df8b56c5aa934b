"""Jobs: newest run, review queue and decisions, results, state, purge list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import fixed_values as V


def latest_job_per_document(jobs: DataFrame) -> DataFrame:
    """Newest job of each document; on a tie the lower job_id.

    Spark cuts the ranking to one row per document before the shuffle.
    """
    newest_first = Window.partitionBy("document_id").orderBy(F.desc("created_at"), "job_id")
    return (
        jobs.withColumn("_place", F.row_number().over(newest_first)).where("_place = 1").drop("_place")
    )


def review_queue(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """Jobs waiting for a decision, oldest first."""
    waiting = jobs.where(F.col("status") == "NEEDS_REVIEW")
    names = documents.select(F.col("doc_id").alias("document_id"), "filename")
    return waiting.join(names, "document_id", "inner").orderBy("created_at", "job_id")


def _first_decisions(decisions: DataFrame) -> DataFrame:
    """The decision that counts for a job: the first one submitted."""
    return decisions.groupBy("job_id").agg(
        F.min(F.struct("submitted_at", "review_id", "decision", "notes")).alias("_decision")
    )


def apply_review_decisions(jobs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Jobs after the decisions; only jobs in NEEDS_REVIEW change."""
    joined = jobs.join(_first_decisions(decisions), "job_id", "left")
    decided = (F.col("status") == "NEEDS_REVIEW") & F.col("_decision").isNotNull()
    approved = F.col("_decision.decision") == "approved"
    notes = F.left(F.col("_decision.notes"), F.lit(V.MESSAGE_LIMIT))
    rejected_with_notes = decided & ~approved & (F.coalesce(notes, F.lit("")) != "")
    return joined.withColumns(
        {
            "review_status": F.when(decided, F.col("_decision.decision")).otherwise(F.col("review_status")),
            "error_message": F.when(rejected_with_notes, notes).otherwise(F.col("error_message")),
            "status": F.when(decided & approved, "SUCCEEDED")
            .when(decided, "FAILED")
            .otherwise(F.col("status")),
        }
    ).drop("_decision")


def conflicting_review_decisions(decisions: DataFrame, jobs: DataFrame) -> DataFrame:
    """Decisions that cannot be applied, with the reason.

    ``not_found``: no such job. ``conflict``: the job is in another state, or
    an earlier decision has already moved it on.
    """
    first = _first_decisions(decisions).select(
        "job_id", F.col("_decision.review_id").alias("_first_review")
    )
    joined = decisions.join(jobs.select("job_id", "status"), "job_id", "left").join(
        first, "job_id", "left"
    )
    reason = F.when(F.col("status").isNull(), "not_found").when(
        (F.col("status") != "NEEDS_REVIEW") | (F.col("review_id") != F.col("_first_review")), "conflict"
    )
    return joined.select("review_id", "job_id", "decision", "status", reason.alias("reason")).where(
        "reason IS NOT NULL"
    )


RESULT_PARTS = ("extraction", "score_breakdown", "authenticity_report", "redaction_report")


def job_results(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """The stored parts of a job's result side by side.

    ``results`` has doc_id and the four parts, NULL where absent; an empty
    redaction report counts as absent. A job with no part has no row.
    """
    slim = jobs.select("job_id", F.col("document_id").alias("doc_id"))
    present = reduce(lambda a, b: a | b, [F.col(name).isNotNull() for name in RESULT_PARTS])
    return slim.join(results.select("doc_id", *RESULT_PARTS).where(present), "doc_id", "inner")


def job_state_from_events(events: DataFrame) -> DataFrame:
    """Status and message of a job = those of its last event."""
    return events.groupBy("job_id").agg(
        F.max(F.struct("updated_at", "event_id", "status", "message")).alias("_last")
    ).select("job_id", "_last.status", "_last.message", "_last.updated_at")


def purge_manifest(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Keys with personal data that may go: the raw file and the extracted text
    of documents that a run has finished.

    Jobs parked because the batch lacks documents have not run yet. Finished
    runs are reduced to their documents before the shuffle.
    """
    finished = jobs.where(
        F.col("status").isin(*V.TERMINAL_STATUSES)
        & ~F.coalesce(F.col("error_message") == V.MISSING_DOCUMENTS_MESSAGE, F.lit(False))
    ).select(F.col("document_id").alias("doc_id")).distinct()
    doc = F.col("doc_id").cast("string")
    keys = F.array(
        F.concat(F.lit("raw/"), doc, F.lit("/"), F.col("filename")),
        F.concat(F.lit("parsed/"), doc, F.lit("/extracted.txt")),
    )
    return documents.join(finished, "doc_id", "left_semi").select(
        "doc_id", F.explode(keys).alias("object_key")
    )
