"""Scorecards, their breakdown, review routing and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions import fixed_values as V
from docketry.functions.scorecard import DERIVED, all_checks, risk_band, severity_rank
from docketry.functions.sql import NO_STRINGS, case, let, quoted

SCORE = "decimal(5,4)"


def with_auth_report(extractions: DataFrame, reports: DataFrame) -> DataFrame:
    """Extractions with their authenticity report; NULLs where there is none."""
    slim = reports.select("doc_id", "authentic", "confidence", F.col("flags").alias("auth_flags"))
    return extractions.join(slim, "doc_id", "left")


def _with_derived(scorable: DataFrame) -> DataFrame:
    for step in DERIVED:
        scorable = scorable.withColumns({name: F.expr(sql) for name, sql in step.items()})
    return scorable


def single_check(scorable: DataFrame, name: str, min_months: int = V.MIN_STATEMENT_MONTHS) -> DataFrame:
    """One check for every document it applies to."""
    check = all_checks(min_months)[name]
    return (
        _with_derived(scorable)
        .select("doc_id", F.expr(check.row()).alias("row"), F.expr(check.raised()).alias("flags"))
        .where("row IS NOT NULL")
        .select("doc_id", "row.*", "flags")
    )


def score_columns(scorable: DataFrame, threshold: str = V.SCORE_THRESHOLD, min_months: int = V.MIN_STATEMENT_MONTHS) -> DataFrame:
    """Add score, totals, recommendation, flags and breakdown; no shuffle."""
    checks = all_checks(min_months)
    # Points are added up on their own, so that nobody builds the worded rows
    # who only wants the score.
    cards = checks.values()
    summed = _with_derived(scorable).withColumns(
        {
            "total_earned": F.expr(" + ".join(c.points() for c in cards)),
            "total_possible": F.expr(" + ".join(c.points_possible() for c in cards)),
            "flags": F.expr(f"concat({', '.join(c.raised() for c in cards)})"),
            "breakdown": F.expr(f"array_compact(array({', '.join(c.row() for c in cards)}))"),
        }
    ).drop(*[name for step in DERIVED for name in step])
    score = F.round(
        F.col("total_earned").cast("decimal(5,0)") / F.col("total_possible").cast("decimal(5,0)"), 4
    ).cast(SCORE)
    stopped = F.arrays_overlap("flags", F.array(*[F.lit(f) for f in V.HARD_STOP_FLAGS]))
    limit = F.lit(threshold).cast(SCORE)
    return summed.withColumns(
        {
            "score": score,
            "threshold": limit,
            "recommendation": F.when((score < limit) | stopped, "NEEDS_REVIEW").otherwise("PASS"),
        }
    )


RESULT_COLUMNS = (
    "score", "total_earned", "total_possible", "recommendation", "flags", "breakdown", "threshold",
)


def scorecard(extractions: DataFrame, reports: DataFrame, threshold: str = V.SCORE_THRESHOLD, min_months: int = V.MIN_STATEMENT_MONTHS) -> DataFrame:
    """One scorecard per extraction."""
    scored = score_columns(with_auth_report(extractions, reports), threshold, min_months)
    return scored.select("doc_id", "document_type", "authentic", *RESULT_COLUMNS)


def score_breakdown(scorecards: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per check, numbered in scorecard order from 0."""
    return (
        scorecards.select(key, F.posexplode_outer("breakdown").alias("position", "row"))
        .where("position IS NOT NULL")
        .select(key, "position", "row.*")
    )


def review_reason() -> str:
    """First flag with a message, else the authenticity text, else the score."""
    known = f"get(filter(coalesce(flags, {NO_STRINGS}), f_ -> f_ IN ({', '.join(map(quoted, V.REVIEW_MESSAGES))})), 0)"
    worded = case([(f"flag_ = {quoted(f)}", quoted(m)) for f, m in V.REVIEW_MESSAGES.items()])
    return (
        f"coalesce({let('flag_', known, worded)}, "
        f"{case([('NOT authentic', quoted(V.REVIEW_NOT_AUTHENTIC))])}, "
        "concat('Confidence ', string(cast(round(score, 2) AS decimal(4,2))), ' below threshold'), "
        f"{quoted(V.REVIEW_NO_SCORE)})"
    )


def review_routing(scorecards: DataFrame) -> DataFrame:
    """Final status of a scored document, with a reason where it goes to review."""
    needed = (
        F.col("recommendation").eqNullSafe("NEEDS_REVIEW")
        | F.col("score").isNull()
        | F.coalesce(~F.col("authentic"), F.lit(False))
    )
    return scorecards.select(
        "doc_id",
        F.when(needed, "NEEDS_REVIEW").otherwise("SUCCEEDED").alias("status"),
        F.when(needed, F.expr(review_reason())).alias("error_message"),
    )


def risk_bands(scored: DataFrame, threshold: str = V.SCORE_THRESHOLD) -> DataFrame:
    return scored.withColumn("risk_band", F.expr(risk_band("score", threshold)))


def review_findings(scorecards: DataFrame, key: str = "doc_id") -> DataFrame:
    """Checks of medium severity or worse, or with points lost, worst first.

    Ordered inside the row, where a card has at most a dozen checks.
    """
    ranked = f"struct({severity_rank('row_.severity')} AS rank, i_ AS position, row_ AS row)"
    found = (
        f"filter(transform(breakdown, (row_, i_) -> {ranked}), x_ -> "
        "x_.row.severity IN ('medium', 'high', 'critical') "
        "OR x_.row.points_earned < x_.row.points_possible)"
    )
    ordered = F.expr(f"transform(array_sort({found}), x_ -> x_.row)")
    return (
        scorecards.select(key, F.posexplode_outer(ordered).alias("place", "row"))
        .where("place IS NOT NULL")
        .select(key, "place", "row.*")
    )


def adverse_action_notes(decisions: DataFrame, scorecards: DataFrame) -> DataFrame:
    """Reason codes of rejected or flagged documents as one list for the notice.

    ``decisions`` has job_id, doc_id, decision (NULL while open).
    """
    joined = decisions.join(
        scorecards.select("doc_id", "recommendation", "flags"), "doc_id", "left"
    )
    return joined.where(
        F.col("decision").eqNullSafe("rejected")
        | F.col("recommendation").eqNullSafe("NEEDS_REVIEW")
    ).select(
        "job_id",
        "doc_id",
        "decision",
        F.array_join(F.coalesce("flags", F.expr(NO_STRINGS)), "; ").alias("reason_codes"),
    )
