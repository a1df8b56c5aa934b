"""Dashboard numbers over jobs, step events and requests.

Counts over a fixed list of values are plain conditional aggregates turned
into rows, so every value is present (zero-filled) without a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import fixed_values as V
from docketry.operators.quantiles import exact_quantile

RATE = "decimal(18,6)"


def _counts_as_rows(df: DataFrame, cases: Sequence[tuple[str, Column]], key: str, count: str) -> DataFrame:
    """One row (key, count) per case, from a single pass."""
    counted = df.agg(*[F.count_if(condition).alias(f"_{i}") for i, (_, condition) in enumerate(cases)])
    rows = F.array(
        *[
            F.struct(F.lit(label).alias(key), F.col(f"_{i}").alias(count))
            for i, (label, _) in enumerate(cases)
        ]
    )
    return counted.select(F.inline(rows))


def _share(part: Column, whole: Column, scale: int = 1) -> Column:
    """part / whole, NULL if there is nothing to divide by."""
    return F.round(
        part.cast("decimal(18,0)") * scale / F.nullif(whole, F.lit(0)).cast("decimal(18,0)"), 6
    ).cast(RATE)


def status_counts(jobs: DataFrame) -> DataFrame:
    cases = [(s, F.col("status") == s) for s in V.JOB_STATUSES]
    return _counts_as_rows(jobs, cases, "status", "jobs")


def processing_totals(jobs: DataFrame) -> DataFrame:
    return jobs.agg(
        F.count("*").alias("all_jobs"),
        F.coalesce(F.sum("entity_count"), F.lit(0)).alias("pii_entities_redacted"),
        F.round(F.avg("confidence_score"), 6).cast(RATE).alias("avg_confidence"),
        F.round(F.avg("auth_confidence"), 6).cast(RATE).alias("avg_auth_confidence"),
    )


def auto_approval_rate(jobs: DataFrame) -> DataFrame:
    """Succeeded without a review, among finished jobs."""
    automatic = F.count_if((F.col("status") == "SUCCEEDED") & F.col("review_status").isNull())
    finished = F.count_if(F.col("status").isin(*V.TERMINAL_STATUSES))
    return jobs.agg(_share(automatic, finished).alias("auto_approval_rate"))


def auth_pass_rate(jobs: DataFrame) -> DataFrame:
    return jobs.agg(
        _share(F.count_if(F.col("authentic")), F.count("authentic")).alias("auth_pass_rate")
    )


def processed_last_24h(jobs: DataFrame, now: Column) -> DataFrame:
    recent = jobs.where(F.col("created_at") >= now - F.expr("INTERVAL 24 HOURS"))
    return recent.agg(F.count("*").alias("processed_24h"))


def daily_volume(jobs: DataFrame, now: Column, days: int = V.VOLUME_DAYS) -> DataFrame:
    recent = jobs.where(F.col("created_at") >= now - F.expr(f"INTERVAL {days} DAYS"))
    return recent.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("jobs")).orderBy("day")


def document_type_mix(jobs: DataFrame) -> DataFrame:
    known = jobs.where(F.col("document_type").isNotNull())
    return known.groupBy("document_type").agg(F.count("*").alias("jobs"))


def confidence_histogram(jobs: DataFrame) -> DataFrame:
    """Ten buckets of 0.1; a score of 1.0 falls into the last."""
    bucket = F.least(F.floor(F.col("confidence_score") * 10), F.lit(len(V.CONFIDENCE_BUCKETS) - 1))
    cases = [(label, bucket == i) for i, label in enumerate(V.CONFIDENCE_BUCKETS)]
    return _counts_as_rows(jobs, cases, "bucket", "jobs")


def pii_type_ranking(jobs: DataFrame, shown: int | None = None) -> DataFrame:
    """Documents per type of personal data, most first: all of them, or the top
    ``shown`` as the page shows them (``fixed_values.PII_RANKING_SHOWN``)."""
    types = jobs.select(F.explode(F.split("pii_types_found", ",")).alias("pii_type"))
    ranked = (
        types.select(F.trim("pii_type").alias("pii_type"))
        .where("pii_type <> ''")
        .groupBy("pii_type")
        .agg(F.count("*").alias("documents"))
        .orderBy(F.desc("documents"), "pii_type")
    )
    return ranked if shown is None else ranked.limit(shown)


def success_rate(jobs: DataFrame) -> DataFrame:
    return jobs.agg(
        _share(F.count_if(F.col("status") == "SUCCEEDED"), F.count("*"), 100).alias("success_rate")
    )


def step_durations(step_events: DataFrame) -> DataFrame:
    """Average seconds and number of runs per step; steps never run are left out."""
    return (
        step_events.where(F.col("step").isin(*V.STEPS))
        .groupBy("step")
        .agg(
            F.round(F.avg(F.col("seconds").cast("decimal(18,4)")), 6).cast(RATE).alias("avg_seconds"),
            F.count("*").alias("runs"),
        )
    )


def step_failures(step_events: DataFrame) -> DataFrame:
    """Failures per step (steps without any are left out), and always the number
    of relevance rejections and of blocked model outputs.

    ``outcome`` is ok, error, rejected or leak_block; all but ok are failures.
    """
    cases = [(step, (F.col("step") == step) & (F.col("outcome") != "ok")) for step in V.STEPS]
    cases += [
        ("classify_rejected", (F.col("step") == "classify") & (F.col("outcome") == "rejected")),
        ("pii_leak_blocks", (F.col("step") == "extract") & (F.col("outcome") == "leak_block")),
    ]
    counted = _counts_as_rows(step_events, cases, "metric", "failures")
    return counted.where((F.col("failures") > 0) | ~F.col("metric").isin(*V.STEPS))


def latency_p95(requests: DataFrame) -> DataFrame:
    """95th percentile of request seconds per five minutes, exact."""
    windowed = requests.select(
        F.window("ts", f"{V.LATENCY_WINDOW_SECONDS} seconds")["start"].alias("window_start"), "seconds"
    )
    return exact_quantile(windowed, ["window_start"], "seconds", 95, "p95_seconds", bucket_width=1)


def request_rate(requests: DataFrame) -> DataFrame:
    """Requests per second over the last two minutes, stepped by 15 seconds.

    Requests are counted per step first; only those counts are spread over the
    eight windows each step belongs to.
    """
    step, span = V.SCRAPE_SECONDS, V.RATE_WINDOW_SECONDS
    slots = requests.groupBy(
        F.window("ts", f"{step} seconds")["start"].alias("slot")
    ).agg(F.count("*").alias("n"))
    starts = F.array(
        *[F.col("slot") - F.expr(f"INTERVAL {back} SECONDS") for back in range(0, span, step)]
    )
    spread = slots.select(F.explode(starts).alias("window_start"), "n")
    return spread.groupBy("window_start").agg(
        F.sum("n").alias("requests"),
        F.round(F.sum("n") / F.lit(span).cast("decimal(9,0)"), 6).cast(RATE).alias("per_second"),
    )


def status_over_time(jobs: DataFrame, bucket: str = "1 day") -> DataFrame:
    return jobs.groupBy(
        F.window("created_at", bucket)["start"].alias("window_start"), "status"
    ).agg(F.count("*").alias("jobs"))
