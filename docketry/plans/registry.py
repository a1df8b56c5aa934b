"""Every registered query: which operator runs on which tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import application as app
from docketry.operators import authenticity as auth
from docketry.operators import dashboard as dash
from docketry.operators import extraction as ext
from docketry.operators import gates
from docketry.operators import lifecycle as life
from docketry.operators import redaction as red
from docketry.operators import scoring
from docketry.plans.views import Catalog
from docketry.session import configure, work_folder
from docketry.sources.artifacts import artifact_rows, read_step_artifacts, write_artifact_rows
from docketry.sources.extractions import load_extractions
from docketry.sources.pages import assemble_pages
from docketry.sources.raw_objects import scan_raw_documents
from docketry.streaming import jobs as streams
from docketry.streaming.replay import table_stream, with_closing_marker

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    """Register a function of a Catalog under a name."""

    def register(build: Callable[[Catalog], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Catalog(configure(spark), folder))

        run.__name__ = name
        QUERIES[name] = run
        return build

    return register


# --- output shaping: flat columns that compare exactly -------------------------

def listed(column: str | Column, separator: str = " | ") -> Column:
    return F.array_join(column, separator)


def stamp(column: str | Column) -> Column:
    """A timestamp as text."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def long(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


# --- shared inputs ---------------------------------------------------------------

def nested_extractions(c: Catalog) -> DataFrame:
    """The flat extraction view in the nested shape of a model result."""
    return c["fx_extraction"].select(
        "doc_id",
        "batch_id",
        "created_at",
        "document_type",
        F.struct(
            "monthly_net_estimated",
            "annual_gross",
            F.when(F.col("source").isNotNull(), F.array("source")).alias("sources"),
            "frequency",
        ).alias("income"),
        F.struct("opening_balance", "closing_balance", "statement_period_months").alias("account_summary"),
        F.struct(
            "overdraft_occurrences", "nsf_fee_occurrences", "large_cash_withdrawals",
            "gambling_transactions", "irregular_large_deposits", "document_integrity_flag",
            F.lit(None).cast("string").alias("notes"),
        ).alias("risk_flags"),
    )


def spread(table: DataFrame) -> DataFrame:
    """The rows dealt evenly over four tasks a core: texts are searched at many times
    the cost of reading the narrow rows that they come from, and a scan makes a task of
    each 128 MB of those, or of each row group."""
    return table.repartition(4 * table.sparkSession.sparkContext.defaultParallelism)


def accepted_documents(c: Catalog) -> DataFrame:
    return gates.guardrail_screen(c.view("fx_document", orders=spread(c["orders"]))).where("accepted")


def reports(c: Catalog) -> DataFrame:
    """Reports exist for documents that passed the upload screening."""
    return auth.authenticity_report(accepted_documents(c))


def stored(c: Catalog, purpose: str, df: DataFrame) -> DataFrame:
    """Write a slim result that a query uses more than once to the shared
    folder and read it back, instead of searching all texts again."""
    folder = work_folder(c.spark, purpose)
    df.write.parquet(folder)
    return c.spark.read.schema(df.schema).parquet(folder)


def scorecards(c: Catalog, from_reports: DataFrame | None = None) -> DataFrame:
    return scoring.scorecard(nested_extractions(c), reports(c) if from_reports is None else from_reports)


def newest_time(jobs: DataFrame) -> Column:
    """The reference time of the dashboard: the newest job."""
    return jobs.agg(F.max("created_at")).scalar()


def ner_spans(c: Catalog) -> DataFrame:
    return c["fx_ner_span"].select(
        "doc_id",
        F.col("span_start").cast("int").alias("start"),
        F.col("span_end").cast("int").alias("end"),
        "label",
    )


def merged_spans(c: Catalog) -> DataFrame:
    first_pass = stored(c, "spans", red.detect_pii_spans(c["documents"]))
    return red.merge_second_pass_spans(first_pass, ner_spans(c))


def stream_of(c: Catalog, table: str) -> DataFrame:
    return table_stream(c.spark, c.path(table))


# --- sources and sinks -------------------------------------------------------------

@query("scan_raw_documents")
def _(c):
    """The texts written as files, one folder for each language."""
    folder = work_folder(c.spark, "raw")
    c["documents"].select("lang", F.coalesce("text", F.lit("")).alias("text")).write.partitionBy("lang").text(folder)
    found = scan_raw_documents(c.spark, folder, "*.txt")
    return found.groupBy(F.col("doc_id").alias("folder")).agg(F.sum("size_bytes").alias("bytes"))


@query("assemble_pages")
def _(c):
    return assemble_pages(c["fx_page"])


@query("write_step_artifacts")
def _(c):
    """All seven kinds, read back: what each body holds as one line."""
    folder = work_folder(c.spark, "artifacts")
    extractions = nested_extractions(c)
    # Texts are searched once; what they give is stored and then taken apart.
    documents = accepted_documents(c)
    keys = ["doc_id", "batch_id", "created_at"]
    searched = red.with_redacted_preview(auth.with_authenticity(documents).select(*keys, "text", "report"))
    processed = stored(c, "processed", searched)
    cards = scorecards(c, processed.select(*keys, "report.*"))
    stamped = ext.stamp_provenance(
        extractions.select("doc_id", F.col("doc_id").alias("job_id")), model="model-1", prompt_version="v5.1"
    )
    of_texts = {"parsed_text": ["text"], "redacted_text": ["redacted_text"], "redaction_report": ["redaction_report"]}
    report = processed.select(*keys, "report.*")
    rows = [
        artifact_rows(processed, of_texts),
        artifact_rows(report, {"authenticity_report": None}),
        artifact_rows(extractions, {"extraction": None}),
        artifact_rows(stamped.select("doc_id", "_meta"), {"extraction_meta": None}),
        artifact_rows(cards, {"score_breakdown": ["score", "total_earned", "breakdown"]}),
    ]
    write_artifact_rows(reduce(DataFrame.unionByName, rows), folder)

    def at(path: str) -> Column:
        return F.coalesce(F.get_json_object("body", f"$.{path}"), F.lit(""))

    def number(path: str, kind: str) -> Column:
        return F.coalesce(F.get_json_object("body", f"$.{path}").cast(kind).cast("string"), F.lit(""))

    def line(*paths: str) -> Column:
        return F.concat_ws("|", *map(at, paths))

    entries = F.from_json(
        at("redaction_report"), "array<struct<entity_type: string, start: string, end: string>>"
    )
    shown = F.transform(entries, lambda e: F.concat_ws(":", e["entity_type"], e["start"], e["end"]))
    codes = F.transform(F.from_json(at("breakdown"), "array<struct<code: string>>"), lambda r: r["code"])
    flags = F.size(F.from_json(at("flags"), "array<string>")).cast("string")
    content = {
        "parsed_text": at("text"),
        "authenticity_report": F.concat_ws("|", at("document_type"), at("authentic"), number("confidence", "decimal(4,2)"), flags),
        "redacted_text": at("redacted_text"),
        "redaction_report": listed(F.array_sort(shown)),
        "extraction": F.concat_ws("|", at("document_type"), number("income.monthly_net_estimated", "decimal(18,2)")),
        "extraction_meta": line("_meta.model", "_meta.prompt_version", "_meta.doc_id"),
        "score_breakdown": F.concat_ws("|", number("score", "decimal(5,4)"), at("total_earned"), listed(codes)),
    }
    chosen = F.lit(None).cast("string")
    for step, value in content.items():
        chosen = F.when(F.col("step") == step, value).otherwise(chosen)
    # Only the line of a body is ranked, not the body.
    lines = read_step_artifacts(c.spark, folder, body=chosen)
    return lines.select("step", "doc_id", F.col("body").alias("content"))


@query("load_extractions")
def _(c):
    loaded = load_extractions(c["fx_raw_extraction"])
    e = "extraction"
    return loaded.select(
        "doc_id",
        F.col(e).isNotNull().alias("readable"),
        f"{e}.document_type",
        f"{e}.income.monthly_net_estimated",
        listed(f"{e}.income.sources").alias("sources"),
        f"{e}.account_summary.opening_balance",
        long(f"{e}.risk_flags.nsf_fee_occurrences").alias("nsf_fee_occurrences"),
        f"{e}.risk_flags.gambling_transactions",
        long(F.size(f"{e}.recurring_expenses")).alias("expense_count"),
    )


# --- gates ---------------------------------------------------------------------------

@query("guardrail_screen")
def _(c):
    return gates.guardrail_screen(c["fx_document"]).select("doc_id", "accepted", "reason")


@query("pii_dump_screen")
def _(c):
    return gates.pii_dump_screen(c["fx_document"]).select("doc_id", long("ssn_count").alias("ssn_count"), "is_pii_dump")


@query("financial_keyword_screen")
def _(c):
    return gates.financial_keyword_screen(c["fx_document"]).select(
        "doc_id", long("strong_hits").alias("strong_hits"), long("supporting_hits").alias("supporting_hits"), "is_financial"
    )


def repeated_files(c: Catalog) -> DataFrame:
    """The contents are read and hashed once; all else works on the hashes."""
    hashed = gates.with_content_hash(c["fx_file"]).drop("content")
    return gates.duplicate_files_in_batch(stored(c, "hashes", hashed))


@query("duplicate_files_in_batch")
def _(c):
    return repeated_files(c).select("batch_id", "doc_id", "filename", "content_hash", "first_doc_id")


@query("rejected_batches")
def _(c):
    return gates.rejected_batches(repeated_files(c))


@query("required_document_set")
def _(c):
    return gates.required_document_set(c["fx_document"]).select(
        "doc_id", "batch_id", "guessed_type", "requirements_met", "status", "error_message"
    )


@query("relevance_classify")
def _(c):
    return gates.relevance_classify(c["fx_document"]).select("doc_id", "is_financial", "category")


@query("relevance_quarantine")
def _(c):
    _, rejected = gates.relevance_quarantine(gates.relevance_classify(c["fx_document"]))
    return rejected.select("doc_id", "status", "error_message")


# --- authenticity -----------------------------------------------------------------------

@query("classify_document_type")
def _(c):
    return auth.classify_document_type(c["fx_document"]).select("doc_id", "document_type", "type_confidence")


@query("extract_amounts")
def _(c):
    return auth.extract_amounts(c["fx_document"]).select("doc_id", *auth.AMOUNTS)


@query("reconcile_balances")
def _(c):
    return auth.reconcile_balances(auth.extract_amounts(c["fx_document"])).select(
        "doc_id", "reconciled", "delta", "note"
    )


@query("inspect_document_metadata")
def _(c):
    return auth.inspect_document_metadata(c["fx_document"]).select(
        "doc_id", "suspicious_producer", "metadata_modified"
    )


@query("authenticity_report")
def _(c):
    return auth.authenticity_report(c["fx_document"]).select(
        "doc_id", "authentic", "confidence", listed("flags").alias("flags"), "document_type",
        "type_confidence", "reconciled", "delta",
    )


# --- personal data -------------------------------------------------------------------------

def _span_columns(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        "doc_id", "entity_type", long("start").alias("span_start"), long("end").alias("span_end"), *more
    )


@query("detect_pii_spans")
def _(c):
    return _span_columns(red.detect_pii_spans(c["documents"]), "score", "recognizer")


@query("detect_pii_spans_in_statements")
def _(c):
    return _span_columns(red.detect_pii_spans(c["fx_document"]), "score", "recognizer")


@query("boost_spans_by_context")
def _(c):
    return _span_columns(
        red.boost_spans_by_context(c["fx_document"]), "recognizer", "score", "in_context", "boosted_score"
    )


@query("merge_second_pass_spans")
def _(c):
    return _span_columns(merged_spans(c), "score", "detector")


@query("redact_text")
def _(c):
    return red.redact_text(c["documents"], red.second_pass_spans(merged_spans(c))).select("doc_id", "redacted_text")


@query("redact_statements")
def _(c):
    return red.redact_text(c["fx_document"]).select("doc_id", "redacted_text")


@query("redaction_audit")
def _(c):
    return _span_columns(red.redaction_audit(merged_spans(c)), "char_count", "detector").withColumn(
        "char_count", long("char_count")
    )


@query("entity_counts_per_document")
def _(c):
    return red.entity_counts_per_document(c["documents"]).withColumn("entity_count", long("entity_count"))


@query("entity_counts_after_second_pass")
def _(c):
    return red.entity_counts_from_spans(c["documents"], merged_spans(c))


@query("entity_totals")
def _(c):
    return red.entity_totals(merged_spans(c))


@query("redacted_preview")
def _(c):
    shown = F.transform(
        "redaction_report",
        lambda s: F.concat_ws(":", s["entity_type"], s["start"].cast("string"), s["end"].cast("string")),
    )
    return red.redacted_preview(c["documents"], red.second_pass_spans(merged_spans(c))).select(
        "doc_id", "redacted_text", listed(F.array_sort(shown)).alias("redaction_report")
    )


# --- extraction results -------------------------------------------------------------------------

@query("extraction_conformance")
def _(c):
    return ext.extraction_conformance(c["fx_raw_extraction"]).select("doc_id", listed("violations").alias("violations"))


@query("output_pii_scan")
def _(c):
    return ext.output_pii_scan(c["fx_response"]).select(
        "conv_id", "turn", "blocked", listed("warnings").alias("warnings")
    )


@query("output_pii_scan_over_documents")
def _(c):
    return ext.output_pii_scan(c["documents"]).select("doc_id", "blocked", listed("warnings").alias("warnings"))


@query("stamp_provenance")
def _(c):
    stamped = ext.stamp_provenance(c["fx_response"], model="model-1", prompt_version="v5.1")
    return stamped.select(
        "conv_id", "turn", "_meta.model", "_meta.prompt_version", "_meta.doc_id", "_meta.job_id"
    )


@query("normalize_income")
def _(c):
    return ext.normalize_income(c["fx_extraction"]).select("doc_id", "document_type", "monthly_net", "cadence")


@query("statement_period_months")
def _(c):
    return ext.statement_period_months(c["fx_statement"]).select(
        "doc_id", long("statement_period_months").alias("statement_period_months")
    )


@query("risk_event_counts")
def _(c):
    return ext.risk_event_counts(c["fx_extraction"], c["fx_txn"])


@query("irregular_large_deposits")
def _(c):
    return ext.irregular_large_deposits(c["fx_extraction"], c["fx_txn"], factor="1.5")


def bank_statements(c: Catalog) -> DataFrame:
    return c["fx_statement"].where("document_type = 'bank_statement'")


@query("average_daily_balance")
def _(c):
    return ext.average_daily_balance(bank_statements(c), c["fx_txn"])


@query("recurring_expenses")
def _(c):
    return ext.recurring_expenses(c["fx_extraction"], c["fx_txn"])


@query("document_integrity_rules")
def _(c):
    return ext.document_integrity_rules(c["fx_figures"]).select(
        "doc_id", listed("broken_rules").alias("broken_rules"), "document_integrity_flag"
    )


@query("statement_total_audit")
def _(c):
    return ext.statement_total_audit(bank_statements(c), c["fx_ledger"])


# --- scorecard ---------------------------------------------------------------------------------------

# Registered name -> check of the scorecard.
SCORE_QUERIES = {
    "score_document_type": "document_type",
    "score_income": "income",
    "score_balance_data": "balance_data",
    "score_history_depth": "history_depth",
    "score_authenticity": "authenticity",
    "score_integrity": "integrity",
    "score_nsf": "nsf",
    "score_overdrafts": "overdrafts",
    "score_behavior": "behavior",
    "score_field_coverage": "field_coverage",
}


def _check_rows(df: DataFrame) -> DataFrame:
    return df.withColumn("points_earned", long("points_earned")).withColumn(
        "points_possible", long("points_possible")
    )


def _register_check(name: str, check: str) -> None:
    @query(name)
    def _(c):
        extractions = nested_extractions(c)
        # Only the authenticity check looks at the report.
        rows = scoring.with_auth_report(extractions, reports(c)) if check == "authenticity" else extractions
        return _check_rows(scoring.single_check(rows, check)).withColumn("flags", listed("flags"))


for _name, _check in SCORE_QUERIES.items():
    _register_check(_name, _check)


def _score_row(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(
        *keys,
        "score",
        long("total_earned").alias("total_earned"),
        long("total_possible").alias("total_possible"),
        "recommendation",
        listed("flags").alias("flags"),
    )


@query("scorecard")
def _(c):
    return _score_row(scorecards(c), "doc_id", "document_type")


@query("score_breakdown")
def _(c):
    return _check_rows(scoring.score_breakdown(scorecards(c))).withColumn("position", long("position"))


@query("review_routing")
def _(c):
    return scoring.review_routing(scorecards(c))


@query("risk_band")
def _(c):
    return scoring.risk_bands(
        c["fx_job"].select("job_id", F.col("confidence_score").cast("decimal(5,4)").alias("score"))
    )


@query("review_findings")
def _(c):
    return _check_rows(scoring.review_findings(scorecards(c))).withColumn("place", long("place"))


# --- applications -----------------------------------------------------------------------------------------

@query("application_income")
def _(c):
    return app.application_income(nested_extractions(c)).select(
        "batch_id", "income_source_document", "income.monthly_net_estimated", "income.frequency"
    )


@query("application_profile")
def _(c):
    received = F.transform(
        "documents_received",
        lambda e: F.concat(e["document_type"], F.lit("="), e["documents"].cast("string")),
    )
    return app.application_profile(nested_extractions(c)).select(
        "batch_id",
        "document_type",
        listed(received).alias("documents_received"),
        "income_source_document",
        "income.monthly_net_estimated",
        "account_summary.opening_balance",
        long("account_summary.statement_period_months").alias("statement_period_months"),
        long("risk_flags.nsf_fee_occurrences").alias("nsf_fee_occurrences"),
        "risk_flags.gambling_transactions",
    )


@query("application_documents")
def _(c):
    return app.documents_in_order(nested_extractions(c)).withColumn("created_at", stamp("created_at"))


@query("application_authenticity")
def _(c):
    return app.application_authenticity(reports(c))


@query("application_flags")
def _(c):
    return app.application_flags(reports(c)).select("batch_id", "doc_id", long("position").alias("position"), "flag")


@query("document_set_signals")
def _(c):
    return app.document_set_signals(nested_extractions(c))


@query("application_decision")
def _(c):
    decided = app.application_decision(
        c["fx_batch"], c["fx_job"], nested_extractions(c), stored(c, "reports", reports(c))
    )
    codes = F.transform("breakdown", lambda row: row["code"])
    return _score_row(
        decided.withColumn("codes", listed(codes)),
        "batch_id", "status", "document_type", "income_source_document", "authentic", "confidence", "codes",
    )


@query("per_document_summary")
def _(c):
    return app.per_document_summary(
        c["fx_document"], c["fx_job"], nested_extractions(c), scorecards(c)
    ).withColumns({"flags": listed("flags"), "created_at": stamp("created_at")})


@query("batch_status")
def _(c):
    return app.batch_status(c["fx_batch"], c["fx_job"])


@query("latest_job_per_document")
def _(c):
    return life.latest_job_per_document(c["fx_job"]).select(
        "document_id", "job_id", "status", stamp("created_at").alias("created_at")
    )


# --- review and lifecycle ---------------------------------------------------------------------------------------

@query("review_queue")
def _(c):
    return life.review_queue(c["fx_job"], c["fx_document"]).select(
        "job_id", "document_id", "filename", "confidence_score", "authentic", "auth_confidence",
        long("entity_count").alias("entity_count"), "pii_types_found", "error_message",
        stamp("created_at").alias("created_at"),
    )


@query("apply_review_decisions")
def _(c):
    return life.apply_review_decisions(c["fx_job"], c["fx_review"]).select(
        "job_id", "status", "review_status", "error_message"
    )


@query("conflicting_review_decisions")
def _(c):
    return life.conflicting_review_decisions(c["fx_review"], c["fx_job"])


@query("job_results")
def _(c):
    # One pass over the texts gives the report and the spans of a document; texts
    # that are not redacted are not searched.
    reported = auth.with_authenticity(gates.relevance_classify(accepted_documents(c)))
    parts = red.with_spans(reported.withColumn("text", F.when(F.col("is_financial"), F.col("text")))).select(
        "doc_id",
        F.col("report").alias("authenticity_report"),
        F.when(F.size("spans") > 0, F.col("spans")).alias("redaction_report"),
    )
    # Some documents have reports, but no extraction.
    extracted = nested_extractions(c).where("doc_id % 37 <> 5").withColumn("extracted", F.lit(True))
    report = F.col("authenticity_report")
    scored = scoring.score_columns(
        extracted.join(parts, "doc_id", "full")
        .withColumns({"authentic": report["authentic"], "confidence": report["confidence"], "auth_flags": report["flags"]})
    )
    results = scored.select(
        "doc_id",
        F.when(F.col("extracted"), F.struct("document_type", "income", "account_summary", "risk_flags")).alias("extraction"),
        F.when(F.col("extracted"), F.struct(*scoring.RESULT_COLUMNS)).alias("score_breakdown"),
        "authenticity_report",
        "redaction_report",
    )
    shown = F.transform(
        "redaction_report",
        lambda s: F.concat_ws(":", s["entity_type"], s["start"].cast("string"), s["end"].cast("string")),
    )
    return life.job_results(c["fx_job"], results).select(
        "job_id",
        "doc_id",
        "extraction.document_type",
        "extraction.income.monthly_net_estimated",
        "score_breakdown.score",
        "score_breakdown.recommendation",
        listed(F.transform("score_breakdown.breakdown", lambda r: r["code"])).alias("codes"),
        "authenticity_report.authentic",
        "authenticity_report.confidence",
        listed("authenticity_report.flags").alias("auth_flags"),
        listed(F.array_sort(shown)).alias("redaction_report"),
    )


@query("job_state_from_events")
def _(c):
    events = c["fx_status_event"].withColumnRenamed("ts", "updated_at")
    return life.job_state_from_events(events).select("job_id", "status", "message")


@query("purge_manifest")
def _(c):
    return life.purge_manifest(c["fx_document"], c["fx_job"])


@query("adverse_action_notes")
def _(c):
    decided = life.apply_review_decisions(c["fx_job"], c["fx_review"]).select(
        "job_id", F.col("document_id").alias("doc_id"), F.col("review_status").alias("decision")
    )
    return scoring.adverse_action_notes(decided, scorecards(c))


# --- dashboard ------------------------------------------------------------------------------------------------------

for _name in (
    "status_counts", "processing_totals", "auto_approval_rate", "auth_pass_rate",
    "document_type_mix", "confidence_histogram", "pii_type_ranking", "success_rate",
):
    def _register_dashboard(name: str) -> None:
        @query(name)
        def _(c):
            return getattr(dash, name)(c["fx_job"])

    _register_dashboard(_name)


@query("processed_last_24h")
def _(c):
    return dash.processed_last_24h(c["fx_job"], newest_time(c["fx_job"]))


@query("daily_volume")
def _(c):
    return dash.daily_volume(c["fx_job"], newest_time(c["fx_job"]))


@query("step_durations")
def _(c):
    return dash.step_durations(c["fx_step_event"])


@query("step_failures")
def _(c):
    return dash.step_failures(c["fx_step_event"])


@query("latency_p95")
def _(c):
    return dash.latency_p95(c["fx_step_event"]).withColumn("window_start", stamp("window_start"))


@query("request_rate")
def _(c):
    return dash.request_rate(c["fx_step_event"]).withColumn("window_start", stamp("window_start"))


@query("status_over_time")
def _(c):
    return dash.status_over_time(c["fx_job"]).withColumn("window_start", stamp("window_start"))


# --- streaming --------------------------------------------------------------------------------------------------------

@query("stream_intake")
def _(c):
    """The replay is one micro-batch, so batches arrive whole."""
    stream = c.view("fx_document", orders=stream_of(c, "orders"))
    return streams.run_intake(stream, work_folder(c.spark, "intake")).withColumn("flags", listed("flags"))


@query("stream_intake_in_parts")
def _(c):
    """The files of a batch lie in four parts of the table, each a micro-batch."""
    parts = work_folder(c.spark, "parts")
    c["orders"].repartition(4, "o_orderkey").write.parquet(parts)
    stream = c.view("fx_document", orders=table_stream(c.spark, parts, max_files_per_trigger=1))
    expected = c["fx_document"].groupBy("batch_id").agg(F.count("*").alias("files"))
    rows = streams.run_intake_in_parts(stream, expected, work_folder(c.spark, "intake"))
    return rows.withColumn("flags", listed("flags"))


@query("stream_dedup")
def _(c):
    stream = c.view("fx_file", documents=stream_of(c, "documents"))
    return streams.run_first_files(gates.with_content_hash(stream), work_folder(c.spark, "dedup"))


@query("stream_dedup_keys")
def _(c):
    stream = c.view("fx_file", documents=stream_of(c, "documents"))
    return streams.run_dedup(gates.with_content_hash(stream).drop("content"), work_folder(c.spark, "dedup"))


@query("stream_step_metrics")
def _(c):
    folder = work_folder(c.spark, "steps")
    stream = with_closing_marker(c.view("fx_step_event", events=stream_of(c, "events")), "ts", folder)
    metrics = streams.run_step_metrics(stream, folder).where("step IS NOT NULL")  # the marker has none
    return metrics.withColumn("window_start", stamp("window_start"))


@query("stream_request_rate")
def _(c):
    folder = work_folder(c.spark, "rate")
    events = c.view("fx_step_event", events=stream_of(c, "events")).select("ts")
    rate = streams.run_request_rate(with_closing_marker(events, "ts", folder), folder)
    # Only the marker lies after this time.
    return rate.where("window_start < timestamp '2199-01-01'").withColumn("window_start", stamp("window_start"))


@query("stream_latency_p95")
def _(c):
    """Days merged from sketches of five minutes, held against the rows themselves."""
    folder = work_folder(c.spark, "latency")
    events = c.view("fx_step_event", events=stream_of(c, "events")).select("ts", "seconds")
    days = streams.run_latency(with_closing_marker(events, "ts", folder), folder, "1 day").where("requests > 0")
    days = days.withColumnRenamed("seconds", "p95")
    seconds = F.col("seconds").cast("double")
    rows = c["fx_step_event"].select(F.window("ts", "1 day")["start"].alias("window_start"), seconds.alias("seconds"))
    error = F.lit(streams.SKETCH_RANK_ERROR)
    return (
        rows.join(days, "window_start")
        .groupBy("window_start", "requests")
        .agg(
            (F.avg((F.col("seconds") < F.col("p95")).cast("int")) <= 0.95 + error).alias("_low"),
            (F.avg((F.col("seconds") <= F.col("p95")).cast("int")) >= 0.95 - error).alias("_high"),
        )
        .select(stamp("window_start").alias("window_start"), "requests", (F.col("_low") & F.col("_high")).alias("rank_within_error"))
    )


@query("stream_batch_status")
def _(c):
    stream = c.view("fx_job", orders=stream_of(c, "orders"))
    return streams.run_batch_status(stream, c["fx_batch"], work_folder(c.spark, "status"))


@query("stream_stuck_batches")
def _(c):
    folder = work_folder(c.spark, "stuck")
    stream = with_closing_marker(c.view("fx_status_event", events=stream_of(c, "events")), "ts", folder)
    return streams.run_stuck_batches(stream, folder).select(
        "batch_id", stamp("session_start").alias("session_start"), "last_status", "events"
    )


@query("stream_stuck_now")
def _(c):
    """As of the newest event."""
    stream = c.view("fx_status_event", events=stream_of(c, "events"))
    now = c["fx_status_event"].agg(F.max("ts")).scalar()
    stuck = streams.run_stuck_now(stream, work_folder(c.spark, "stuck"), now)
    return stuck.withColumn("last_event", stamp("last_event"))
