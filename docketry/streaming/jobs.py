"""The streaming jobs: intake, duplicates, step metrics, rates, batch states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import fixed_values as V
from docketry.operators.application import status_of_batches
from docketry.operators.authenticity import with_authenticity
from docketry.operators.dashboard import RATE
from docketry.operators.gates import batch_gate, relevance_classify, with_content_hash
from docketry.operators.redaction import redact_text
from docketry.streaming.replay import run_to_folder, run_to_state, state_of, stored_stream

# An upload that is not complete this long after its last file is taken as it is.
UPLOAD_TIMEOUT = "15 minutes"
# Size of a latency sketch; a quantile's rank is then within 1 % (0.4 % as a rule).
SKETCH_SIZE = 800
SKETCH_RANK_ERROR = 0.01
# Spread of a hot duplicate key in the first of two dedup steps.
DEDUP_SALTS = 32


def intake(documents: DataFrame) -> DataFrame:
    """Gate, classify, authenticate and redact documents.

    ``documents`` holds whole batches. Documents of a batch with a repeated
    file, rejected ones and those of an incomplete batch do not enter the
    pipeline; neither are irrelevant ones processed further.
    """
    gated = batch_gate(documents)
    open_ = F.col("gate_outcome").isNull()
    classified = relevance_classify(
        gated.withColumn("_passed", F.when(open_, F.col("text"))).drop("text", "first_page_text")
        .withColumnRenamed("_passed", "text")
    )
    relevant = classified.withColumn("text", F.when(F.col("is_financial"), F.col("text")))
    processed = redact_text(with_authenticity(relevant))
    done = F.col("text").isNotNull()
    return processed.select(
        "doc_id",
        "batch_id",
        F.coalesce("gate_outcome", F.when(~done, "FAILED").otherwise("PROCESSED")).alias("outcome"),
        F.col("gate_reason").alias("reason"),
        F.when(open_, F.col("category")).alias("category"),
        *[F.when(done, F.col(f"report.{c}")).alias(c) for c in ("document_type", "authentic", "confidence", "flags")],
        "redacted_text",
    )


def run_intake(documents: DataFrame, folder: str) -> DataFrame:
    """Each micro-batch is gated as a whole: the files of an upload arrive in
    one, as they come with one request."""
    return run_to_folder(documents, folder, each=intake).drop("epoch")


def arrivals(stored: DataFrame) -> DataFrame:
    """Files of each batch so far, the last one's time and the epoch of the first."""
    return stored.groupBy("batch_id").agg(
        F.count("*").alias("arrived"), F.max("created_at").alias("last_arrival"), F.min("epoch").alias("since")
    )


def run_intake_in_parts(
    documents: DataFrame,
    expected: DataFrame,
    folder: str,
    now: Column | None = None,
    timeout: str = UPLOAD_TIMEOUT,
) -> DataFrame:
    """The intake where the files of a batch arrive over any number of micro-batches.

    ``expected`` has batch_id and files, the number of files announced. Files are
    stored as they arrive and counted per batch in the keyed state of a second
    stream. In the micro-batch in which a batch has all its files it is gated and
    processed as a whole; only files since its first one are read again.

    With ``now``, a batch that was not announced or still lacks files is taken as it
    is once ``timeout`` has passed since its last file. A file that comes when its
    batch is complete has the batch gated once more, with it; the newest result of
    a batch counts. So the rows depend on the files, not on how they are cut.

    Documents without a batch are never complete; they are taken on time-out.
    """
    spark = documents.sparkSession
    stored = run_to_folder(documents, f"{folder}/files")
    announced = expected.select("batch_id", "files")
    all_here = F.col("arrived") >= F.col("files")

    def files_of(batches: DataFrame) -> DataFrame:
        wanted = batches.select(F.col("batch_id").alias("_batch"))
        return stored.join(wanted, F.col("batch_id").eqNullSafe(F.col("_batch")), "left_semi").drop("epoch")

    ready_path = f"{folder}/ready"
    # What is shuffled for the gate is the hash of a text; texts are shuffled once.
    hashed = with_content_hash(stored, "text")

    def complete(changed: DataFrame) -> DataFrame:
        # Stored, as it is used twice: the counting is not to run again for each use.
        ready = changed.join(announced, "batch_id").where(all_here).select("batch_id", "since")
        ready.write.mode("overwrite").parquet(ready_path)
        ready = spark.read.schema(ready.schema).parquet(ready_path)
        first = ready.agg(F.min("since")).first()[0]
        since = hashed.where(F.col("epoch") >= first) if first is not None else hashed.where("false")
        return intake(since.join(ready.select("batch_id"), "batch_id", "left_semi").drop("epoch"))

    counted = arrivals(stored_stream(spark, f"{folder}/files").select("batch_id", "created_at", "epoch"))
    results = run_to_folder(counted, f"{folder}/complete", mode="update", each=complete)
    newest = results.groupBy("batch_id").agg(F.max("epoch").alias("epoch"))
    done = results.join(newest, ["batch_id", "epoch"], "left_semi").drop("epoch")
    if now is None:
        return done
    state = state_of(spark, f"{folder}/complete")
    waiting = (
        state.select("key.batch_id", "value.*")
        .toDF("batch_id", "arrived", "last_arrival", "since")
        .join(announced, "batch_id", "left")
        .where(~F.coalesce(all_here, F.lit(False)) & (F.col("last_arrival") <= now - F.expr(f"INTERVAL {timeout}")))
    )
    return done.unionByName(intake(files_of(waiting)))


def run_first_files(files: DataFrame, folder: str) -> DataFrame:
    """Every file so far with the first file of its content in its batch.

    The first is the earliest by created_at, then doc_id, whatever the order of
    arrival: an earlier file that arrives later takes the place, and the former
    first one is a repeat from then on. The earliest file of each (batch_id,
    content_hash) is the keyed state of a stream over the stored files, cut by a
    partial minimum in each task, so a content that most files share does not meet
    in one task. NULLs are equal here. The state has one row for each distinct
    content of a batch and is not expired; ``deduplicated`` has bounded state instead.
    """
    slim = files.select("doc_id", "batch_id", "content_hash", "created_at")
    stored = run_to_folder(slim, f"{folder}/files").drop("epoch")
    earliest = (
        stored_stream(files.sparkSession, f"{folder}/files")
        .groupBy("batch_id", "content_hash")
        .agg(F.min(F.struct("created_at", "doc_id")).alias("first"))
    )
    run_to_state(earliest, f"{folder}/first")
    state = state_of(files.sparkSession, f"{folder}/first")
    first = state.select("key.*", "value.*").toDF("_batch", "_hash", "_first")
    same = F.col("batch_id").eqNullSafe(F.col("_batch")) & F.col("content_hash").eqNullSafe(F.col("_hash"))
    return stored.join(first, same).select(
        "doc_id",
        "batch_id",
        "content_hash",
        F.col("_first.doc_id").alias("first_doc_id"),
        (F.col("doc_id") != F.col("_first.doc_id")).alias("is_repeat"),
    )


def deduplicated(files: DataFrame, event_time: str, delay: str) -> DataFrame:
    """First file of each (batch_id, content_hash) within the watermark.

    The first step works on salted keys, so a hash that most files share is
    cut to a few rows before all of them meet.
    """
    keyed = files.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(DEDUP_SALTS)))
    return (
        keyed.withWatermark(event_time, delay)
        .dropDuplicatesWithinWatermark(["batch_id", "content_hash", "_salt"])
        .dropDuplicatesWithinWatermark(["batch_id", "content_hash"])
        .drop("_salt")
    )


def run_dedup(files: DataFrame, folder: str, event_time: str = "created_at", delay: str = "1 day") -> DataFrame:
    kept = deduplicated(files, event_time, delay).select("batch_id", "content_hash")
    return run_to_folder(kept, folder).drop("epoch")


def step_metrics(step_events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Runs, seconds and failures per step and minute."""
    return (
        step_events.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 minute").alias("minute"), "step")
        .agg(
            F.count("*").alias("runs"),
            F.sum(F.col("seconds").cast("decimal(18,4)")).alias("seconds"),
            F.count_if(F.col("outcome") != "ok").alias("failures"),
        )
        .select(F.col("minute.start").alias("window_start"), "step", "runs", "seconds", "failures")
    )


def run_step_metrics(step_events: DataFrame, folder: str) -> DataFrame:
    """The minutes that are complete; later runs on the folder add more."""
    return run_to_folder(step_metrics(step_events), folder).drop("epoch")


def live_request_rate(requests: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Requests per second over two minutes, every 15 seconds.

    Counted per 15 seconds first; only the counts are spread over windows.
    """
    slots = (
        requests.withWatermark("ts", delay)
        .groupBy(F.window("ts", f"{V.SCRAPE_SECONDS} seconds").alias("slot"))
        .agg(F.count("*").alias("n"))
    )
    return (
        slots.groupBy(
            F.window(
                F.window_time("slot"), f"{V.RATE_WINDOW_SECONDS} seconds", f"{V.SCRAPE_SECONDS} seconds"
            ).alias("span")
        )
        .agg(F.sum("n").alias("requests"))
        .select(
            F.col("span.start").alias("window_start"),
            "requests",
            F.round(F.col("requests") / F.lit(V.RATE_WINDOW_SECONDS).cast("decimal(9,0)"), 6)
            .cast(RATE)
            .alias("per_second"),
        )
    )


def run_request_rate(requests: DataFrame, folder: str) -> DataFrame:
    """The windows that are complete; later runs on the folder add more."""
    return run_to_folder(live_request_rate(requests.select("ts")), folder).drop("epoch")


def latency_sketches(requests: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A KLL sketch of the request seconds of every five minutes.

    A sketch has a few KB whatever the number of requests and merges with others, in
    each task before the shuffle as well as over windows later on.
    """
    return (
        requests.withWatermark("ts", delay)
        .groupBy(F.window("ts", f"{V.LATENCY_WINDOW_SECONDS} seconds").alias("span"))
        .agg(F.kll_sketch_agg_double(F.col("seconds").cast("double"), SKETCH_SIZE).alias("sketch"))
        .select(F.col("span.start").alias("window_start"), "sketch")
    )


def latency_over(sketches: DataFrame, period: str, percent: int = 95) -> DataFrame:
    """requests and the percentile of their seconds over longer windows, from the
    sketches alone; NULL where no request has a time."""
    merged = sketches.groupBy(F.window("window_start", period)["start"].alias("window_start")).agg(
        F.kll_merge_agg_double("sketch").alias("_sketch")
    )
    requests = F.kll_sketch_get_n_double("_sketch")
    return merged.select(
        "window_start",
        requests.alias("requests"),
        F.when(requests > 0, F.kll_sketch_get_quantile_double("_sketch", F.lit(percent / 100))).alias("seconds"),
    )


def run_latency(requests: DataFrame, folder: str, period: str = "5 minutes") -> DataFrame:
    """The 95th percentile of the windows that are complete; later runs on the folder
    add more. Within 1 % of the rank; exact while a window has fewer requests than
    the sketch has places."""
    sketches = run_to_folder(latency_sketches(requests.select("ts", "seconds")), folder)
    return latency_over(sketches, period)


def newest_jobs(job_events: DataFrame) -> DataFrame:
    """The newest job of each document: (batch_id, document_id, newest)."""
    newest = F.max(F.struct("created_at", (-F.col("job_id")).alias("_order"), "status"))
    return job_events.groupBy("batch_id", "document_id").agg(newest.alias("newest"))


def run_batch_status(job_events: DataFrame, batches: DataFrame, folder: str) -> DataFrame:
    """Status of every batch after the events so far.

    The newest job of each document is the keyed state of the stream, one row for a
    document, in the state store under ``folder``. It is read as of the last
    micro-batch that was committed, so a run that was cut off counts as far as it
    came, and the next one goes on from there. Nothing else is stored.
    """
    run_to_state(newest_jobs(job_events), folder)
    return stored_batch_status(batches, folder)


def stored_batch_status(batches: DataFrame, folder: str) -> DataFrame:
    """The same from what earlier runs on the folder have committed."""
    state = state_of(batches.sparkSession, folder)
    newest = state.select("key.batch_id", "value.*").toDF("batch_id", "newest")
    return status_of_batches(batches, newest.select("batch_id", "newest.status"))


def quiet_sessions(status_events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Runs of events per batch without a gap of 120 seconds, and their last status."""
    return (
        status_events.withWatermark("ts", delay)
        .groupBy(
            F.session_window("ts", f"{V.STUCK_AFTER_SECONDS} seconds").alias("session"), "batch_id"
        )
        .agg(F.max(F.struct("ts", "event_id", "status")).alias("_last"), F.count("*").alias("events"))
        .select(
            "batch_id",
            F.col("session.start").alias("session_start"),
            F.col("_last.ts").alias("last_event"),
            F.col("_last.status").alias("last_status"),
            "events",
        )
    )


def run_stuck_batches(status_events: DataFrame, folder: str) -> DataFrame:
    """Sessions that fell silent while the batch was still running."""
    stored = run_to_folder(quiet_sessions(status_events), folder)
    return stored.where(F.col("batch_id").isNotNull() & F.col("last_status").isin("RUNNING", "QUEUED")).drop("epoch")


def last_statuses(status_events: DataFrame) -> DataFrame:
    """The last event of each batch and the number of events."""
    last = F.max(F.struct("ts", "event_id", "status"))
    return status_events.groupBy("batch_id").agg(last.alias("last"), F.count("*").alias("events"))


def run_stuck_now(status_events: DataFrame, folder: str, now: Column | None = None) -> DataFrame:
    """Batches that are running and have been silent for 120 seconds at ``now``.

    ``now`` is the clock unless given. The last status of a batch is keyed state, one
    row for a batch, so a batch is found even when no stream delivers anything.
    """
    run_to_state(last_statuses(status_events), folder)
    return stored_stuck_batches(status_events.sparkSession, folder, now)


def stored_stuck_batches(spark, folder: str, now: Column | None = None) -> DataFrame:
    """The same from what earlier runs on the folder have committed; to be asked at
    any time, also while a run goes on."""
    now = F.current_timestamp() if now is None else now
    state = state_of(spark, folder)
    last = state.select("key.batch_id", "value.*").toDF("batch_id", "last", "events")
    return last.where(
        F.col("batch_id").isNotNull()
        & F.col("last.status").isin("RUNNING", "QUEUED")
        & (F.col("last.ts") <= now - F.expr(f"INTERVAL {V.STUCK_AFTER_SECONDS} SECONDS"))
    ).select("batch_id", F.col("last.ts").alias("last_event"), F.col("last.status").alias("last_status"), "events")
