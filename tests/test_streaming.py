"""Streams: late rows, repeats across micro-batches, restarts."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from docketry.streaming import jobs
from docketry.streaming.replay import run_to_folder, table_stream, with_closing_marker

START = datetime(2025, 1, 1, 12, 0, 0)


def at(seconds):
    return START + timedelta(seconds=seconds)


def arrive(spark, folder, rows, schema):
    """One more file in the folder a stream reads."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def closed(spark, source, tmp_path):
    """A replay that ends for good."""
    return with_closing_marker(table_stream(spark, str(source)), "ts", str(tmp_path / "m"))


def test_a_second_run_goes_on_with_the_first(spark, tmp_path):
    """New events of later hours are counted; complete windows come out once."""
    schema = "ts timestamp, step string, seconds decimal(18,2), outcome string"
    source = tmp_path / "in"

    def run(name, job):
        rows = job(table_stream(spark, str(source)), str(tmp_path / name))
        return sorted((r.window_start, r[2] if name == "steps" else r.requests) for r in rows.collect())

    first = [(at(s), "parse", None, "ok") for s in (0, 10, 3600)]
    later = [(at(s), "parse", None, "ok") for s in (5 * 3600, 6 * 3600, 7 * 3600)]
    arrive(spark, source, first, schema)
    assert run("steps", jobs.run_step_metrics) == [(at(0), 2)]
    rates = run("rate", jobs.run_request_rate)
    arrive(spark, source, later, schema)
    assert run("steps", jobs.run_step_metrics) == [(at(0), 2), (at(3600), 1), (at(5 * 3600), 1), (at(6 * 3600), 1)]
    again = run("rate", jobs.run_request_rate)
    assert set(rates) <= set(again) and sum(n for _, n in again) == 8 * 5


def test_late_events_are_dropped_and_windows_add_up(spark, tmp_path):
    schema = "ts timestamp, step string, seconds decimal(18,2), outcome string"
    source, out = tmp_path / "in", str(tmp_path / "out")
    arrive(spark, source, [(at(0), "parse", None, "ok"), (at(10), "parse", None, "error"), (at(3600), "redact", None, "ok")], schema)

    def run():
        stream = table_stream(spark, str(source))
        return run_to_folder(jobs.step_metrics(stream), out)

    run()
    # An hour late: its window was given out already.
    arrive(spark, source, [(at(20), "parse", None, "error"), (at(7200), "redact", None, "ok")], schema)
    rows = {(r.window_start, r.step): (r.runs, r.failures) for r in run().collect()}
    assert rows[at(0), "parse"] == (2, 1)


def test_dedup_across_files(spark, tmp_path):
    schema = "doc_id long, batch_id long, content_hash string, created_at timestamp"
    source, out = tmp_path / "in", str(tmp_path / "out")
    arrive(spark, source, [(i, 1, "same" if i < 200 else f"h{i}", at(i)) for i in range(300)], schema)

    def run():
        return jobs.run_dedup(table_stream(spark, str(source)), out)

    assert run().count() == 101
    arrive(spark, source, [(400, 1, "same", at(400)), (401, 2, "same", at(401)), (402, 1, "new", at(402))], schema)
    assert sorted((r.batch_id, r.content_hash) for r in run().collect() if r.content_hash in ("same", "new")) == [
        (1, "new"), (1, "same"), (2, "same"),
    ]


def test_restart_adds_nothing(spark, tmp_path):
    schema = "ts timestamp, doc_id long"
    source, out = tmp_path / "in", str(tmp_path / "out")
    arrive(spark, source, [(at(i), i) for i in range(10)], schema)
    for _ in range(2):
        stored = run_to_folder(table_stream(spark, str(source)), out)
        assert stored.count() == 10


def test_batch_status_follows_the_newest_job(spark, tmp_path):
    schema = "job_id long, document_id long, batch_id long, created_at timestamp, status string"
    source, out = tmp_path / "in", str(tmp_path / "out")
    batches = spark.createDataFrame([(1,), (2,), (3,)], "batch_id long")

    def statuses():
        found = jobs.run_batch_status(table_stream(spark, str(source)), batches, out)
        return {r.batch_id: r.status for r in found.collect()}

    arrive(spark, source, [(1, 1, 1, at(0), "RUNNING"), (2, 2, 1, at(0), "SUCCEEDED"), (3, 3, 2, at(0), "FAILED")], schema)
    assert statuses() == {1: "RUNNING", 2: "FAILED", 3: "EMPTY"}
    arrive(spark, source, [(4, 1, 1, at(60), "SUCCEEDED"), (5, 3, 2, at(-60), "SUCCEEDED")], schema)
    assert statuses() == {1: "SUCCEEDED", 2: "FAILED", 3: "EMPTY"}


def test_batch_status_after_a_run_that_was_cut_off(spark, tmp_path):
    """The micro-batch that failed leaves nothing; the next run takes it up again."""
    schema = "job_id long, document_id long, batch_id long, created_at timestamp, status string"
    source, out = tmp_path / "in", str(tmp_path / "out")
    batches = spark.createDataFrame([(1,), (2,)], "batch_id long")

    def found(frame):
        return {r.batch_id: r.status for r in frame.collect()}

    arrive(spark, source, [(1, 1, 1, at(0), "RUNNING")], schema)
    assert found(jobs.run_batch_status(table_stream(spark, str(source)), batches, out)) == {1: "RUNNING", 2: "EMPTY"}
    arrive(spark, source, [(2, 1, 1, at(60), "SUCCEEDED"), (3, 2, 2, at(0), "FAILED")], schema)
    broken = table_stream(spark, str(source)).withColumn(
        "status", F.when(F.col("status") == "FAILED", F.raise_error(F.lit("lost"))).otherwise(F.col("status"))
    )
    with pytest.raises(Exception, match="lost"):
        jobs.run_batch_status(broken, batches, out)
    assert found(jobs.stored_batch_status(batches, out)) == {1: "RUNNING", 2: "EMPTY"}
    assert found(jobs.run_batch_status(table_stream(spark, str(source)), batches, out)) == {1: "SUCCEEDED", 2: "FAILED"}


def test_stuck_sessions(spark, tmp_path):
    schema = "event_id long, ts timestamp, batch_id long, job_id long, status string"
    source, out = tmp_path / "in", str(tmp_path / "out")
    events = [
        (1, at(0), 1, 1, "QUEUED"), (2, at(100), 1, 1, "RUNNING"),       # falls silent while running
        (3, at(0), 2, 2, "RUNNING"), (4, at(119), 2, 2, "SUCCEEDED"),    # finishes
        (5, at(500), 1, 1, "SUCCEEDED"),                                 # comes back later
    ]
    arrive(spark, source, events, schema)
    rows = jobs.run_stuck_batches(closed(spark, source, tmp_path), out).collect()
    assert [(r.batch_id, r.last_event, r.last_status, r.events) for r in rows] == [(1, at(100), "RUNNING", 2)]


def test_request_rate_counts_every_request_eight_times(spark, tmp_path):
    schema = "ts timestamp"
    source, out = tmp_path / "in", str(tmp_path / "out")
    arrive(spark, source, [(at(i),) for i in range(0, 200, 7)], schema)
    rows = jobs.run_request_rate(closed(spark, source, tmp_path), out).where("window_start < timestamp '2199-01-01'")
    assert rows.agg(F.sum("requests")).first()[0] == 8 * len(range(0, 200, 7))


def test_marker_is_one_row(spark, tmp_path):
    source = tmp_path / "in"
    arrive(spark, source, [(at(0), 1)], "ts timestamp, n long")
    stream = with_closing_marker(table_stream(spark, str(source)), "ts", str(tmp_path / "m"))
    stored = run_to_folder(stream, str(tmp_path / "out"))
    assert stored.where("n IS NULL").count() == 1 and stored.count() == 2


FILES = "doc_id long, batch_id long, content_hash string, created_at timestamp"


def test_first_files_whatever_the_order_of_arrival(spark, tmp_path):
    rows = [(i, 1, "same", at(i)) for i in range(40)] + [
        (50, 1, "tie", at(5)), (49, 1, "tie", at(5)), (60, 2, "same", at(0)), (70, None, None, at(1)),
        (71, None, None, at(0)), (80, 3, "one", None),
    ]
    found = []
    for name, order in [("one", [rows]), ("many", [rows[i::7] for i in reversed(range(7))])]:
        source, out = tmp_path / name, str(tmp_path / f"{name}-out")
        for part in order:
            arrive(spark, source, part, FILES)
            result = jobs.run_first_files(table_stream(spark, str(source)), out)
        found.append(sorted((r.doc_id, r.first_doc_id, r.is_repeat) for r in result.collect()))
    assert found[0] == found[1] and len(found[0]) == len(rows)
    first = {doc: kept for doc, kept, _ in found[0]}
    assert {first[i] for i in range(40)} == {0}
    assert (first[50], first[49], first[60], first[70], first[71], first[80]) == (49, 49, 60, 71, 71, 80)
    assert all(repeat == (doc != kept) for doc, kept, repeat in found[0])


def test_stuck_while_every_stream_is_quiet(spark, tmp_path):
    schema = "event_id long, ts timestamp, batch_id long, job_id long, status string"
    source, out = tmp_path / "in", str(tmp_path / "out")
    events = [
        (1, at(0), 1, 1, "QUEUED"), (2, at(100), 1, 1, "RUNNING"), (3, at(0), 2, 2, "RUNNING"),
        (4, at(50), 2, 2, "SUCCEEDED"), (5, at(150), 3, 3, "QUEUED"), (6, at(0), None, 4, "RUNNING"),
    ]
    arrive(spark, source, events, schema)

    def stuck(seconds):
        rows = jobs.stored_stuck_batches(spark, out, F.lit(at(seconds))).collect()
        return sorted((r.batch_id, r.last_event, r.last_status, r.events) for r in rows)

    jobs.run_stuck_now(table_stream(spark, str(source)), out, F.lit(at(0)))
    # Nothing arrives any more; only the clock goes on.
    assert stuck(219) == []
    assert stuck(220) == [(1, at(100), "RUNNING", 2)]
    assert stuck(300) == [(1, at(100), "RUNNING", 2), (3, at(150), "QUEUED", 1)]
    arrive(spark, source, [(7, at(290), 1, 1, "RUNNING")], schema)
    rows = jobs.run_stuck_now(table_stream(spark, str(source)), out, F.lit(at(300))).collect()
    assert [r.batch_id for r in rows] == [3]


DOCUMENTS = (
    "doc_id long, batch_id long, filename string, content_type string, magic string, size_bytes long, "
    "producer string, creation_date string, mod_date string, text string, first_page_text string, created_at timestamp"
)


def upload(doc, batch, name, text, second):
    text = f"{text} gross pay net pay pay period {doc}"
    return (doc, batch, name, "application/pdf", "%PDF", 5000, "x", "D:1", "D:1", text, text, at(second))


def test_intake_in_parts(spark, tmp_path):
    """One micro-batch or many: the batches come out alike."""
    copy = upload(7, 2, "pay_7.pdf", "earnings statement", 3)
    rows = [
        upload(1, 1, "bank_1.pdf", "account summary", 0), upload(2, 1, "pay_2.pdf", "earnings statement", 400),
        upload(5, 2, "bank_5.pdf", "account summary", 1), copy, (8, 2, "pay_8.pdf", *copy[3:]),
        upload(9, 3, "bank_9.pdf", "account summary", 2),   # the second file never comes
        upload(11, 4, "bank_11.pdf", "account summary", 2),  # not announced
        upload(12, None, "bank_12.pdf", "account summary", 2),
    ]
    expected = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (9, 1)], "batch_id long, files long")
    found = []
    for name, limit in [("one", None), ("many", 1)]:
        source, out = tmp_path / name, str(tmp_path / f"{name}-out")
        for row in rows if limit else [None]:
            arrive(spark, source, [row] if limit else rows, DOCUMENTS)

        def run(seconds=None):
            now = None if seconds is None else F.lit(at(seconds))
            result = jobs.run_intake_in_parts(table_stream(spark, str(source), limit), expected, out, now)
            return sorted((r.doc_id, r.outcome, r.reason) for r in result.collect())

        complete = run()
        assert [r[0] for r in complete] == [1, 2, 5, 7, 8]
        assert {r[0]: r[1] for r in complete}[7] == "REJECTED"
        assert run(600) == complete
        late = run(1000)  # nothing new, but the time-out has passed
        assert [r[0] for r in late] == [1, 2, 5, 7, 8, 9, 11, 12]
        arrive(spark, source, [upload(10, 3, "pay_10.pdf", "earnings statement", 990)], DOCUMENTS)
        found.append((complete, late, run(1000)))
        assert [r[0] for r in found[-1][2]] == [1, 2, 5, 7, 8, 9, 10, 11, 12]
    assert found[0] == found[1]


def test_a_file_too_many_has_its_batch_gated_again(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    expected = spark.createDataFrame([(1, 2)], "batch_id long, files long")

    def run():
        result = jobs.run_intake_in_parts(table_stream(spark, str(source)), expected, out)
        return {r.doc_id: r.outcome for r in result.collect()}

    first = upload(1, 1, "bank_1.pdf", "account summary", 0)
    arrive(spark, source, [first, upload(2, 1, "pay_2.pdf", "earnings statement", 1)], DOCUMENTS)
    assert "REJECTED" not in run().values()
    arrive(spark, source, [(3, 1, "bank_3.pdf", *first[3:])], DOCUMENTS)
    assert run() == {1: "REJECTED", 2: "REJECTED", 3: "REJECTED"}


def test_latency_of_sketches_goes_on_and_merges(spark, tmp_path):
    schema = "ts timestamp, seconds decimal(18,2)"
    source, out = tmp_path / "in", str(tmp_path / "out")
    # 5,000 requests in the first five minutes, more than a sketch has places; one without a time.
    arrive(spark, source, [(at(i % 300), Decimal(i)) for i in range(5000)] + [(at(10), None)], schema)
    arrive(spark, source, [(at(300 + i), Decimal(i)) for i in range(200)] + [(at(700), None), (at(7200), Decimal(1))], schema)

    def run(period):
        rows = jobs.run_latency(table_stream(spark, str(source)), out, period).collect()
        return {r.window_start: (r.requests, r.seconds) for r in rows}

    five = run("5 minutes")
    assert set(five) == {at(0), at(300), at(600)}  # the last window is open
    assert five[at(0)][0] == 5000 and abs(five[at(0)][1] - 4750) <= 50
    assert five[at(300)] == (200, 189.0) and five[at(600)] == (0, None)
    hour = run("1 hour")
    share = sum(x <= hour[at(0)][1] for x in [*range(5000), *range(200)]) / 5200
    assert hour[at(0)][0] == 5200 and abs(share - 0.95) <= jobs.SKETCH_RANK_ERROR
    arrive(spark, source, [(at(4 * 3600), Decimal(1))], schema)
    assert run("5 minutes")[at(7200)] == (1, 1.0)
