import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkbrief.functions import backoff_delay, is_retryable
from sparkbrief.operators.infer import batch_infer
from sparkbrief.operators.jobs import latest_status, look_up, transitions
from sparkbrief.operators.limits import admit, window_counts
from sparkbrief.operators.logs import format_lines, parse_lines, trace_rollup
from sparkbrief.operators.outcomes import failure_streaks
from sparkbrief.operators.retries import retry_audit
from sparkbrief.sources.sinks import (
    append_job_changes,
    finished,
    queued,
    running,
    write_log_lines,
)
from sparkbrief.sources.states import read_thread_state, write_thread_states
from sparkbrief.sources.tables import (
    read_job_changes,
    read_log_lines,
    read_outcomes,
    read_requests,
    spread,
    table,
)

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


@pytest.mark.parametrize("hot_rows", [1000, 30])
def test_failure_streaks(spark, hot_rows):
    rng = random.Random(8)
    rows = [(rng.choice("aaab"), at(i // 2), i, rng.random() < 0.4) for i in range(300)]
    expect, run = [], {}
    for key, ts, _, ok in rows + [("a", None, None, True), ("b", None, None, True)]:
        if ok:
            if run.get(key):
                expect.append((key, len(run[key]), run[key][0], run[key][-1], len(run[key]) >= 3))
            run[key] = []
        else:
            run.setdefault(key, []).append(ts)
    df = spark.createDataFrame(rows, "key string, ts timestamp, event_id long, ok boolean")
    got = failure_streaks(df, 3, hot_rows).drop("streak").collect()
    assert sorted(tuple(r) for r in got) == sorted(expect)


def test_limits(spark):
    rows = [("c", at(0.1 * i), f"{i:03d}") for i in range(40)] + [("c", at(60), "x"), ("d", at(1), "y")]
    rows += [("tie", at(5), f"{i:03d}") for i in range(35)]
    df = spark.createDataFrame(rows, "client string, ts timestamp, request_key string").repartition(4)
    counts = {(r.client, r.window_start): (r.requests, r.over_limit) for r in window_counts(df).collect()}
    assert counts == {
        ("c", T0): (40, True), ("c", at(60)): (1, False), ("d", T0): (1, False), ("tie", T0): (35, True),
    }
    refused = {(r.client, r.request_key) for r in admit(df).filter("not admitted").collect()}
    assert refused == {("c", f"{i:03d}") for i in range(30, 40)} | {("tie", f"{i:03d}") for i in range(30, 35)}
    assert admit(df).count() == len(rows)


def test_admit_cuts_before_the_shuffle(spark):
    df = spark.createDataFrame([("c", T0, "a")], "client string, ts timestamp, request_key string")
    plan = admit(df)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_retries(spark):
    limit = "Error 429"
    rows = [
        ("ok2", 1, False, limit), ("ok2", 2, True, None),
        ("fatal", 1, False, "bad request"),
        ("out", 1, False, limit), ("out", 2, False, "OVERLOADED"), ("out", 3, False, "503"), ("out", 4, False, "Rate Limit"),
        ("wait", 1, False, "Service Unavailable"),
    ]
    df = spark.createDataFrame(rows, "call_id string, attempt int, ok boolean, error string")
    got = {r.call_id: r for r in retry_audit(df).collect()}
    assert {k: r.outcome for k, r in got.items()} == {
        "ok2": "success", "fatal": "not_retryable", "out": "exhausted", "wait": "pending",
    }
    assert (got["out"].attempts, got["out"].least_wait, got["out"].most_wait) == (4, 7.0, 8.5)
    assert got["fatal"].least_wait == 0.0 and got["ok2"].last_error is None
    flags = spark.createDataFrame([("HTTP 503",), ("nope",), (None,)], "e string").select(is_retryable(F.col("e")).alias("r"))
    assert [r.r for r in flags.collect()] == [True, False, False]
    delays = spark.range(1, 8).select("id", backoff_delay(F.col("id")).alias("d")).collect()
    assert all(min(2 ** (r.id - 1), 30) <= r.d <= min(2 ** (r.id - 1) + 0.5, 30) for r in delays)


def test_jobs(spark):
    rows = [
        ("a", "queued", 0, 0), ("a", "running", 1, 1), ("a", "done", 2, 2),
        ("b", "queued", 0, 3), ("b", "done", 0, 4), ("c", "running", 5, 5),
    ]
    df = spark.createDataFrame(
        [(j, s, at(t), q) for j, s, t, q in rows], "job_id string, status string, ts timestamp, seq long"
    )
    latest = latest_status(df)
    assert {r.job_id: r.status for r in latest.collect()} == {"a": "done", "b": "done", "c": "running"}
    ids = spark.createDataFrame([("a",), ("z",)], "job_id string")
    assert {r.job_id: (r.found, r.status) for r in look_up(ids, latest).collect()} == {
        "a": (True, "done"), "z": (False, None),
    }
    for hot_rows in (100, 1):
        legal = {(r.job_id, r.seq): (r.previous, r.legal) for r in transitions(df, hot_rows).collect()}
        assert legal == {
            ("a", 0): (None, True), ("a", 1): ("queued", True), ("a", 2): ("running", True),
            ("b", 3): (None, True), ("b", 4): ("queued", False), ("c", 5): (None, False),
        }


def test_job_log(spark, tmp_path):
    path = str(tmp_path / "jobs")
    jobs = spark.createDataFrame([("a", "t", None), ("b", "u", "boom")], "job_id string, thread_id string, error_detail string")
    append_job_changes(queued(jobs.drop("error_detail")), path)
    append_job_changes(running(jobs.drop("error_detail")), path)
    append_job_changes(finished(jobs), path)
    got = {r.job_id: (r.status, r.error_detail) for r in latest_status(read_job_changes(spark, path)).collect()}
    assert got == {"a": ("done", None), "b": ("error", "boom")}


def test_logs(spark, tmp_path):
    rows = [
        (at(1.25), "INFO", "svc", '訊息 "x"', "r1", "", {"env": "dev", "lineno": "7"}),
        (at(2), "ERROR", "svc.b", "m", "r1", "t", None),
        (at(3), "INFO", "svc", "m", None, None, {"name": "reserved", "level": "NOTE"}),
    ]
    logs = spark.createDataFrame(
        rows, "ts timestamp, level string, name string, msg string, request_id string, thread_id string, extras map<string,string>"
    )
    lines = [json.loads(r.value) for r in format_lines(logs).collect()]
    assert lines[0] == {
        "ts": "2024-01-01 00:00:01,250", "level": "INFO", "name": "svc", "msg": '訊息 "x"', "request_id": "r1", "env": "dev",
    }
    assert lines[2] == {"ts": "2024-01-01 00:00:03,000", "level": "NOTE", "name": "svc", "msg": "m"}
    path = str(tmp_path / "logs")
    write_log_lines(logs, path)
    back = read_log_lines(spark, path).orderBy("ts").collect()
    assert [(r.ts, r.msg, r.thread_id, r.extras) for r in back][:2] == [
        (at(1.25), '訊息 "x"', None, {"env": "dev"}), (at(2), "m", "t", {}),
    ]
    broken = parse_lines(spark.createDataFrame([("Traceback",), ('{"ts": "yesterday"}',)], "value string")).collect()
    assert broken[0].bad_line == "Traceback" and broken[0].msg is None
    assert broken[1].ts is None and broken[1].bad_line is None
    rolled = trace_rollup(logs).collect()
    assert [(r.request_id, r.lines, r.errors, r.first_ts, r.last_ts, r.names) for r in rolled] == [
        ("r1", 2, 1, at(1.25), at(2), ["svc", "svc.b"])
    ]


def test_batch_infer(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def model(prompt: str) -> str:
        with open(calls, "a") as log:
            log.write(prompt + "\n")
        if prompt == "busy":
            raise RuntimeError("Error 429")
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    prompts = ["a", "a", "b", "busy", "bad", "known", None] + ["hot"] * 40
    df = spark.createDataFrame([(i, p) for i, p in enumerate(prompts)], "i int, p string").repartition(4)
    stored = spark.createDataFrame([("known", "K")], "prompt string, response string")
    got = batch_infer(df, "p", model, stored, sleep=lambda _: None).collect()
    assert len(got) == len(prompts)
    assert {r.p: (r.response, r.error, r.attempts) for r in got} == {
        "a": ("A", None, 1), "b": ("B", None, 1), "busy": (None, "Error 429", 4), "bad": (None, "no", 1),
        "known": ("K", None, None), None: (None, None, None), "hot": ("HOT", None, 1),
    }
    with open(calls) as log:
        assert sorted(log.read().split()) == sorted(["a", "b", "bad", "hot"] + ["busy"] * 4)


def test_sources(spark, sf, tmp_path):
    path = str(tmp_path / "requests")
    with open(path, "w") as out:
        out.write('{"user_input": "q", "max_steps": 3}\n{"thread_id": "t"}\n')
    got = read_requests(spark, path).orderBy("max_steps").collect()
    assert [(r.user_input, r.thread_id, r.max_steps) for r in got] == [(None, "t", None), ("q", None, 3)]
    events = table(spark, sf, "events")
    assert spread(events).rdd.getNumPartitions() == 8
    outcomes = str(tmp_path / "outcomes")
    spark.createDataFrame([("k", T0, 1, True)], "key string, ts timestamp, event_id long, ok boolean").write.parquet(outcomes)
    assert read_outcomes(spark, outcomes).count() == 1 and read_outcomes(spark, outcomes, stream=True).isStreaming


def test_thread_state_sink(spark, tmp_path):
    path = str(tmp_path / "states")
    states = spark.createDataFrame([(f"t{i}", i) for i in range(50)], "thread_id string, step int")
    write_thread_states(states, path)
    assert [r.step for r in read_thread_state(spark, path, "t7").collect()] == [7]
