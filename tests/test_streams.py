import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkbrief.operators.breaker import BreakerRule, breaker_timeline
from sparkbrief.operators.cache import ttl_lookups
from sparkbrief.operators.jobs import latest_status
from sparkbrief.operators.limits import admit, window_counts
from sparkbrief.operators.state import thread_state
from sparkbrief.plans.streams import _arriving
from sparkbrief.streaming.admission import admit_stream
from sparkbrief.streaming.folds import breaker_stream, fan_in_stream, ttl_stream
from sparkbrief.streaming.tables import (
    job_status_table,
    rate_limit_stream,
    thread_state_table,
    upsert_job_status,
    upsert_thread_state,
    written,
)

T0 = datetime(2024, 1, 1)
FAR = T0 + timedelta(days=3650)


@pytest.fixture
def arriving(spark, tmp_path):
    """Rows as files of a stream, one file a micro-batch, in the given order."""

    def make(batches, schema):
        folder = tmp_path / f"in{random.random()}"
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"part={n}"))
            for name in os.listdir(folder / f"part={n}"):
                os.utime(folder / f"part={n}" / name, (1_700_000_000 + n * 60,) * 2)
        reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
        return reader.option("recursiveFileLookup", "true").parquet(str(folder))

    return make


def in_batches(rows, n, rng):
    """Rows in time order cut into batches; within a batch in any order."""
    size = -(-len(rows) // n)
    batches = [rows[i : i + size] for i in range(0, len(rows), size)]
    for batch in batches:
        rng.shuffle(batch)
    return batches


def same_rows(stream, batch):
    names = sorted(batch.columns)
    ours = sorted(stream.select(*names).collect(), key=repr)
    assert ours == sorted(batch.select(*names).collect(), key=repr)
    return len(ours)


def test_breaker_stream_equals_batch(spark, arriving):
    rng = random.Random(3)
    rows = [(rng.choice("aab"), T0 + timedelta(seconds=7 * i), i, rng.random() < 0.5) for i in range(200)]
    schema = "key string, ts timestamp, event_id long, ok boolean"
    rule = BreakerRule(2, 30)
    batches = in_batches(rows, 4, rng) + [[("end", FAR, 999, True)]]
    told = written(breaker_stream(arriving(batches, schema), rule), "t").filter("key <> 'end'")
    expect = breaker_timeline(spark.createDataFrame(rows, schema), rule)
    assert same_rows(told, expect) == 200


def test_null_keys_are_keys_like_any_other(spark, arriving):
    rows = [(None if i % 3 else i % 2, T0 + timedelta(seconds=7 * i), i, i % 5 == 0) for i in range(60)]
    schema = "key long, ts timestamp, event_id long, ok boolean"
    batches = in_batches(rows, 3, random.Random(1)) + [[(99, FAR, 999, True)]]
    told = written(breaker_stream(arriving(batches, schema), BreakerRule(2, 30)), "t").filter("event_id <> 999")
    assert same_rows(told, breaker_timeline(spark.createDataFrame(rows, schema), BreakerRule(2, 30))) == 60
    schema = "request_id long, ts timestamp, pos int, expected int, result string"
    rows = [(None, T0, 0, 2, "a"), (7, T0, 0, 1, "b"), (None, T0, None, 2, "c"), (8, T0, 0, None, "d")]
    told = written(fan_in_stream(arriving([rows], schema), 600), "t")
    assert sorted(map(repr, map(tuple, told.collect()))) == sorted(map(repr, [(None, ["c", "a"], True, 0), (7, ["b"], True, 0)]))


def test_rows_across_batches_are_reordered(spark, arriving):
    """A row that comes a batch late, yet within the delay, is folded in its place."""
    schema = "key string, ts timestamp, event_id long, ok boolean"
    first = ("k", T0, 0, False)
    late = ("k", T0 + timedelta(seconds=10), 1, False)
    after = ("k", T0 + timedelta(seconds=20), 2, True)
    batches = [[first, after], [late], [("end", FAR, 9, True)]]
    rule = BreakerRule(2, 999)
    told = written(breaker_stream(arriving(batches, schema), rule), "t").filter("key <> 'end'")
    got = {r.event_id: (r.admitted, r.state) for r in told.collect()}
    assert got == {0: (True, "closed"), 1: (True, "open"), 2: (False, "open")}


def test_ttl_stream_equals_batch(spark, arriving):
    rng = random.Random(5)
    rows = [(rng.choice("pqq"), 5, T0 + timedelta(seconds=4 * i), i) for i in range(150)]
    schema = "query string, num_results int, ts timestamp, lookup_id long"
    batches = in_batches(rows, 3, rng) + [[("end", 5, FAR, 999)]]
    told = written(ttl_stream(arriving(batches, schema), 25), "t").filter("query <> 'end'")
    assert same_rows(told, ttl_lookups(spark.createDataFrame(rows, schema), 25)) == 150


def test_rate_stream_equals_batch(spark, arriving):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), T0 + timedelta(seconds=i), str(i)) for i in range(200)]
    schema = "client string, ts timestamp, request_key string"
    batches = in_batches(rows, 3, rng) + [[("end", FAR, "x")]]
    told = written(rate_limit_stream(arriving(batches, schema)), "t").filter("client <> 'end'")
    assert same_rows(told, window_counts(spark.createDataFrame(rows, schema))) > 4


def test_fan_in(spark, arriving):
    schema = "request_id string, ts timestamp, pos int, expected int, result string"

    def row(request, seconds, pos, expected, result):
        return (request, T0 + timedelta(seconds=seconds), pos, expected, result)

    batches = [
        [row("whole", 0, 2, 3, "c"), row("whole", 1, 0, 3, "a"), row("part", 0, 1, 2, "z")],
        [row("whole", 30, 1, 3, "b"), row("whole", 30, 1, 3, "b")],
        [("end", FAR, 0, 1, "x")],
    ]
    told = written(fan_in_stream(arriving(batches, schema)), "t").filter("request_id <> 'end'")
    assert {(r.request_id, tuple(r.results), r.complete) for r in told.collect()} == {
        ("whole", ("a", "b", "c"), True), ("part", ("z",), False),
    }


def test_fan_in_without_slots(spark, arriving):
    """Six results, of which one failed: all keep their place, and the request is complete."""
    schema = "request_id string, ts timestamp, pos int, expected int, result string"
    rows = [("r", T0 + timedelta(seconds=i), p, 6, None if p == 4 else f"x{p}") for i, p in enumerate([5, 3, 4, 0, 2, 1])]
    rows += [("short", T0, 7, 2, "late place")]
    told = written(fan_in_stream(arriving([rows[:3], rows[3:], [("end", FAR, 0, 1, "x")]], schema)), "t")
    got = {r.request_id: (r.results, r.complete) for r in told.filter("request_id <> 'end'").collect()}
    assert got == {"r": (["x0", "x1", "x2", "x3", None, "x5"], True), "short": (["late place"], False)}


def test_job_status_upsert(spark, arriving, tmp_path):
    schema = "job_id string, status string, ts timestamp, seq long"
    rows = [
        (f"j{i % 5}", status, T0 + timedelta(seconds=i), i)
        for i, status in enumerate(["queued", "running", "done"] * 10)
    ]
    stream = arriving(in_batches(rows, 3, random.Random(1)), schema)
    path = str(tmp_path / "jobs")
    upsert_job_status(stream, path, str(tmp_path / "checkpoint")).awaitTermination()
    # Started again on the same files, nothing is added.
    upsert_job_status(stream, path, str(tmp_path / "checkpoint")).awaitTermination()
    assert same_rows(job_status_table(spark, path), latest_status(spark.createDataFrame(rows, schema))) == 5


def test_job_status_bases(spark, arriving, tmp_path):
    """Many micro-batches, a base after every third: the reader needs the newest base and what follows it."""
    schema = "job_id string, status string, ts timestamp, seq long"
    rows = [(f"j{i % 4}", f"s{i}", T0 + timedelta(seconds=i), i) for i in range(24)]
    stream = arriving([rows[i : i + 3] for i in range(0, 24, 3)], schema)
    path = str(tmp_path / "jobs")
    upsert_job_status(stream, path, str(tmp_path / "checkpoint"), every=3).awaitTermination()
    assert {r.base for r in spark.read.parquet(f"{path}/bases").select("base").distinct().collect()} == {2, 5}
    assert same_rows(job_status_table(spark, path), latest_status(spark.createDataFrame(rows, schema))) == 4


def test_idle_keys_leave_the_state_and_come_back(spark, arriving):
    """Keys that fall silent, and return much later, give the rows of the batch form."""
    schema = "query string, num_results int, ts timestamp, lookup_id long"
    rows = [("q", 5, T0 + timedelta(seconds=s), i) for i, s in enumerate([0, 10, 30, 900, 905, 2000])]
    batches = [[r] for r in rows] + [[("end", 5, FAR, 99)]]
    told = written(ttl_stream(arriving(batches, schema), 25), "t").filter("query <> 'end'")
    assert same_rows(told, ttl_lookups(spark.createDataFrame(rows, schema), 25)) == 6
    schema = "key string, ts timestamp, event_id long, ok boolean"
    calls = [("k", T0 + timedelta(seconds=s), i, ok) for i, (s, ok) in enumerate([(0, True), (600, False), (1300, False), (1301, True), (2500, True), (2600, True)])]
    rule = BreakerRule(2, 30)
    told = written(breaker_stream(arriving([[c] for c in calls] + [[("end", FAR, 9, True)]], schema), rule), "t")
    assert same_rows(told.filter("key <> 'end'"), breaker_timeline(spark.createDataFrame(calls, schema), rule)) == 6


THREADS = (
    "thread_id string, step long, user_input string, completed_agents array<string>, agent_outputs map<string,string>, "
    "errors array<string>, step_count int, next_agent string"
)


def thread_updates(rng, count):
    """Updates of three threads, a null one among them, with equal and null steps."""
    agents = ["research", "finance", "document"]
    rows = []
    for i in range(count):
        step = None if rng.random() < 0.1 else i // 2
        rows.append(
            (
                rng.choice(["t", "u", None]), step, f"q{i}" if rng.random() < 0.2 else None,
                rng.sample(agents, rng.randint(0, 2)) or None, {rng.choice(agents): f"o{i}"} if rng.random() < 0.5 else None,
                [f"e{rng.randint(0, 3)}" for _ in range(rng.randint(0, 2))] or None, i, rng.choice([None, "finance"]),
            )
        )
    return rows


@pytest.mark.parametrize("mode", ["overwrite", "accumulate"])
def test_thread_state_upsert(spark, arriving, tmp_path, mode):
    """Six micro-batches, bases among them; started again, nothing changes."""
    # One update of a thread and step: which of two is newer is told for errors alone.
    rows = list({(r[0], r[1]): r for r in thread_updates(random.Random(4), 60)}.values())
    stream = arriving(in_batches(rows, 6, random.Random(2)), THREADS)
    path = str(tmp_path / "threads")
    for _ in range(2):
        upsert_thread_state(stream, path, str(tmp_path / "checkpoint"), mode, every=2).awaitTermination()
        expect = thread_state(spark.createDataFrame(rows, THREADS), mode)
        assert same_rows(thread_state_table(spark, path), expect) == 3


def test_thread_state_upsert_keeps_errors_of_one_step(spark, arriving, tmp_path):
    schema = "thread_id string, step long, errors array<string>"
    rows = [("t", 1, ["e1"]), ("t", 1, ["e2"]), ("t", None, ["x"]), ("t", None, ["y"]), ("t", None, ["x"]), ("u", 3, None)]
    stream = arriving([rows[:1], rows[1:4], rows[4:]], schema)
    path = str(tmp_path / "threads")
    upsert_thread_state(stream, path, str(tmp_path / "checkpoint")).awaitTermination()
    told = {r.thread_id: r.errors for r in thread_state_table(spark, path).collect()}
    assert told == {"t": ["x", "x", "y", "e1", "e2"], "u": []}
    assert same_rows(thread_state_table(spark, path), thread_state(spark.createDataFrame(rows, schema))) == 2


def test_an_update_writes_only_what_it_tells(spark, arriving, tmp_path):
    """A long thread's later batches write rows for what changes, not for what the thread holds."""
    schema = "thread_id string, step long, errors array<string>"
    rows = [("t", i, [f"e{i}"]) for i in range(300)]
    path = str(tmp_path / "threads")
    upsert_thread_state(arriving([rows[:298], rows[298:]], schema), path, str(tmp_path / "checkpoint")).awaitTermination()
    written_rows = {r.batch: r["count"] for r in spark.read.parquet(f"{path}/deltas").groupBy("batch").count().collect()}
    assert written_rows == {0: 299, 1: 3}  # errors, and the thread's own row
    assert len(thread_state_table(spark, path).first().errors) == 300


def test_fan_in_tells_at_completeness(spark, arriving):
    """A whole request is told in the batch of its last place, with no watermark; late results are counted."""
    schema = "request_id string, ts timestamp, pos int, expected int, result string"

    def row(request, seconds, pos, expected, result):
        return (request, T0 + timedelta(seconds=seconds), pos, expected, result)

    batches = [
        [row("a", 0, 1, 2, "y"), row("b", 0, 0, 2, "p"), row("n", 0, 0, None, "alone")],
        [row("a", 5, 0, 2, "x")],
        [row("a", 6, 0, 2, "x"), row("a", 7, 1, 2, "other"), row("a", 8, 2, 2, "more"), row("a", 5_000, 0, 2, "again")],
    ]
    told = written(fan_in_stream(arriving(batches, schema), 600), "t")
    first = told.select("request_id", "results", "complete", "late").collect()
    # The last batch moved the watermark beyond b's wait, and a's first round had ended before its fourth row.
    assert sorted(map(repr, map(tuple, first))) == sorted(
        map(repr, [("a", ["x", "y"], True, 0), ("a", [], None, 2), ("b", ["p"], False, 0), ("n", ["alone"], False, 0)])
    )
    drained = written(fan_in_stream(arriving([*batches, [("end", FAR, 0, 1, "z")]], schema), 600), "t")
    got = [tuple(r) for r in drained.filter("request_id = 'a' and late = 0").orderBy("complete").collect()]
    assert got == [("a", ["again"], False, 0), ("a", ["x", "y"], True, 0)]


def test_late_rows_are_left_out(spark, arriving):
    schema = "client string, ts timestamp, request_key string"
    batches = [
        [("c", T0 + timedelta(minutes=9), "1")], [("c", T0 + timedelta(minutes=30), "2")],
        [("c", T0, "late")], [("end", FAR, "x")],
    ]
    told = written(rate_limit_stream(arriving(batches, schema)), "t").filter("client <> 'end'")
    assert sorted(r.window_start.minute for r in told.select(F.col("window_start")).collect()) == [9, 30]


@pytest.mark.parametrize("limit", [0, 3])
def test_admission_stream_equals_batch(spark, arriving, limit):
    rng = random.Random(9)
    # Two in three rows are one client's; times and numbers do not agree in order; clients and requests may be null.
    numbers = rng.sample(range(2**53, 2**53 + 500), 150)
    rows = [
        (rng.choice([1, 1, 1, 1, 2, None]), T0 + timedelta(seconds=i // 2), None if i == 70 else numbers[i]) for i in range(150)
    ]
    schema = "client long, ts timestamp, request_key long"
    batches = in_batches(rows, 3, rng) + [[(99, FAR, -1)]]
    told = written(admit_stream(arriving(batches, schema), limit, "20 seconds"), "t").filter("client is null or client <> 99")
    assert same_rows(told, admit(spark.createDataFrame(rows, schema), limit, "20 seconds")) == 150


def test_admission_of_text_keys_and_late_first_requests(spark, arriving):
    schema = "client string, ts timestamp, request_key string"
    second = [("c", T0 + timedelta(seconds=s), f"r{s}") for s in (30, 20)]
    earlier = [("c", T0 + timedelta(seconds=10), "r10"), (None, T0, "é")]
    batches = [second, earlier, [("end", FAR, "x")]]
    told = written(admit_stream(arriving(batches, schema), 2), "t").filter("client is null or client <> 'end'")
    assert {r.request_key: r.admitted for r in told.collect()} == {"r10": True, "r20": True, "r30": False, "é": True}


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_is_read_as_a_file_or_a_folder_of_files(spark, tmp_path, files):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(60)], "conv_id long, text string")
    rows.repartition(files).write.parquet(str(tmp_path / "conversations.parquet"))
    rows.limit(1).write.parquet(str(tmp_path / "other.parquet"))
    if files == 1:
        (file,) = (tmp_path / "conversations.parquet").glob("part-*.parquet")
        (tmp_path / "sf").mkdir()
        os.link(file, tmp_path / "sf" / "conversations.parquet")
    sf = str(tmp_path / "sf" if files == 1 else tmp_path)
    assert same_rows(written(_arriving(spark, sf, "conversations"), "t"), rows) == 60


@pytest.mark.parametrize("buckets", [1, 7])
def test_streams_with_many_keys_to_a_bucket_equal_batch(spark, arriving, buckets):
    """40 keys share few groups of state, across batches; one id is unknown, others need all their digits."""
    rng = random.Random(12)
    ids = rng.sample(range(2**60, 2**60 + 999), 200)
    schema = "query long, num_results int, ts timestamp, lookup_id long"
    rows = [(rng.randrange(40), 5, T0 + timedelta(seconds=4 * i), None if i == 9 else ids[i]) for i in range(200)]
    stream = arriving(in_batches(rows, 4, rng) + [[(-1, 5, FAR, -1)]], schema)
    told = written(ttl_stream(stream, 300, buckets=buckets), "t").filter("query >= 0")
    assert same_rows(told, ttl_lookups(spark.createDataFrame(rows, schema), 300)) == 200
    schema = "client long, ts timestamp, request_key long"
    rows = [(q, ts, i) for q, _, ts, i in rows]
    stream = arriving(in_batches(rows, 4, rng) + [[(-1, FAR, -1)]], schema)
    told = written(admit_stream(stream, 2, "5 minutes", buckets=buckets), "t").filter("client >= 0")
    assert same_rows(told, admit(spark.createDataFrame(rows, schema), 2, "5 minutes")) == 200
    schema = "request_id long, ts timestamp, pos int, expected int, result string"
    rows = [(i, T0 + timedelta(seconds=10 * p + i), p, 3, f"{i}/{p}") for i in range(30) for p in range(3 if i % 4 else 2)]
    rng.shuffle(rows)
    told = written(fan_in_stream(arriving([rows[:40], rows[40:], [(-1, FAR, 0, 1, "x")]], schema), buckets=buckets), "t")
    got = {(r.request_id, tuple(r.results), r.complete) for r in told.filter("request_id >= 0").collect()}
    assert got == {(i, tuple(f"{i}/{p}" for p in range(3 if i % 4 else 2)), i % 4 > 0) for i in range(30)}
