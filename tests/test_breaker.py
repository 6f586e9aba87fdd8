import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sparkbrief.operators.breaker import (
    START,
    BreakerRule,
    advance,
    breaker_timeline,
    guard_searches,
    search_loop,
    status_report,
)

T0 = datetime(2024, 1, 1)
SCHEMA = "key string, ts timestamp, event_id long, ok boolean"


def calls_of(spark, rows):
    return spark.createDataFrame(
        [(k, T0 + timedelta(seconds=s), i, ok) for i, (k, s, ok) in enumerate(rows)], SCHEMA
    )


def told(frame):
    rows = frame.select(
        "event_id", "admitted", "state", F.unix_micros("opened_at").alias("us")
    ).orderBy("event_id").collect()
    return [(r.event_id, r.admitted, r.state, r.us) for r in rows]


CASES = [
    (BreakerRule(3), [("t", 0, True)], [(True, "closed")]),
    (BreakerRule(3), [("t", i, False) for i in range(3)], [(True, "closed")] * 2 + [(True, "open")]),
    (BreakerRule(1, 999), [("t", 0, False), ("t", 1, True)], [(True, "open"), (False, "open")]),
    (
        BreakerRule(1, 0.05, 5, 2),
        [("t", 0, False), ("t", 0.06, True), ("t", 0.07, True)],
        [(True, "open"), (True, "half_open"), (True, "closed")],
    ),
    (
        BreakerRule(1, 0.05, 5, 2),
        [("t", 0, False), ("t", 0.06, False)],
        [(True, "open"), (True, "open")],
    ),
    (
        BreakerRule(1),
        [("a", 0, False), ("b", 1, True)],
        [(True, "open"), (True, "closed")],
    ),
    # Exactly at the recovery time the wait is over.
    (
        BreakerRule(1, 30, 3, 2),
        [("t", 0, False), ("t", 30, True)],
        [(True, "open"), (True, "half_open")],
    ),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_cases(spark, case):
    rule, rows, expect = CASES[case]
    got = told(breaker_timeline(calls_of(spark, rows), rule))
    assert [(a, s) for _, a, s, _ in got] == expect


def test_probe_cap_rejects_second_call(spark):
    with pytest.warns(UserWarning):
        rule = BreakerRule(1, 0.05, 1, 2)
    rows = [("t", 0, False), ("t", 0.06, True), ("t", 0.07, True), ("t", 99, True)]
    for hot_rows in (10, 2):
        got = told(breaker_timeline(calls_of(spark, rows), rule, hot_rows))
        assert [(a, s) for _, a, s, _ in got] == [
            (True, "open"), (True, "half_open"), (False, "half_open"), (False, "half_open"),
        ]


def test_rule_rejects_zero_wait():
    with pytest.raises(ValueError):
        BreakerRule(recovery_seconds=0)


def random_calls(seed, keys=4, n=400, fail=0.5):
    rng = random.Random(seed)
    at, rows = 0.0, []
    for _ in range(n):
        at += rng.choice([0, 0.5, 1, 3, 20])
        rows.append((f"k{min(rng.randrange(keys * 2), keys - 1)}", at, rng.random() > fail))
    return rows


def folded(rows, rule):
    held, out = {}, []
    for i, (key, at, ok) in enumerate(rows):
        us = int((T0.replace(tzinfo=timezone.utc) + timedelta(seconds=at)).timestamp() * 1_000_000)
        held[key], passed = advance(held.get(key, START), us, ok, rule)
        state = held[key]
        out.append((i, passed, state[0], state[4] if state[0] == "open" else None))
    return out


@pytest.mark.parametrize(
    "rule,fail",
    [
        (BreakerRule(2, 10, 3, 2), 0.5),
        (BreakerRule(3, 7.5, 2, 2), 0.8),
        (BreakerRule(1, 5, 3, 1), 0.3),
        (BreakerRule(2, 4, 3, 3), 1.0),
    ],
)
def test_hot_keys_give_the_same_rows(spark, rule, fail):
    rows = random_calls(7, fail=fail)
    expect = folded(rows, rule)
    calls = calls_of(spark, rows)
    for hot_rows in (10_000, 60):
        assert told(breaker_timeline(calls, rule, hot_rows)) == expect


def test_stuck_half_open_on_hot_key(spark):
    with pytest.warns(UserWarning):
        rule = BreakerRule(2, 5, 1, 2)
    rows = random_calls(3, n=200, fail=0.6)
    assert told(breaker_timeline(calls_of(spark, rows), rule, 20)) == folded(rows, rule)


def test_partition_count_does_not_matter(spark):
    rows = random_calls(11)
    rule = BreakerRule(2, 10, 3, 2)
    expect = folded(rows, rule)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 32):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert told(breaker_timeline(calls_of(spark, rows).repartition(n), rule)) == expect
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_status_report_and_guard(spark):
    rule = BreakerRule(1, 30)
    line = breaker_timeline(calls_of(spark, [("a", 0, False), ("b", 0, True)]), rule)

    def report(seconds):
        at = F.lit(T0 + timedelta(seconds=seconds))
        return {r.key: r.state for r in status_report(line, at, rule).collect()}

    assert report(10) == {"a": "open", "b": "closed"}
    assert report(30) == {"a": "half_open", "b": "closed"}
    names = spark.createDataFrame([("a",), ("tool_a",), ("tool_a",)], "key string")
    full = status_report(line, F.lit(T0), rule, names)
    assert {r.key: r.state for r in full.collect()} == {"a": "open", "b": "closed", "tool_a": "closed"}
    asked = spark.createDataFrame(
        [("r1", "a", T0 + timedelta(seconds=10)), ("r2", "a", T0 + timedelta(seconds=31)),
         ("r3", "new", T0), ("r4", "a", T0 - timedelta(seconds=1))],
        "request_id string, key string, ts timestamp",
    )
    met = {r.request_id: (r.state, r.error) for r in guard_searches(asked, line, rule).collect()}
    assert met == {
        "r1": ("open", "CircuitBreaker OPEN"),
        "r2": ("half_open", None),
        "r3": ("closed", None),
        "r4": ("closed", None),
    }


class _Guard:
    """One breaker as a service would hold it: a search asks it, runs, and reports."""

    def __init__(self, rule):
        self.rule, self.state, self.failures, self.successes, self.probes, self.last = rule, "closed", 0, 0, 0, 0.0

    def read(self, now):
        if self.state == "open" and now - self.last >= self.rule.recovery_seconds:
            self.state, self.probes, self.successes = "half_open", 0, 0
        return self.state

    def report(self, now, ok):
        """False if the outcome is not let in."""
        if self.read(now) == "half_open":
            if self.probes >= self.rule.half_open_max_calls:
                return False
            self.probes += 1
        if ok and self.state == "half_open":
            self.successes += 1
            if self.successes >= self.rule.success_threshold:
                self.state, self.failures, self.probes, self.successes = "closed", 0, 0, 0
        elif ok:
            self.failures = 0
        else:
            self.failures += 1
            self.last = now
            if self.state == "half_open" or self.failures >= self.rule.failure_threshold:
                self.state, self.probes, self.successes = "open", 0, 0
        return True

    def search(self, key, now, ok, error):
        if self.read(now) == "open":
            return "refused", "CircuitBreaker OPEN"
        if not ok:
            self.report(now, False)
            return "failed", error
        if not self.report(now, True):
            return "lost", f"breaker[{key}] HALF_OPEN（試探中），已達上限"
        return "found", None


@pytest.mark.parametrize("rule", [BreakerRule(2, 30, 3, 2), BreakerRule(3, 20, 1, 3), BreakerRule(1, 15, 2, 2)])
@pytest.mark.parametrize("hot_rows", [5_000_000, 20])
@pytest.mark.filterwarnings("ignore:too few probes")
def test_search_loop_equals_one_breaker_at_a_time(spark, rule, hot_rows):
    rng = random.Random(6)
    rows, at = [], 0
    for i in range(400):
        at += rng.choice([0, 1, 5, 12])
        ok = rng.choice([True, True, False, None])
        rows.append((rng.choice(["k", "k", "k", "q", None]), T0 + timedelta(seconds=at), i, ok, None if ok else f"err {i}", f"x{i}"))
    frame = spark.createDataFrame(rows, "key string, ts timestamp, event_id long, ok boolean, error string, state string")
    guards, expect = {}, {}
    for key, ts, i, ok, error, _ in rows:
        guard = guards.setdefault(key, _Guard(rule))
        told = guard.search(key or "", (ts - T0).total_seconds(), bool(ok), error)
        expect[i] = (*told, guard.state)
    found = {r.event_id: (r.outcome, r.error, r.state) for r in search_loop(frame, rule, hot_rows, 15).collect()}
    assert found == expect
    assert {"refused", "failed", "found"} <= {o for o, _, _ in expect.values()}
    if rule.half_open_max_calls < rule.success_threshold:
        assert "lost" in {o for o, _, _ in expect.values()}
