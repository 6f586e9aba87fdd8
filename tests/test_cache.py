import random
from datetime import datetime, timedelta

import pytest

from sparkbrief.operators.cache import serve_from_cache, ttl_lookups, with_fresh_results

T0 = datetime(2024, 1, 1)


def lookups_of(spark, rows):
    return spark.createDataFrame(
        [(q, 5, T0 + timedelta(seconds=s), i) for i, (q, s) in enumerate(rows)],
        "query string, num_results int, ts timestamp, lookup_id long",
    )


def hits(frame):
    return [r.hit for r in frame.orderBy("lookup_id").collect()]


@pytest.mark.parametrize("hot_rows", [100, 1])
def test_life_runs_from_storing(spark, hot_rows):
    rows = [("q", 0), ("q", 299), ("q", 300), ("q", 599), ("q", 600), ("other", 10)]
    assert hits(ttl_lookups(lookups_of(spark, rows), 300, hot_rows)) == [
        False, True, False, True, False, False,
    ]


@pytest.mark.parametrize("seed,step", [(1, [0, 1, 2]), (2, [3]), (3, [0, 50, 200])])
def test_hot_keys_give_the_same_rows(spark, seed, step):
    rng = random.Random(seed)
    at, rows, stored, expect = 0, [], {}, []
    for _ in range(400):
        at += rng.choice(step)
        rows.append((f"q{min(rng.randrange(6), 3)}", at))
    for query, second in rows:
        hit = query in stored and second - stored[query] < 17
        if not hit:
            stored[query] = second
        expect.append((hit, T0 + timedelta(seconds=stored[query])))
    frame = lookups_of(spark, rows)
    for hot_rows in (10_000, 50):
        got = ttl_lookups(frame, 17, hot_rows).orderBy("lookup_id").collect()
        assert [(r.hit, r.stored_at) for r in got] == expect


def test_serving_and_refilling(spark):
    entries = spark.createDataFrame(
        [("q", 5, T0, 1, ["old"]), ("q", 5, T0 + timedelta(seconds=100), 2, []),
         ("q", 3, T0, 3, ["three"])],
        "query string, num_results int, ts timestamp, entry_id long, results array<string>",
    )
    asked = spark.createDataFrame(
        [("a", "q", 5, T0 + timedelta(seconds=99)), ("b", "q", 5, T0 + timedelta(seconds=399)),
         ("c", "q", 5, T0 + timedelta(seconds=400)), ("d", "none", 5, T0)],
        "request_id string, query string, num_results int, ts timestamp",
    )
    for hot_rows in (100, 2):
        served = serve_from_cache(asked, entries, 300, hot_rows)
        got = {r.request_id: (r.hit, r.results) for r in served.collect()}
        assert got == {"a": (True, ["old"]), "b": (True, []), "c": (False, None), "d": (False, None)}
    fresh = spark.createDataFrame([("c", ["new"]), ("d", ["x"])], "request_id string, results array<string>")
    both = {r.request_id: (r.results, r.cached) for r in with_fresh_results(served, fresh).collect()}
    assert both == {"a": (["old"], True), "b": ([], True), "c": (["new"], False), "d": (["x"], False)}
