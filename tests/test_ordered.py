import random

import pytest
from pyspark.sql import functions as F

from sparkbrief.operators import ordered
from sparkbrief.operators.ordered import RUN, cut_runs, scan, scan_runs


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("backward", [True, False])
def test_scan_equals_plain_loop(spark, inclusive, backward):
    rng = random.Random(5)
    rows = [
        (rng.choice(["hot", "hot", "a", None]), i, rng.choice([None, i]), rng.randrange(3))
        for i in range(300)
    ]
    expect, seen, sums = {}, {}, {}
    for key, i, value, add in reversed(rows) if backward else rows:
        if inclusive:
            seen[key] = value if value is not None else seen.get(key)
            sums[key] = sums.get(key, 0) + add
        expect[i] = (seen.get(key), sums.get(key, 0))
        if not inclusive:
            seen[key] = value if value is not None else seen.get(key)
            sums[key] = sums.get(key, 0) + add
    df = spark.createDataFrame(rows, "key string, i int, value int, add int").repartition(5)
    for hot_rows in (1000, 20):
        got = scan(
            df, ["key"], ["i"], {"last_value": F.col("value")}, {"running": F.col("add")},
            inclusive=inclusive, backward=backward, hot_rows=hot_rows,
        ).collect()
        assert {r.i: (r.last_value, r.running) for r in got} == expect
        assert len(got) == len(rows)


@pytest.mark.parametrize("backward", [True, False])
def test_many_short_runs_need_few_parts(spark, monkeypatch, backward):
    """Runs of three rows within parts of about a hundred: a key crosses runs and parts."""
    monkeypatch.setattr(ordered, "PART_ROWS", 100)
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, None, i])) for i in range(500)]
    df = spark.createDataFrame(rows, "key string, i int, value int").repartition(7)
    runs = cut_runs(df, ["key"], ["i"], 500, 3)
    parts = runs.select(F.shiftright(RUN, 33).alias("part"), RUN, "key", "i")
    assert parts.select("part").distinct().count() <= 5
    assert parts.groupBy(RUN).count().filter("count > 3").isEmpty() and parts.select(RUN).distinct().count() >= 167
    told = sorted((r.key is not None, r.key or "", r.i, r[RUN]) for r in parts.collect())
    assert [t[-1] for t in told] == sorted(t[-1] for t in told)
    seen, expect = {}, {}
    for key, i, value in reversed(rows) if backward else rows:
        seen[key] = value if value is not None else seen.get(key)
        expect[i] = seen[key]
    got = scan_runs(runs, ["key"], ["i"], last={"found": F.col("value")}, total={"n": F.lit(1)}, backward=backward).collect()
    assert {r.i: r.found for r in got} == expect and len(got) == 500
