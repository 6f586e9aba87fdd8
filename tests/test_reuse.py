import random
from collections import OrderedDict
from datetime import datetime, timedelta

import numpy as np
import pytest

from sparkbrief.operators.reuse import lru_lookups, reuse_distances, smaller_before

T0 = datetime(2024, 1, 1)
SCHEMA = "query string, num_results int, ts timestamp, lookup_id long"


def simulated(keys, capacity):
    held, hits = OrderedDict(), []
    for key in keys:
        hits.append(key in held)
        held[key] = True
        held.move_to_end(key)
        if len(held) > capacity:
            held.popitem(last=False)
    return hits


def distances(keys):
    last, out = {}, []
    for i, key in enumerate(keys):
        out.append(len(set(keys[last[key] + 1 : i])) if key in last else None)
        last[key] = i
    return out


@pytest.mark.parametrize("size", [0, 1, 2, 3, 64, 65, 777])
def test_smaller_before(size):
    values = np.random.default_rng(size).integers(-1, 40, size)
    expect = [int((values[:i] < values[i]).sum()) for i in range(size)]
    assert smaller_before(values).tolist() == expect


@pytest.mark.parametrize("hot_rows,block", [(10_000, 1 << 18), (50, 1)])
def test_hits_of_a_simulated_cache(spark, hot_rows, block):
    rng = random.Random(7)
    # A third of the lookups ask one key; one key is null; several lookups share a time.
    keys = [("hot", 5) if rng.random() < 0.33 else (rng.choice(["a", "b", "c", None]), rng.randrange(60)) for _ in range(900)]
    rows = [(*k, T0 + timedelta(seconds=i // 3), i) for i, k in enumerate(keys)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = reuse_distances(frame, hot_rows, block).orderBy("lookup_id").collect()
    assert [r.distance for r in got] == distances(keys)
    for capacity in (1, 30, 128):
        told = lru_lookups(frame, capacity, hot_rows, block).orderBy("lookup_id").collect()
        assert [r.hit for r in told] == simulated(keys, capacity)


def test_no_lookups(spark):
    told = lru_lookups(spark.createDataFrame([], SCHEMA))
    assert told.columns == ["query", "num_results", "ts", "lookup_id", "distance", "hit"] and told.isEmpty()
