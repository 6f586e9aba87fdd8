import numpy as np
import pytest

from sparkbrief.llm import metric_join
from sparkbrief.llm.metric_join import near_vectors


def slow(rows, least=0.9):
    def unit(v):
        if not v or any(x is None for x in v):
            return None
        a = np.array(v, dtype=float)
        return a / np.linalg.norm(a) if np.isfinite(a).all() and a.any() else None

    units = [unit(v) for _, v in rows]
    near = [[j for j, b in enumerate(units) if j != i and a is not None and b is not None and len(a) == len(b) and a @ b >= least] for i, a in enumerate(units)]
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((vec_id, len(near[i]), component, vec_id is not None and vec_id == component))
    return sorted(map(repr, out))


def found(df, **options):
    return sorted(map(repr, map(tuple, near_vectors(df, **options).collect())))


def clusters(seed, count=300, dim=8):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(9, dim))
    rows = centres[draw.integers(0, 9, count)] + draw.normal(size=(count, dim)) * draw.choice([0.05, 0.3, 1.0], size=(count, 1))
    rows[draw.integers(0, count, 30)] = rows[0]
    return [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(rows.tolist())]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize(("cell", "block", "stream"), [(10, 7, 5), (64, 2048, 4096), (10**6, 50, 33)])
def test_against_brute_force(spark, monkeypatch, seed, cell, block, stream):
    monkeypatch.setattr(metric_join, "BLOCK", block)
    monkeypatch.setattr(metric_join, "STREAM", stream)
    rows = clusters(seed)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    assert found(df, cell=cell) == slow(rows)


def test_odd_vectors(spark):
    big, tiny = 3e38, 1e-38
    rows = [
        (5, [1.0, 0.0]), (4, [2.0, 0.1]), (4, [2.0, 0.1]), (None, [1.0, 0.01]), (None, None), (1, None), (2, []),
        (3, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]),
        (10, [big, big]), (11, [tiny, tiny]), (12, [-0.0, 1.0]), (13, [0.0, 1.0]), (14, [-1.0, 0.0]),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, component_id string")
    assert found(df) == slow([(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows])


def test_given_table(spark, folder):
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    assert found(df) == slow([(r["vec_id"], list(r["embedding"])) for r in df.collect()])


def test_empty(spark):
    assert found(spark.createDataFrame([], "vec_id long, embedding array<float>")) == []
