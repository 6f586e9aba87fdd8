import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkbrief.llm.kernel_quality import (
    FEATURES,
    STATISTICS,
    Kernel,
    _solve,
    isotonic,
    quality_scores,
    statistics,
    summed,
)
from tests.llm.conftest import plain

LABELS = "doc_id long, quality int, toxic int"


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return docs, labels, {r.doc_id: r for r in quality_scores(docs, labels).collect()}


def test_rows_and_folds(scored):
    docs, _, found = scored
    assert len(found) == docs.count()
    assert all(r.held_out == (fold(d) == 0) and 0 <= r.score <= 1 for d, r in found.items())
    assert all(r.predicted == (r.score >= 0.3) for r in found.values())


def test_held_out_rows_are_told_apart(scored):
    _, labels, found = scored
    rows = [(found[r.doc_id], r.quality) for r in labels.collect() if found[r.doc_id].held_out]
    good = [r.score for r, q in rows if q == 1]
    bad = [r.score for r, q in rows if q == 0]
    assert len(good) > 20 and len(bad) > 3
    above = np.mean([[g > b or 0.5 * (g == b) for b in bad] for g in good])
    assert above > 0.97
    assert np.mean([r.predicted == q for r, q in rows]) > 0.95


def test_inputs_that_may_not_count(scored, spark):
    """Held-out labels, lang, source and order of rows change nothing."""
    docs, labels, found = scored
    turned = labels.withColumn(
        "quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string"), "n_chars": F.lit(0)})
    again = quality_scores(other, turned).collect()
    assert max(abs(r.score - found[r.doc_id].score) for r in again) < 1e-9


def test_sums_equal_numpy(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(size=(500, 3))
    df = spark.createDataFrame([(v.tobytes(),) for v in values], "v binary").repartition(7)

    def make(batch):
        x = np.frombuffer(b"".join(batch.column("v").to_pylist())).reshape(-1, 3)
        return {0: x.T @ x, 5: x.sum(0)}

    found = summed(df, make)
    assert np.allclose(found[0].reshape(3, 3), values.T @ values) and np.allclose(found[5], values.sum(0))


def test_fit_equals_one_machine(scored, spark):
    """Ridge on the same features, all rows at once: scores keep its order outside the steps."""
    docs, labels, found = scored
    given = {r.doc_id: r.quality for r in labels.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(i for i in given if fold(i))
    x = np.array([statistics(texts[i].encode()) for i in ids])
    kernel = Kernel(x.mean(0), x.std(0))
    z = kernel.features(x)
    y = np.array([given[i] for i in ids], float)
    best = None
    for penalty in (1e-5, 1e-4, 1e-3, 1e-2, 1e-1):
        lost = 0.0
        for f in range(1, 5):
            out = np.array([fold(i) == f for i in ids])
            w = _solve(z[~out].T @ z[~out], z[~out].T @ y[~out], (~out).sum(), penalty)
            lost += ((z[out] @ w - y[out]) ** 2).sum()
        if best is None or lost < best[0]:
            best = (lost, penalty)
    w = _solve(z.T @ z, z.T @ y, len(y), best[1])
    raw = {i: float((kernel.features(np.array([statistics(texts[i].encode())])) @ w)[0]) for i in texts}
    order = sorted(raw, key=raw.get)
    scores = [found[i].score for i in order]
    assert all(a <= b + 1e-6 for a, b in zip(scores, scores[1:], strict=False))


def test_kernel_is_nearly_gaussian():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, STATISTICS))
    z = Kernel(np.zeros(STATISTICS), np.ones(STATISTICS), 20_000).features(x)[:, :-1]
    apart = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-apart / (4 * STATISTICS))).max() < 0.05
    assert FEATURES >= 128


@pytest.mark.parametrize("seed", range(10))
def test_isotonic(seed):
    rng = random.Random(seed)
    at = np.array(sorted(rng.sample(range(1000), 30)), float)
    mean = np.array([rng.choice([0, 0.5, 1]) for _ in at])
    weight = np.array([rng.randint(1, 5) for _ in at], float)
    places, levels = isotonic(at, mean, weight)
    assert (np.diff(levels) > 0).all() and (np.diff(places) > 0).all()
    # The greatest of least averages: the defining formula.
    for i in range(len(at)):
        low = max(
            min(np.average(mean[a : b + 1], weights=weight[a : b + 1]) for b in range(i, len(at))) for a in range(i + 1)
        )
        assert np.isclose(levels, low).any()


def test_odd_rows(spark, messy, messy_rows):
    labels = spark.createDataFrame(
        [(r[0], i % 2, None) for i, r in enumerate(messy_rows)] + [(0, 7, 0), (1, None, 1), (5, 0, 0), (5, 1, 0), (None, 1, 1)], LABELS
    )
    found = plain(quality_scores(messy, labels))
    assert len(found) == len(messy_rows)
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in messy_rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    assert not any(r["held_out"] for r in found if r["doc_id"] is None)
    assert statistics(b"") == statistics(b" \n") == [0.0] * STATISTICS
    one = {r["score"] for r in found if r["doc_id"] in (2, 3)}
    assert len(one) == 1  # null and empty texts are alike


def test_without_labels(spark, messy, empty):
    none = spark.createDataFrame([], LABELS)
    assert {(r["score"], r["predicted"]) for r in plain(quality_scores(messy, none))} == {(0.5, 1)}
    only = spark.createDataFrame([(i, 0, 0) for i in range(20)], LABELS)
    assert {r["score"] for r in plain(quality_scores(messy, only))} == {0.0}
    assert plain(quality_scores(empty, only)) == []
    assert quality_scores(empty, none).columns == ["doc_id", "held_out", "score", "predicted"]
