import random

import pytest
from pyspark.sql import functions as F

from sparkbrief.operators import search_index as module
from sparkbrief.operators.ordered import numbered
from sparkbrief.operators.search import ranked_hits, search_topk
from sparkbrief.operators.search_index import extend_index, search_index

CORPUS = "doc_id long, body string"


def words(rng, count, spread=40):
    return " ".join(f"w{min(int(rng.expovariate(0.15)), spread)}" for _ in range(count))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    made = [(i, words(rng, rng.randint(0, 60))) for i in range(900)]
    return made + [(900, None), (901, ""), (902, "rare thing"), (903, "rare " * 50), (904, "rare thing")]


@pytest.fixture(scope="module")
def queries(spark):
    rng = random.Random(9)
    asked = [words(rng, rng.randint(1, 6)) for _ in range(40)] + ["rare thing", "nowhere", "", "w0 w1 rare", "w0 w0"]
    return spark.createDataFrame([(q,) for q in asked], "query string")


def same(ours, theirs):
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, theirs.collect()))


def test_hits_equal_a_search_of_the_documents(spark, rows, queries, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 8)
    path = str(tmp_path / "index")
    expect = search_topk(queries, spark.createDataFrame(rows, CORPUS))
    assert expect.count() > 100
    for n, part in enumerate((rows[:300], rows[300:301], rows[301:])):
        assert extend_index(spark.createDataFrame(part, CORPUS), path, buckets=5) == n
    same(search_index(spark, queries, path), expect)
    same(search_index(spark, queries, path, 2), search_topk(queries, spark.createDataFrame(rows, CORPUS), 2))


def test_each_delta_counts_at_once(spark, rows, queries, tmp_path):
    """After each delta the hits are those of the documents so far: weights follow the new average length."""
    path = str(tmp_path / "index")
    for end in (200, 400):
        extend_index(spark.createDataFrame(rows[end - 200 : end], CORPUS), path)
        same(search_index(spark, queries, path), search_topk(queries, spark.createDataFrame(rows[:end], CORPUS)))


def test_what_a_lost_writer_left_is_not_read(spark, rows, queries, tmp_path):
    path = str(tmp_path / "index")
    extend_index(spark.createDataFrame(rows[:200], CORPUS), path)
    # A delta whose counts were never written.
    left = spark.read.parquet(f"{path}/blocks/delta=0")
    left.write.partitionBy("bucket").parquet(f"{path}/blocks/delta=1")
    same(search_index(spark, queries, path), search_topk(queries, spark.createDataFrame(rows[:200], CORPUS)))
    assert extend_index(spark.createDataFrame(rows[200:], CORPUS), path) == 1
    same(search_index(spark, queries, path), search_topk(queries, spark.createDataFrame(rows, CORPUS)))


def test_blocks_are_small_and_bound_their_postings(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 8)
    path = str(tmp_path / "index")
    extend_index(spark.createDataFrame(rows, CORPUS), path)
    blocks = spark.read.parquet(f"{path}/blocks").collect()
    assert max(len(b["rows"]) for b in blocks) < 40
    assert all(b.documents == len(b["rows"]) for b in blocks)
    assert all(p.tf <= b.most_tf and p.length >= b.least_length for b in blocks for p in b["rows"])
    assert len({(b.bucket, b.term) for b in blocks}) == len({b.term for b in blocks})


def test_weak_blocks_are_skipped(spark, tmp_path, monkeypatch):
    """Documents that hold a word once among many others are not met by a search that shorter ones win."""
    rows = [(i, "apple pear") for i in range(6)] + [(i, "apple pear " + "x " * 2_000) for i in range(6, 400)]
    path = str(tmp_path / "index")
    extend_index(spark.createDataFrame(rows, CORPUS), path)
    queries = spark.createDataFrame([("apple pear",)], "query string")
    seen = []

    def spy(queries, read, kind, k):
        def reading(vocabulary):
            postings, blocks, documents, count = read(vocabulary)
            tagged = blocks.withColumn("rows", F.col("rows"))
            seen.append((blocks.agg(F.sum(F.size("rows"))).first()[0], blocks.count()))
            return postings, tagged, documents, count

        return ranked_hits(queries, reading, kind, k)

    monkeypatch.setattr(module, "ranked_hits", spy)
    hits = search_index(spark, queries, path)
    assert sorted(r.doc_id for r in hits.collect()) == [0, 1, 2, 3, 4]
    assert seen[0][0] == 800 and seen[0][1] > 2  # dense and thin documents lie in blocks of their own


def test_an_index_of_nothing(spark, queries, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(ValueError):
        search_index(spark, queries, path)
    extend_index(spark.createDataFrame([(1, None), (2, "")], CORPUS), path)
    assert search_index(spark, queries, path).count() == 0


def test_numbered(spark):
    rng = random.Random(1)
    rows = list({(rng.choice("abc"), rng.randint(0, 400)) for _ in range(600)})
    got = numbered(spark.createDataFrame(rows, "k string, n long").repartition(5), ["k", "n"], "place").collect()
    assert [(r.k, r.n) for r in sorted(got, key=lambda r: r.place)] == sorted(rows)
    assert sorted(r.place for r in got) == list(range(len(rows)))
