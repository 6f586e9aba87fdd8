import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkbrief.llm import sharding
from sparkbrief.llm.sharding import shard

from .conftest import texts_of


def check(rows, texts, shards=24):
    expected = sorted(repr((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))) for i, t in texts)
    assert sorted(repr((r["doc_id"], r["size"], r["text_crc32"])) for r in rows) == expected
    by = defaultdict(list)
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        by[r["shard"]].append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    total, most = sum(r["size"] for r in rows), max((r["size"] for r in rows), default=0)
    for s in range(shards):
        assert abs(sum(r["size"] for r in by[s]) - total / shards) <= most + 1


@pytest.mark.parametrize("ranges", [4, 192])
def test_shards_are_near_equal(messy, given, monkeypatch, ranges):
    monkeypatch.setattr(sharding, "LEAST_RANGES", ranges)
    for docs in (messy, given):
        check(shard(docs).collect(), texts_of(docs))


def test_one_text_with_most_rows_is_cut(given):
    hot = given.withColumn("text", F.when(F.col("doc_id") % 3 > 0, F.lit("the same text")).otherwise(F.col("text")))
    check(shard(hot).collect(), texts_of(hot))


def test_equal_texts_are_neighbours(given):
    rows = sorted(shard(given).collect(), key=lambda r: (r["shard"], r["slot"]))
    texts = dict(texts_of(given))
    seen, last = set(), None
    for r in rows:
        text = texts[r["doc_id"]]
        assert text == last or text not in seen
        seen.add(text)
        last = text


def test_empty(empty):
    assert shard(empty).count() == 0
