import gzip
import hashlib
import io
import json
import zlib

import pytest
from pyspark.sql import functions as F

from sparkbrief.llm import warc
from sparkbrief.llm.warc import archive_pages, normalise, parse, read_archives, record, records_of, revisits, write_archives
from sparkbrief.staging import staged

BODY = "<p>é" + "x" * 200 + "</p>"
PAGES = [
    (1, "http://a/1", BODY),
    (0, "http://a/0", BODY),
    (0, "http://a/0", BODY),
    (7, None, BODY + "\r\n\r\nContent-Length: 5\r\n\r\n"),
    (8, "http://a/\r\nEvil: 1", None),
    (9, "http://a/9", ""),
    (10, "u", "y" * 99),
    (11, "u", "y" * 99),
    (12, "u", "é" * 50),
    (13, "u", "é" * 50),
    (None, "u", BODY),
    (None, "u", "z" * 120),
    (20, "u", "big" * 1_000_000),
]


def slow(pages):
    least = {}
    for i, _, html in pages:
        data = (html or "").encode()
        if i is not None and len(data) >= 100:
            least[data] = min(least.get(data, i), i)
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        first = least.get(data)
        again = len(data) >= 100 and first is not None and i != first
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(*p, "x", 1) for p in PAGES]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, number int").repartition(3)


def test_round_trip(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 1000)
    rows = archive_pages(spark, pages)
    assert rows.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(repr, map(tuple, rows.collect()))) == slow(PAGES)


def test_given_pages_with_copies(spark, folder):
    table = spark.read.parquet(f"{folder}/pages.parquet")
    more = table.union(table.filter("page_id < 20").withColumn("page_id", F.col("page_id") + 1000))
    expected = slow([tuple(r) for r in more.select("page_id", "url", "html").collect()])
    assert sorted(map(repr, map(tuple, archive_pages(spark, more).collect()))) == expected


def test_archives_are_readable_by_any_gzip_reader(spark, pages, tmp_path):
    written = staged(write_archives(pages, str(tmp_path)), "written")
    lists = revisits(written).groupBy("archive").agg(F.collect_list(F.struct("number", "refers_to")).alias("revisits"))
    normal = staged(normalise(written.select("archive").distinct().join(lists, "archive", "left")), "normal")
    seen = 0
    for r in normal.collect():
        with open(r["sidecar"]) as file:
            index = [json.loads(line) for line in file]
        with open(r["archive"], "rb") as file:
            data = file.read()
        whole = gzip.decompress(data)
        parts = [gzip.decompress(data[e["offset"] : e["offset"] + e["length"]]) for e in index]
        assert b"".join(parts) == whole and len(parts) == r["records"]
        for part, entry in zip(parts, index, strict=True):
            fields, _ = parse(part)
            assert fields["WARC-Type"] == entry["type"]
        seen += len(parts)
    assert seen == len(PAGES) and read_archives(normal).count() == seen
    for r in written.select("archive").distinct().collect():
        with open(r["archive"], "rb") as file:
            first = zlib.decompressobj(31)
            first.decompress(file.read())
            assert first.eof and not first.unused_data  # one stream for all records


def test_truncated_archive_is_an_error():
    raw = record("response", 1, "u", "d", 3, b"abc", None)
    assert list(records_of(io.BytesIO(gzip.compress(raw) + gzip.compress(raw)))) == [raw, raw]
    with pytest.raises(ValueError):
        list(records_of(io.BytesIO(gzip.compress(raw[:-3]))))


def test_empty(spark, pages):
    assert archive_pages(spark, pages.limit(0)).count() == 0
