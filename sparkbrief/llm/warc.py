"""WARC archives of pages, and the normaliser of archives that are one gzip stream.

``write_archives`` writes a record per page into archives compressed as a whole. ``normalise``
inflates such a stream once, record by record, rewrites every record as a gzip member of its
own, and writes an index of offsets beside the archive; a record whose payload another record
holds becomes a revisit there. ``read_archives`` fetches single members by the index.

Tasks write files under names of their own try, and only the rows of tries that ended well
name them, so lost executors leave nothing that is read. Payloads are never shuffled.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbrief.llm.common import slices
from sparkbrief.staging import stage_path, staged

ARCHIVE_BYTES = 32 << 20  # of records before compression; a new archive begins beyond it
ARCHIVE_RECORDS = 20_000
MOST_TASKS = 20_000
CHUNK = 1 << 20
REVISIT_BYTES = 100  # smaller payloads are never revisits
DATE = "1970-01-01T00:00:00Z"  # pages carry no time
STREAM_LEVEL, MEMBER_LEVEL = 1, 4
_GZIP = 31


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record(kind: str, page_id: int | None, url: str | None, digest: str, size: int, payload: bytes, refers: int | None) -> bytes:
    """One WARC record; a revisit has the response's headers and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"Payload-Length: {size}"]
    if refers is not None:
        head += [
            f"WARC-Refers-To: <urn:page:{refers}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers of a record, and its payload (what follows the block's own headers)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _page_of(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def records_of(stream) -> Iterator[bytes]:
    """Whole records of a gzip stream, of one member or many; holds one record at a time."""
    inflate, held = zlib.decompressobj(_GZIP), bytearray()
    while chunk := stream.read(CHUNK):
        while chunk:
            held += inflate.decompress(chunk)
            chunk = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(_GZIP)
        at = 0
        while (end := held.find(b"\r\n\r\n", at)) >= 0:
            mark = held.rfind(b"Content-Length: ", at, end)
            length = int(held[mark + 16 : end].split(b"\r\n")[0])
            if len(held) < end + 8 + length:
                break
            yield bytes(held[at : end + 8 + length])
            at = end + 8 + length
        del held[:at]
    if held or not (inflate.eof or not inflate.unconsumed_tail):
        raise ValueError("the archive ends within a record")


class _Archive:
    """An archive being written as one gzip stream."""

    def __init__(self, root: str):
        self.path = f"{root}/{uuid.uuid4().hex}.warc.gz"
        system, inner = _open(self.path)
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        self.file = system.open_output_stream(inner, compression=None)
        self.deflate, self.bytes, self.records = zlib.compressobj(STREAM_LEVEL, wbits=_GZIP), 0, 0

    def add(self, raw: bytes) -> None:
        self.file.write(self.deflate.compress(raw))
        self.bytes, self.records = self.bytes + len(raw), self.records + 1

    def close(self) -> None:
        self.file.write(self.deflate.flush())
        self.file.close()


WRITTEN = "archive string, number int, page_id long, digest string, size long"


def write_archives(pages: DataFrame, root: str) -> DataFrame:
    """Write a record per row of ``pages(page_id, url, html)``; ``archive, number, page_id, digest, size``.

    The result must be kept (written) to be used: each evaluation writes archives anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            for part in slices(batch):
                rows: list[tuple] = []
                columns = [part.column(n).to_pylist() for n in ("page_id", "url", "html")]
                for page_id, url, html in zip(*columns, strict=True):
                    payload = (html or "").encode()
                    digest = hashlib.sha256(payload).hexdigest()
                    if archive is None:
                        archive = _Archive(root)
                    rows.append((archive.path, archive.records, page_id, digest, len(payload)))
                    archive.add(record("response", page_id, url, digest, len(payload), payload, None))
                    if archive.bytes > ARCHIVE_BYTES or archive.records >= ARCHIVE_RECORDS:
                        archive.close()
                        archive = None
                yield _batch(rows, WRITTEN)
        if archive is not None:
            archive.close()

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, WRITTEN)


_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*[f.split(" ") for f in schema.split(", ")], strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, type=_TYPES[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def revisits(written: DataFrame) -> DataFrame:
    """``archive, number, refers_to`` of records whose payload, of at least 100 bytes, has a smaller page id elsewhere."""
    large = written.filter(F.col("size") >= REVISIT_BYTES)
    first = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    first = first.filter((F.col("n") > 1) & F.col("refers_to").isNotNull()).select("digest", "refers_to")
    return (
        large.join(first, "digest")
        .filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select("archive", "number", "refers_to")
    )


def normalise(archives: DataFrame) -> DataFrame:
    """``archive, sidecar, records``: each of ``archives(archive, revisits)`` with a gzip member per record.

    ``revisits``: (number, refers_to) of the records to turn into revisits, may be null. The
    sidecar has a line per record: offset, length, page id, type, digest. Keep the result, as above.
    """
    schema = "archive string, sidecar string, records int"

    def one(path: str, turned: dict[int, int]) -> tuple[str, str, int]:
        target = f"{path.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:12]}"
        system, inner = _open(path)
        place = _open(target)[1]
        at, number = 0, 0
        with (
            system.open_input_stream(inner, compression=None) as source,
            system.open_output_stream(f"{place}.warc.gz", compression=None) as out,
            system.open_output_stream(f"{place}.index", compression=None) as index,
        ):
            for raw in records_of(source):
                fields, payload = parse(raw)
                page, digest = _page_of(fields["WARC-Record-ID"]), fields["WARC-Payload-Digest"][7:]
                refers = turned.get(number)
                kind = fields["WARC-Type"] if refers is None else "revisit"
                if refers is not None:
                    raw = record(kind, page, fields.get("WARC-Target-URI"), digest, len(payload), b"", refers)
                deflate = zlib.compressobj(MEMBER_LEVEL, wbits=_GZIP)
                member = deflate.compress(raw) + deflate.flush()
                out.write(member)
                line = {"offset": at, "length": len(member), "page_id": page, "type": kind, "digest": digest}
                index.write((json.dumps(line) + "\n").encode())
                at, number = at + len(member), number + 1
        return f"{target}.warc.gz", f"{target}.index", number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, turned in zip(batch.column("archive").to_pylist(), batch.column("revisits").to_pylist(), strict=True):
                yield _batch([one(path, {r["number"]: r["refers_to"] for r in turned or []})], schema)

    return archives.mapInArrow(run, schema)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(normal: DataFrame) -> DataFrame:
    """The records of archives ``(archive, sidecar)``, each member fetched by its offset.

    Digest and size of a response are taken from its payload, those of a revisit from its headers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, sidecar in zip(batch.column("archive").to_pylist(), batch.column("sidecar").to_pylist(), strict=True):
                system, inner = _open(path)
                with system.open_input_stream(_open(sidecar)[1], compression=None) as file:
                    lines = file.read().decode().splitlines()
                rows: list[tuple] = []
                with system.open_input_file(inner) as file:
                    for entry in map(json.loads, lines):
                        member = file.read_at(entry["length"], entry["offset"])
                        fields, payload = parse(zlib.decompress(member, _GZIP))
                        kind = fields["WARC-Type"]
                        if kind == "revisit":
                            size, digest = int(fields["Payload-Length"]), fields["WARC-Payload-Digest"][7:]
                            refers = _page_of(fields["WARC-Refers-To"])
                        else:
                            size, digest, refers = len(payload), hashlib.sha256(payload).hexdigest(), None
                        rows.append((_page_of(fields["WARC-Record-ID"]), size, digest, kind, refers))
                yield _batch(rows, READ)

    return normal.mapInArrow(run, READ)


def archive_pages(spark: SparkSession, pages: DataFrame, root: str | None = None) -> DataFrame:
    """Write, normalise and read back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    A null html has an empty payload, a null url no target. Records with equal payloads of at least
    100 bytes: those with the least page id are responses, all others revisits of it; a null id is
    never the least, and stays null. Rows that repeat the least id are all responses. ``root``
    (by default in the shared folder) must be one that executors reach. An empty table gives no rows.
    """
    root = root or stage_path(spark, "archives")
    written = staged(write_archives(pages, root), "written")
    lists = revisits(written).groupBy("archive").agg(F.collect_list(F.struct("number", "refers_to")).alias("revisits"))
    paths = staged(written.select("archive").distinct().join(lists, "archive", "left"), "archive-lists")
    # A given number of parts: rows this small would otherwise be merged into one task.
    parts = max(1, min(MOST_TASKS, paths.count()))
    return read_archives(staged(normalise(paths.repartition(parts, "archive")), "normal").repartition(parts, "archive"))
