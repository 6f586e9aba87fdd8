"""Repeated byte strings by a join of sampled fingerprints, over strings that double in length.

This is not a suffix array: no suffix is sorted at every byte. It stands in for prefix doubling, which
ranks a row per byte in each round; what it keeps of it is that only what repeats at one length is
looked at for twice that length (``repeated_spans``: 200 bytes, then 400).

A string of ``span`` bytes is repeated if it starts at two places of the corpus. Ranking the
suffix at every byte would sort a row per byte in every round, so positions are sampled where
content decides: a window's position is the least ``gram`` in it (window minima). Equal windows
have their position at the same distance, and neighbours share it, so a row speaks for a *run* of
window starts. Names (128-bit hashes) of strings that grow around the position are then grouped by Spark:

1. by the gram itself: a position whose gram is unique leaves, its windows are not repeated;
2. by all that the run's windows cover: equal there, all of the run's windows are repeated;
3. runs that are equal in 1 but not in 2 are cut into blocks of window starts: by what a block's
   windows have in common (unique: none is repeated) and by all they cover (equal: all are);
4. for blocks still open, by each window, the full ``span``.

Each round names fewer positions by longer strings, until unique or past the threshold. Only one
run of each equal set goes on to the next round.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkbrief.llm.common import MOST_LONGS, arrow_map, doc_key, sieve
from sparkbrief.staging import discard, staged

SPAN = 400
GRAM = 128
PASSAGE = 200  # bytes that passages of more than 50 words have, nearly always
PASSAGE_GRAM = 64  # in proportion to the gram of the full length; shorter ones are shared by chance
BLOCK = 16
SEGMENT = 1 << 18  # bytes of text whose names a task holds at once; longer texts are cut with overlap
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_PLACE = 22  # bits for a place in a segment


def _powers(base: int, count: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(count, base, dtype=np.uint64))])


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Names:
    """Names of substrings of a byte array: equal strings have equal names wherever they lie."""

    _tables = [_mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(b)) for b in _BASES]
    _up: list[np.ndarray] = []
    _down: list[np.ndarray] = []

    def __init__(self, data: np.ndarray):
        if not self._up or len(self._up[0]) <= len(data):
            count = max(len(data), SEGMENT + 2 * SPAN)
            Names._up = [_powers(b, count) for b in _BASES]
            Names._down = [_powers(pow(b, -1, 1 << 64), count) for b in _BASES]
        self.sums = []
        with np.errstate(over="ignore"):
            for table, up in zip(self._tables, self._up, strict=True):
                self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum(table[data] * up[: len(data)])]))

    def of(self, begin: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        sums = self.sums[which]
        with np.errstate(over="ignore"):
            return _mixed((sums[end] - sums[begin]) * self._down[which][begin] + np.uint64(1))

    def every(self, size: int) -> np.ndarray:
        sums = self.sums[0]
        with np.errstate(over="ignore"):
            return _mixed((sums[size:] - sums[:-size]) * self._down[0][: len(sums) - size] + np.uint64(1))


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value in each window of ``width``; the first of equal ones."""
    low = np.uint64((1 << _PLACE) - 1)
    keyed = values & ~low | np.arange(len(values), dtype=np.uint64)
    pad = -len(keyed) % width
    grid = np.concatenate([keyed, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(values) - width + 1
    return (np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & low).astype(np.int64)


def _segments(texts: list[bytes], span: int):
    """Lists of (text number, from, to) whose bytes together are about a segment."""
    group, held = [], 0
    for i, text in enumerate(texts):
        for start in range(0, max(len(text) - span + 1, 0), SEGMENT):
            end = min(len(text), start + SEGMENT + span - 1)
            if held and held + end - start > SEGMENT + span:
                yield group
                group, held = [], 0
            group.append((i, start, end))
            held += end - start
    if group:
        yield group


def runs_of(texts: list[bytes], span: int = SPAN, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of window starts ``lo..hi`` that share position ``at``, with the names of rounds 1 and 2."""
    made: list[tuple] = []
    for group in _segments(texts, span):
        data = np.frombuffer(b"".join([texts[i][a:b] for i, a, b in group]), dtype=np.uint8)
        sizes = np.array([b - a for _, a, b in group])
        names = Names(data)
        grams = names.every(gram)
        at = least_places(grams, span - gram + 1)
        piece = np.repeat(np.arange(len(group)), sizes)
        whole = piece[: len(at)] == piece[span - 1 :]
        starts = np.flatnonzero(whole)
        first = np.r_[True, (at[starts[1:]] != at[starts[:-1]]) | (piece[starts[1:]] != piece[starts[:-1]])]
        lo = starts[first]
        hi = starts[np.r_[np.flatnonzero(first)[1:] - 1, len(starts) - 1]]
        anchor, owner = at[lo], piece[lo]
        shift = np.array([a for _, a, _ in group])[owner] - (np.cumsum(sizes) - sizes)[owner]
        made.append(
            (
                np.array([i for i, _, _ in group])[owner],
                lo + shift,
                hi + shift,
                anchor + shift,
                grams[anchor].view(np.int64),
                names.of(lo, hi + span).view(np.int64),
                names.of(lo, hi + span, 1).view(np.int64),
            )
        )
    keys = ("text", "lo", "hi", "at", "gram", "u1", "u2")
    if not made:
        return {k: np.zeros(0, np.int64) for k in keys}
    return dict(zip(keys, map(np.concatenate, zip(*made, strict=True)), strict=True))


def _texts(part: pa.RecordBatch) -> list[bytes]:
    return [b or b"" for b in part.column("text").cast(pa.binary()).to_pylist()]


def _runs(docs: DataFrame, span: int, gram: int) -> DataFrame:
    def make(part: pa.RecordBatch) -> dict[str, np.ndarray]:
        found = runs_of(_texts(part), span, gram)
        rows = found.pop("text")
        ids = {n: part.column(n).to_numpy(zero_copy_only=False)[rows] for n in ("_id", "_key")}
        return ids | found

    fields = "_id long, _key long, lo int, hi int, at int, gram long, u1 long, u2 long"
    return arrow_map(docs, make, fields, 4 * SEGMENT)


def _contexts(docs: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """The bytes that each wanted run's windows cover."""
    lists = wanted.groupBy("_id", "_key").agg(
        F.collect_list(F.struct("lo", "hi", "at", "gram", "open")).alias("runs")  # at most the document's runs
    )
    among = sieve(wanted.select(F.col("_key").alias("hash")), MOST_LONGS)
    joined = among(docs, F.col("_key")).join(lists, ["_id", "_key"])

    def make(part: pa.RecordBatch) -> dict[str, list]:
        rows: list[tuple] = []
        ids, keys = part.column("_id").to_pylist(), part.column("_key").to_pylist()
        for i, key, text, runs in zip(ids, keys, _texts(part), part.column("runs").to_pylist(), strict=True):
            for r in runs:
                rows.append((i, key, r["lo"], r["hi"], r["at"], r["gram"], r["open"], text[r["lo"] : r["hi"] + span]))
        names = ("_id", "_key", "lo", "hi", "at", "gram", "open", "bytes")
        return dict(zip(names, zip(*rows, strict=True), strict=True))

    fields = "_id long, _key long, lo int, hi int, at int, gram long, open boolean, bytes binary"
    return arrow_map(joined, make, fields, 4 * SEGMENT)


def _laid_out(part: pa.RecordBatch, span: int):
    """Names over all contexts of a slice, and for each: where it begins, lo, hi, at."""
    raw = [b for b in part.column("bytes").to_pylist()]
    begin = np.cumsum([0, *map(len, raw)])[:-1]
    names = Names(np.frombuffer(b"".join(raw), dtype=np.uint8))
    lo, hi, at = (part.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("lo", "hi", "at"))
    return names, begin - lo, lo, hi, at


def _blocks(contexts: DataFrame, span: int, block: int) -> DataFrame:
    """Round 3: a row per block of window starts, counted by their distance to the position."""

    def make(part: pa.RecordBatch) -> dict[str, np.ndarray]:
        names, shift, lo, hi, at = _laid_out(part, span)
        least, most = (at - hi) // block, (at - lo) // block
        many = most - least + 1
        row = np.repeat(np.arange(len(lo)), many)
        number = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + least[row]
        first = np.maximum(at[row] - (number + 1) * block + 1, lo[row])
        last = np.minimum(at[row] - number * block, hi[row])
        where = shift[row]
        share = at[row] - number * block + where
        ids = {n: part.column(n).to_numpy(zero_copy_only=False)[row] for n in ("_id", "_key", "gram", "open")}
        return ids | {
            "run": lo[row],
            "block": number,
            "first": first,
            "last": last,
            # What all windows of a whole block share; also inside each window of a clipped one.
            "core": names.of(share, share + span - block + 1).view(np.int64),
            "u1": names.of(first + where, last + where + span).view(np.int64),
            "u2": names.of(first + where, last + where + span, 1).view(np.int64),
        }

    fields = (
        "_id long, _key long, gram long, open boolean, run int, block int, first int, last int, "
        "core long, u1 long, u2 long"
    )
    return arrow_map(contexts, make, fields, SEGMENT)


def _windows(contexts: DataFrame, span: int) -> DataFrame:
    """Round 4: a row per window start of the open blocks (``first, last`` lists)."""

    def make(part: pa.RecordBatch) -> dict[str, np.ndarray]:
        names, shift, _, _, _ = _laid_out(part, span)
        row, start = [], []
        for i, blocks in enumerate(part.column("blocks").to_pylist()):
            for b in blocks:
                start.append(np.arange(b["first"], b["last"] + 1))
                row.append(np.full(len(start[-1]), i))
        row, start = np.concatenate(row), np.concatenate(start)
        where = start + shift[row]
        ids = {n: part.column(n).to_numpy(zero_copy_only=False)[row] for n in ("_id", "_key", "open")}
        return ids | {
            "start": start,
            "u1": names.of(where, where + span).view(np.int64),
            "u2": names.of(where, where + span, 1).view(np.int64),
        }

    return arrow_map(contexts, make, "_id long, _key long, open boolean, start int, u1 long, u2 long", SEGMENT)


def repeated_ranges(
    docs: DataFrame, span: int = SPAN, gram: int = GRAM, block: int = BLOCK
) -> tuple[DataFrame, list[DataFrame]]:
    """``_id, _key, begin, end``: byte ranges, overlapping, that cover all repeated strings; and the tables they read.

    ``docs(_id, _key, text)``; rows equal in ``_id`` and ``_key`` are the same text given repeatedly.
    """
    every = staged(_runs(docs, span, gram), "runs")
    twice = every.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("gram")
    # Written first, so that the join below has plain exchanges on both sides, which can be split at hot grams.
    twice = staged(twice, "shared-grams")
    # Grams are the least of their windows, so their bits are uneven: hashed once more.
    among = sieve(twice.select(F.xxhash64("gram").alias("hash")), MOST_LONGS)
    # Grams are distinct there, so this keeps what a semi join would, which the optimizer moves below the sieve.
    runs = staged(among(every, F.xxhash64("gram")).join(twice, "gram"), "shared-runs")
    discard(every)
    same = runs.groupBy("gram", "u1", "u2").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("_id", "_key", "lo", "hi", "at")).alias("one")
    )
    same = staged(same, "run-classes")
    sure = runs.join(same.filter("n > 1").select("u1", "u2"), ["u1", "u2"], "left_semi")
    ranges = sure.select("_id", "_key", F.col("lo").alias("begin"), (F.col("hi") + span).alias("end"))
    mixed = staged(same.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("gram"), "mixed")
    wanted = same.join(mixed, "gram", "left_semi").select("one.*", "gram", (F.col("n") == 1).alias("open"))
    contexts = staged(_contexts(docs, wanted, span), "contexts")
    blocks = staged(_blocks(contexts, span, block), "blocks")
    group, name = ["gram", "block", "core"], ["u1", "u2"]
    kinds = blocks.groupBy(*group, *name).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("_id", "_key", "run", "first", "last", "open")).alias("one")
    )
    kinds = staged(kinds, "block-classes")
    equal = blocks.filter("open").join(kinds.filter("n > 1").select("gram", "block", *name), ["gram", "block", *name], "left_semi")
    ranges = ranges.union(
        equal.select("_id", "_key", F.col("first").alias("begin"), (F.col("last") + span).alias("end"))
    )
    mixed = kinds.groupBy(*group).agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select(*group)
    mixed = staged(mixed, "mixed-blocks")
    going = kinds.join(mixed, group, "left_semi").select(
        F.col("one._id").alias("_id"),
        F.col("one._key").alias("_key"),
        F.col("one.run").alias("lo"),
        F.struct("one.first", "one.last", (F.col("one.open") & (F.col("n") == 1)).alias("open")).alias("b"),
    )
    going = going.groupBy("_id", "_key", "lo").agg(F.collect_set("b").alias("blocks"))  # a run's blocks
    windows = staged(_windows(contexts.join(going, ["_id", "_key", "lo"]), span), "windows")
    again = staged(windows.groupBy(*name).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*name), "again")
    found = windows.filter("open").join(again, name, "left_semi")
    discard(contexts)
    ranges = ranges.union(
        found.select("_id", "_key", F.col("start").alias("begin"), (F.col("start") + span).alias("end"))
    )
    return ranges, [twice, runs, same, blocks, kinds, windows, again]


def _merged(ranges: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted((r["begin"], r["end"]) for r in ranges):
        if out and begin <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((begin, end))
    return out


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    begins = [0, *[e for _, e in spans]]
    ends = [*[b for b, _ in spans], len(text)]
    return b"".join([text[b:e] for b, e in zip(begins, ends, strict=True)])


def _range_lists(docs: DataFrame, span: int, gram: int, block: int) -> DataFrame:
    """``_id, _key, _ranges, _longest``: a document's maximal repeated byte ranges, in order, and the longest's bytes."""
    ranges, read = repeated_ranges(docs, span, gram, block)
    lists = ranges.groupBy("_id", "_key").agg(F.collect_set(F.struct("begin", "end")).alias("_ranges"))

    def make(part: pa.RecordBatch) -> dict[str, list]:
        found = [_merged(r) for r in part.column("_ranges").to_pylist()]
        return {
            "_id": part.column("_id"),
            "_key": part.column("_key"),
            "_ranges": [[{"begin": b, "end": e} for b, e in r] for r in found],
            "_longest": [max(e - b for b, e in r) for r in found],
        }

    fields = "_id long, _key long, _ranges array<struct<begin: int, end: int>>, _longest int"
    lists = staged(arrow_map(lists, make, fields), "range-lists")
    discard(*read)
    return lists


def _with_ranges(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """``docs`` with ``_ranges``; only texts that may have some are shuffled."""
    among = sieve(lists.select(F.col("_key").alias("hash")), MOST_LONGS)
    joined = among(docs, F.col("_key")).join(lists.drop("_longest"), ["_id", "_key"], "left")
    none = F.lit(None).cast(lists.schema["_ranges"].dataType)
    return joined.unionByName(among(docs, F.col("_key"), among=False).withColumn("_ranges", none))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns(dict(zip(("_id", "_key"), doc_key(), strict=True)))


def repeated_spans(
    docs: DataFrame, span: int = SPAN, gram: int = GRAM, block: int = BLOCK, half_gram: int = PASSAGE_GRAM
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, n_half`` of every row of ``docs(doc_id, text)``.

    ``spans`` are the maximal runs (begin, end) of bytes covered by a string of ``span`` bytes that
    also starts at another place of the table, in the same document or another. ``n_half`` counts the bytes
    covered by repeated strings of half that length, which also tells passages too short to be removed: what
    repeats at ``span`` bytes lies in such runs, so only documents that have one as long go on to the full length.

    A null text counts as empty; texts shorter than ``span`` repeat nothing at that length. Repeated rows are
    documents of their own, so each is a repeat of the other. A null id stays null. An empty table gives an empty one.
    """
    rows = _keyed(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    texts = rows.select("_id", "_key", "text")
    halves = _range_lists(texts, span // 2, half_gram, block)
    long = halves.filter(F.col("_longest") >= span).select(F.col("_key").alias("hash"))
    lists = _range_lists(sieve(long, MOST_LONGS)(texts, F.col("_key")), span, gram, block)

    def make(part: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
        for text, ranges in zip(_texts(part), part.column("_ranges").to_pylist(), strict=True):
            spans = _merged(ranges or [])
            out["n_bytes"].append(len(text))
            out["n_removed"].append(sum(e - b for b, e in spans))
            out["n_spans"].append(len(spans))
            out["kept_sha256"].append(hashlib.sha256(_kept(text, spans)).hexdigest())
            out["spans"].append([{"begin": b, "end": e} for b, e in spans])
        return {n: part.column(n) for n in ("doc_id", "_id", "_key")} | out

    fields = (
        "doc_id long, _id long, _key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "spans array<struct<begin: int, end: int>>"
    )
    told = arrow_map(_with_ranges(rows, lists), make, fields)
    covered = F.aggregate("_ranges", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["begin"])
    halves = halves.select("_id", "_key", covered.alias("_half"))
    told = told.join(halves, ["_id", "_key"], "left").withColumn("n_half", F.coalesce("_half", F.lit(0).cast("long")))
    return told.drop("_id", "_key", "_half")


def without_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """``docs``, all columns, with the repeated byte ranges cut out of ``text``.

    A character of which a cut leaves only some bytes is dropped. A document all of whose
    bytes go keeps its row with an empty text; a null text stays null.
    """
    others = [c for c in docs.columns if c != "text"]
    rows = _keyed(docs.select(F.col("doc_id"), F.col("text").cast("string"), F.struct(*others).alias("_row")))
    kind = rows.schema["_row"].dataType.simpleString()
    lists = _range_lists(rows.select("_id", "_key", "text"), span, gram, block)

    def make(part: pa.RecordBatch) -> dict[str, list]:
        texts = [
            None if null else _kept(text, _merged(ranges or [])).decode(errors="ignore")
            for text, ranges, null in zip(
                _texts(part), part.column("_ranges").to_pylist(), part.column("text").is_null().to_pylist(), strict=True
            )
        ]
        return {"_row": part.column("_row"), "text": texts}

    cut = arrow_map(_with_ranges(rows, lists), make, f"_row {kind}, text string")
    return cut.select(*[F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
