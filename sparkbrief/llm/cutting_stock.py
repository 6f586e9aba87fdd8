"""Packing by column generation over a histogram of piece lengths.

Documents are cut into pieces of a full sequence and a remainder. Lengths are counted in
classes of ``grain`` tokens, so the linear program has at most ``sequence / grain`` rows at any
corpus size: its columns are patterns (how many pieces of which class fill a sequence), priced
by a knapsack over the duals. Patterns are used as often as their rounded-down value; the few
pieces left over are packed by best fit. Spark ranks the pieces of each class, and a
piece's rank says which copy of which pattern it fills.
"""

from __future__ import annotations

import json
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkbrief.llm.common import arrow_map
from sparkbrief.llm.token_counts import byte_symbols
from sparkbrief.staging import staged

SEQUENCE = 2048
GRAIN = 8
END_ID = 1
GAP = 1e-3  # column generation ends when the bound is this near
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Token ids as the ``tokenizers`` library gives them for a byte-level BPE file.

    Where ids are in merge order, as in the files this is made for, the same merges run in
    ``tiktoken``, which is several times as fast; for another file the library itself is used.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        first = len(vocabulary) - len(pairs)
        ordered = all(vocabulary[a + b] == first + i for i, (a, b) in enumerate(pairs))
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if ordered and all("normalized" not in t or not t["normalized"] for t in spec.get("added_tokens", [])):
            import tiktoken

            symbols = byte_symbols()
            ranks = {bytes(symbols[c] for c in token): i for token, i in vocabulary.items()}
            coder = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
            self.ids = lambda text: coder.encode(text, allowed_special="all")
        else:
            from tokenizers import Tokenizer

            coder = Tokenizer.from_file(path)
            self.ids = lambda text: coder.encode(text, add_special_tokens=False).ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """``doc_id, text_key, start, length, ids_crc32, doc_tokens``: full sequences, then the remainder."""

    def make(part: pa.RecordBatch) -> dict[str, list]:
        rows: list[tuple] = []
        texts, ids = part.column("text").to_pylist(), part.column("doc_id").to_pylist()
        for doc, key, text in zip(ids, part.column("text_key").to_pylist(), texts, strict=True):
            found = np.array([*encoder(vocabulary).ids(text or ""), end_id], dtype="<u4")
            for start in range(0, len(found), sequence):
                cut = found[start : start + sequence]
                rows.append((doc, key, start, len(cut), zlib.crc32(cut.tobytes()), len(found)))
        names = ("doc_id", "text_key", "start", "length", "ids_crc32", "doc_tokens")
        return dict(zip(names, zip(*rows, strict=True), strict=True))

    rows = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_key")
    )
    return arrow_map(
        rows, make, "doc_id long, text_key long, start long, length long, ids_crc32 long, doc_tokens long", 2_000_000
    )


def knapsack(sizes: np.ndarray, worth: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable filling of ``room`` with any number of each size, by dynamic programming."""
    best, taken = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(sizes, np.arange(room + 1), side="right").tolist()  # sizes ascend
    for space in range(1, room + 1):
        best[space] = best[space - 1]
        if many := fits[space]:
            value = best[space - sizes[:many]] + worth[:many]
            top = value.argmax()
            if value[top] > best[space] + 1e-12:
                best[space], taken[space] = value[top], top
    counts, space = np.zeros(len(sizes)), room
    while space > 0:
        if taken[space] < 0:
            space -= 1
        else:
            counts[taken[space]] += 1
            space -= int(sizes[taken[space]])
    return float(best[room]), counts


def patterns(histogram: dict[int, int], room: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {class: pieces}) that use up the histogram exactly; few patterns at any counts."""
    sizes = np.array(sorted(histogram), dtype=np.int64)
    if not len(sizes):
        return []
    need = np.array([histogram[s] for s in sizes.tolist()], dtype=float)
    whole = np.diag((room // sizes).astype(float))
    inverse, columns, amount = np.diag(1.0 / (room // sizes)), [whole[:, i] for i in range(len(sizes))], need / (room // sizes)
    for _ in range(40 * len(sizes) + 100):  # ends far earlier; any basis is a valid packing
        worth = inverse.sum(axis=0)
        value, column = knapsack(sizes, np.maximum(worth, 0), room)
        if value <= 1 + 1e-9 or 1 - 1 / value < GAP:
            break
        step = (inverse * column).sum(axis=1)
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        amount = np.maximum(amount - ratio[out] * step, 0)
        amount[out] = ratio[out]
        columns[out] = column
        inverse[out] /= step[out]
        others = np.arange(len(sizes)) != out
        inverse[others] -= np.outer(step[others], inverse[out])
    chosen: list[tuple[int, dict[int, int]]] = []
    left = need.astype(np.int64)
    for times, column in sorted(zip(amount, columns, strict=True), key=lambda x: -x[0]):
        copies = column.astype(np.int64)
        used = copies > 0
        times = int(min(math.floor(times + 1e-6), (left[used] // copies[used]).min(initial=1 << 62)))
        if times > 0 and used.any():
            left -= times * copies
            chosen.append((times, {int(s): int(c) for s, c in zip(sizes[used], copies[used], strict=True)}))
    # What rounding left: at most about one pattern's pieces per class, by best fit of the largest first.
    open_rooms: list[list] = []
    for size, count in sorted(zip(sizes.tolist(), left.tolist(), strict=True), reverse=True):
        for _ in range(count):
            fit = min((r for r in open_rooms if r[0] >= size), key=lambda r: r[0], default=None)
            if fit is None:
                open_rooms.append(fit := [room, {}])
            fit[0] -= size
            fit[1][size] = fit[1].get(size, 0) + 1
    return chosen + [(1, p) for _, p in open_rooms]


def places(plan: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """The plan as ranges of ranks by class: what ranks fill which sequences and slots."""
    rows, used, sequence = [], {}, 0
    for times, pattern in plan:
        slot = 0
        for size, copies in sorted(pattern.items(), reverse=True):
            rows.append((size, used.get(size, 0), sequence, copies, slot))
            used[size] = used.get(size, 0) + times * copies
            slot += copies
        sequence += times
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("size", "rank", "sequence", "copies", "slot"), columns, strict=True))


def ranked(df: DataFrame, group: str, order: list[str], bucket_rows: int = 5_000) -> DataFrame:
    """Adds ``_rank``, 0, 1, ... within each group; a large group is ranked in many tasks."""
    rows = df.count()
    buckets = max(1, math.ceil(rows / bucket_rows))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = df.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(group, "_bucket").orderBy(*order)
    numbered = df.withColumn("_row", F.row_number().over(within) - 1)
    joined = numbered.join(bases, [group, "_bucket"])
    return joined.withColumn("_rank", F.col("_row") + F.col("_base")).drop("_row", "_base", "_bucket")


def pack(
    docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE, grain: int = GRAIN, end_id: int = END_ID
) -> DataFrame:
    """Pieces of all documents with their place: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, text_key``.

    Every document is its token ids and then ``end_id``; a null or empty text is that one id.
    Sequences hold at most ``sequence`` ids. Repeated rows are packed as often as they come; ties
    of length are ranked by id and start; a null id stays null. An empty table gives no pieces.
    """
    cut = staged(pieces(docs, vocabulary, sequence, end_id), "pieces")
    sized = cut.withColumn("_size", F.ceil(F.col("length") / grain))
    counted = sized.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).collect()  # sequence / grain rows at most
    room = sequence // grain
    where = places(patterns({r["_size"]: r["n"] for r in counted}, room))
    keys = where["size"] << 44 | where["rank"]

    columns = cut.columns

    def make(part: pa.RecordBatch) -> dict[str, list]:
        size, rank = (part.column(n).to_numpy(zero_copy_only=False) for n in ("_size", "_rank"))
        at = np.searchsorted(keys, size << 44 | rank, side="right") - 1
        over = rank - where["rank"][at]
        kept = {n: part.column(n) for n in columns}
        copies = where["copies"][at]
        return kept | {
            "sequence_id": where["sequence"][at] + over // copies,
            "_slot": where["slot"][at] + over % copies,
        }

    fields = ", ".join(f"{n} long" for n in [*columns, "sequence_id", "_slot"])
    placed = arrow_map(ranked(sized, "_size", ["doc_id", "start", "text_key"]), make, fields)
    before = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "text_key"
    )


def sequences(docs: DataFrame, packed: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """``sequence_id, ids``: the token ids of each sequence of a packing of the same documents."""

    def make(part: pa.RecordBatch) -> dict[str, list]:
        ids = [[*encoder(vocabulary).ids(t or ""), end_id] for t in part.column("text").to_pylist()]
        return {"_doc": part.column("_doc"), "_text": part.column("_text"), "_ids": ids}

    rows = docs.select(
        F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_text"), F.col("text").cast("string")
    ).dropDuplicates(["_doc", "_text"])
    coded = arrow_map(rows, make, "_doc long, _text long, _ids array<int>", 2_000_000)
    same = packed["doc_id"].eqNullSafe(coded["_doc"]) & (packed["text_key"] == coded["_text"])
    parts = packed.join(coded, same).select(
        "sequence_id",
        F.struct("offset", F.slice("_ids", F.col("start") + 1, F.col("length")).alias("part")).alias("_piece"),
    )
    gathered = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list("_piece")).alias("_pieces"))
    return gathered.select("sequence_id", F.flatten(F.col("_pieces.part")).alias("ids"))
