"""SimHash near-duplicates: Burkhard-Keller trees over shards of fingerprints.

Fingerprints are cut into blocks of bits. Two that differ in at most ``radius`` bits agree in
all blocks but ``radius``, so every choice of that many agreeing blocks names a shard, and
linked fingerprints meet in at least one. In a shard's tree the children of a node are keyed
by their whole-number distance to it, and a search follows only edges within the radius of the
query's own distance. A task holds the trees of many shards in arrays and walks them for all
queries at once. It tells no pairs: of the links found it keeps a spanning star per connected set.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkbrief.llm.common import MOST_LONGS, arrow_map, sieve
from sparkbrief.llm.components import components
from sparkbrief.staging import staged

SEED = 42
BITS = 64
HOT_SHARD = 20_000  # fingerprints; a larger shard is cut by further blocks, which loses no link
TASK_ROWS = 200_000  # shard rows a task holds at once, about
FRONTIER = 500_000  # (query, node) pairs a walk holds at once
_BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)
_PLACES = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of the word shingles of a text; 0 if it has no words."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    digest = xxhash.xxh64_digest
    if len(tokens) < words:
        raw = digest(b" ".join(tokens), SEED)
    else:
        shifted = [tokens[i:] for i in range(words)]
        raw = b"".join([digest(b" ".join(z), SEED) for z in zip(*shifted, strict=False)])
    return fold_parts(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8))


def fold_parts(parts: np.ndarray) -> int:
    """The fingerprint of shingle hashes, 8 bytes a row; 0 if there is none."""
    counts = np.bincount((parts + _PLACES).ravel(), minlength=2048).reshape(8, 256) @ _BIT_OF_BYTE
    return int.from_bytes(np.packbits(counts.ravel() * 2 > len(parts)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, text_key, fp`` (the fingerprint as a signed long) of each row."""

    def make(part: pa.RecordBatch) -> dict[str, list]:
        found = [fingerprint((t or "").encode(), words) for t in part.column("text").to_pylist()]
        kept = {n: part.column(n) for n in ("doc_id", "text_key")}
        return kept | {"fp": np.array(found, np.uint64).view(np.int64)}

    rows = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_key")
    )
    return arrow_map(rows, make, "doc_id long, text_key long, fp long")


def block_choices(radius: int, blocks: int, bits: int = BITS) -> list[list[tuple[int, int]]]:
    """Each choice of ``blocks - radius`` agreeing blocks, as (shift, width) ranges of bits."""
    cuts = [round(i * bits / blocks) for i in range(blocks + 1)]
    ranges = [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [list(c) for c in combinations(ranges, blocks - radius)]


def _take(codes: np.ndarray, ranges: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(len(codes), dtype=np.uint64)
    for shift, width in ranges:
        mask = np.uint64((1 << width) - 1)
        out = out << np.uint64(width) | (codes >> np.uint64(shift)) & mask
    return out


def _rest(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    taken = {b for shift, width in ranges for b in range(shift, shift + width)}
    return [(b, 1) for b in range(BITS) if b not in taken]


def shard_rows(fps: DataFrame, radius: int, blocks: int, inner: bool = False) -> DataFrame:
    """``shard, sub, fp``: a row per choice of blocks; ``inner`` cuts given shards once more."""
    choices = block_choices(radius, blocks)

    def outer(part: pa.RecordBatch) -> dict[str, np.ndarray]:
        codes = part.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        keys = [_take(codes, c) << np.uint64(5) | np.uint64(i) for i, c in enumerate(choices)]
        return {
            "shard": np.concatenate(keys).view(np.int64),
            "sub": np.full(len(codes) * len(keys), -1, np.int64),
            "fp": np.tile(codes, len(keys)).view(np.int64),
        }

    def again(part: pa.RecordBatch) -> dict[str, np.ndarray]:
        codes = part.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        shard = part.column("shard").to_numpy(zero_copy_only=False)
        made: list[tuple] = []
        for i, choice in enumerate(choices):
            mine = shard & 31 == i
            rest = _rest(choice)
            cuts = [round(j * len(rest) / (radius + 1)) for j in range(radius + 2)]
            for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                sub = _take(codes[mine], rest[a:b]).view(np.int64) * 8 + j
                made.append((shard[mine], sub, codes[mine].view(np.int64)))
        return dict(zip(("shard", "sub", "fp"), map(np.concatenate, zip(*made, strict=True)), strict=True))

    return arrow_map(fps, again if inner else outer, "shard long, sub long, fp long")


class Forest:
    """Burkhard-Keller trees of many shards: ``edge`` sorts (node, distance), ``child`` follows."""

    def __init__(self, shard: np.ndarray, codes: np.ndarray):
        order = np.argsort(shard, kind="stable")
        self.codes, shard = codes[order], shard[order]
        count = len(order)
        begins = np.r_[True, shard[1:] != shard[:-1]] if count else np.zeros(0, bool)
        self.root = np.maximum.accumulate(np.where(begins, np.arange(count), 0))
        here, at = np.flatnonzero(~begins), self.root[~begins]
        edges, children = [], []
        while len(here):
            key = at * (BITS + 1) + np.bitwise_count(self.codes[here] ^ self.codes[at])
            rank = np.argsort(key, kind="stable")
            here, key = here[rank], key[rank]
            new = np.r_[True, key[1:] != key[:-1]]
            edges.append(key[new])
            children.append(here[new])
            down = here[np.maximum.accumulate(np.where(new, np.arange(len(here)), 0))]
            here, at = here[~new], down[~new]
        edge = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        rank = np.argsort(edge)
        self.edge = edge[rank]
        self.child = (np.concatenate(children) if children else edge)[rank]

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Item places (query, found) within the radius, in bounded portions; each pair both ways."""
        waiting = [(np.arange(len(self.codes)), self.root)]
        while waiting:
            query, node = waiting.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                waiting += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            apart = np.bitwise_count(self.codes[query] ^ self.codes[node]).astype(np.int64)
            near = (apart <= radius) & (query != node)
            yield query[near], node[near]
            base = node * (BITS + 1)
            low = np.searchsorted(self.edge, base + np.maximum(apart - radius, 0))
            high = np.searchsorted(self.edge, base + np.minimum(apart + radius, BITS), side="right")
            many = high - low
            if many.sum():
                steps = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                waiting.append((np.repeat(query, many), self.child[np.repeat(low, many) + steps]))


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (place of a representative) after the sets of ``a`` and ``b`` are joined pairwise."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            onward = labels[labels]
            if (onward == labels).all():
                break
            labels = onward
    return labels


def _stars(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of all shards of a partition; whole shards are together, in order."""

    def of(shard: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        forest = Forest(shard, codes)
        labels = np.arange(len(codes))
        for query, found in forest.links(radius):
            labels = join_labels(labels, query, found)
        moved = labels != np.arange(len(labels))
        pairs = np.unique(np.stack([forest.codes[moved], forest.codes[labels[moved]]], 1), axis=0)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(pairs[:, i]).view(np.int64)) for i in (0, 1)], names=["a", "b"]
        )

    kept: list[np.ndarray] = []
    rows = 0
    for batch in batches:
        columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("shard", "sub", "fp")]
        kept.append(np.stack(columns, 1))
        rows += batch.num_rows
        if rows >= TASK_ROWS:
            held = np.concatenate(kept)
            same = (held[:, :2] == held[-1, :2]).all(1)  # the last shard may go on
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield of(_number(held[:cut]), held[:cut, 2].copy().view(np.uint64))
            kept, rows = [held[cut:]], len(held) - cut
    if rows:
        held = np.concatenate(kept)
        yield of(_number(held), held[:, 2].copy().view(np.uint64))


def _number(held: np.ndarray) -> np.ndarray:
    new = np.r_[False, (held[1:, :2] != held[:-1, :2]).any(1)]
    return np.cumsum(new)


def near_links(fps: DataFrame, radius: int = 3, hot_shard: int = HOT_SHARD) -> DataFrame:
    """Links ``a, b`` that connect all distinct ``fp`` within the radius, directly or through others."""
    count = fps.count()
    blocks = radius + (1 if count < 1 << 24 else 2 if count < 1 << 31 else 3)
    rows = staged(shard_rows(fps, radius, blocks), "shards")
    sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("_n"))
    hot = staged(sizes.filter(F.col("_n") > hot_shard).select("shard"), "hot-shards")
    if not hot.isEmpty():
        cut = shard_rows(rows.join(hot, "shard", "left_semi"), radius, blocks, inner=True)
        rows = rows.join(hot, "shard", "left_anti").unionByName(cut)
    dealt = rows.repartition("shard", "sub").sortWithinPartitions("shard", "sub")
    return dealt.mapInArrow(lambda batches: _stars(batches, radius), "a long, b long")


def simhash_groups(docs: DataFrame, radius: int = 3, words: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id, text_key`` of every row of ``docs(doc_id, text)``.

    Null and empty texts have fingerprint zero and link like any other. Equal fingerprints
    are one node, however many rows share them. ``component_id`` is the least non-null
    ``doc_id`` of the connected set, null if it has none. Repeated rows and rows with a null
    id give a row each. Other columns are not looked at; an empty table gives an empty one.
    """
    rows = staged(fingerprints(docs, words), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("_least"))
    links = components(near_links(nodes.select("fp"), radius))
    named = nodes.join(links, nodes["fp"] == links["node"], "left").select(
        "fp", "_least", F.coalesce("component", "fp").alias("_component")
    )
    named = staged(named, "nodes")
    lowest = named.groupBy("_component").agg(F.min("_least").alias("component_id"))
    named = named.join(lowest, "_component").select("fp", "component_id", "_component")
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_key", "_component"
    )


def near_duplicates_removed(docs: DataFrame, radius: int = 3, words: int = 3) -> DataFrame:
    """``docs``, all columns, with one row of each connected set.

    It is the row with the least ``doc_id`` (a null id comes last, equal ids go by a hash of the
    text); of rows that repeat that id and text one stays.
    """
    return one_of_each(docs, simhash_groups(docs, radius, words))


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs``, all columns, with the row of the least ``doc_id`` of each ``_component``.

    ``groups(doc_id, text_key, _component)`` has a row for each of ``docs``; ties as in ``near_duplicates_removed``.
    """
    groups = staged(groups, "groups")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    best = groups.groupBy("_component").agg(F.min(key).alias("best"), F.count(F.lit(1)).alias("n"))
    best = staged(best.filter("n > 1").select("_component", "best"), "kept")
    judged = groups.join(best, "_component").select("doc_id", "text_key", (key == F.col("best")).alias("stays"))
    judged = judged.groupBy("doc_id", "text_key").agg(F.bool_or("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    judged = staged(judged.filter(~F.col("stays") | (F.col("n") > 1)), "judged")
    gone = judged.select("doc_id", "text_key")
    among = sieve(gone.select(F.col("text_key").alias("hash")), MOST_LONGS)
    # A row travels as one value, so that no column of it can clash with those that are added here.
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"), F.struct("*").alias("row"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key"))
    # Only rows that may be among the judged are shuffled. Judged keys are distinct, so the joins repeat no row.
    some = among(rows, F.col("key"))
    left = some.join(gone, same, "left").filter(F.col("text_key").isNull()).select(*rows.columns)
    left = left.unionByName(among(rows, F.col("key"), among=False))
    repeated = judged.filter("stays").select("doc_id", "text_key")
    if not repeated.isEmpty():
        left = left.unionByName(some.join(repeated, same).select(*rows.columns).dropDuplicates(["id", "key"]))
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])
