"""Near-duplicate vectors by an exact metric range join.

Unit vectors at a cosine of ``least`` or more lie within a chord of each other. Sampled pivots
partition the vectors; a vector's home is its nearest pivot's cell. By the triangle inequality a
vector can only have a neighbour at home in another cell if it is nearly as near to that cell's
pivot, and it is copied there. So each cell holds all neighbours of its home vectors and is
joined on its own: a block of home vectors stays in memory, the cell's vectors stream past. A
large cell is dealt out by blocks. Equal vectors are one node with a count; no pairs are told,
only each node's number of links and stars that connect what is linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkbrief.llm.common import arrow_map
from sparkbrief.llm.components import components
from sparkbrief.llm.simhash_bk import join_labels
from sparkbrief.staging import staged

LEAST = 0.9
CELL = 8_192  # vectors at home in a cell, about
MOST_PIVOTS = 1_024  # pivots come to the driver and go to every task
BLOCK = 8_192  # home vectors that a task holds at once
STREAM = 4_096  # vectors compared with them at once


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length, from their bytes, as unit vectors."""
    raw = column.to_pylist()
    rows = np.frombuffer(b"".join(raw), dtype="<f8").reshape(len(raw), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def vectors(table: DataFrame) -> DataFrame:
    """``vec_id, bytes, dim`` of each row; ``bytes`` is null for vectors that link with nothing."""

    def make(part: pa.RecordBatch) -> dict[str, list]:
        found = []
        for v in part.column("embedding").to_pylist():
            if v is None or any(x is None for x in v):
                found.append(None)
                continue
            a = np.array(v, dtype="<f8")
            found.append((a + 0.0).tobytes() if len(a) and np.isfinite(a).all() and a.any() else None)
        return {"vec_id": part.column("vec_id"), "bytes": found, "dim": [0 if b is None else len(b) // 8 for b in found]}

    rows = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return arrow_map(rows, make, "vec_id long, bytes binary, dim int")


def _cells(nodes: DataFrame, pivots: dict[int, np.ndarray], blocks: dict[tuple[int, int], int] | None, reach: float) -> DataFrame:
    """Home cells (``blocks`` None), or a row per (cell, block) in which a vector takes part.

    ``role`` 0: it is one of the block's home vectors; 1: it streams past.
    """

    def make(part: pa.RecordBatch) -> dict[str, np.ndarray]:
        dims = part.column("dim").to_numpy(zero_copy_only=False)
        made: list[tuple] = []
        for dim in np.unique(dims).tolist():
            place = np.flatnonzero(dims == dim)
            own = pivots.get(dim)
            if own is None:
                home, member = np.zeros(len(place), np.int64), np.ones((len(place), 1), bool)
            else:
                near = _matrix(part.column("bytes").take(pa.array(place))) @ own.T
                home = near.argmax(axis=1)
                best = near[np.arange(len(place)), home][:, None]
                apart = np.sqrt(np.maximum(((own[:, None] - own[None]) ** 2).sum(axis=2), 0))[home]
                chord = lambda c: np.sqrt(np.maximum(2 - 2 * c, 0))
                # Both follow from the triangle inequality; the second for the distance to the bisector.
                member = (chord(near) - chord(best) <= 2 * reach) & (best - near <= reach * apart)
            if blocks is None:
                made.append((place, np.full(len(place), dim), home, home * 0, home * 0))
                continue
            node = part.column("node").to_numpy(zero_copy_only=False)[place]
            count = np.array([blocks.get((dim, c), 1) for c in range(member.shape[1])])
            made.append((place, np.full(len(place), dim), home, node % count[home], home * 0))
            row, cell = np.nonzero(member)
            many = count[cell]
            row, cell = np.repeat(row, many), np.repeat(cell, many)
            block = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            made.append((place[row], np.full(len(row), dim), cell, block, np.ones(len(row), np.int64)))
        row, dim, cell, block, role = map(np.concatenate, zip(*made, strict=True))
        take = pa.array(row)
        return {
            "dim": dim, "cell": cell, "block": block, "role": role,
            **{n: part.column(n).take(take) for n in ("node", "copies")},
            "bytes": part.column("bytes").take(take) if blocks is not None else pa.nulls(len(row), pa.binary()),
        }

    fields = "dim int, cell int, block int, role int, node long, copies long, bytes binary"
    return arrow_map(nodes, make, fields, 500_000)


class _Block:
    """Home vectors of one (cell, block), and what has been found for them."""

    def __init__(self) -> None:
        self.node, self.parts = np.zeros(0, np.int64), []
        self.ready = False

    def home(self, node: np.ndarray, rows: np.ndarray) -> None:
        self.node = np.concatenate([self.node, node])
        self.parts.append(rows)

    def stream(self, node: np.ndarray, copies: np.ndarray, rows: np.ndarray, least: float) -> np.ndarray:
        """Compare; returns edges (vector, a home vector) for every streamed one that links."""
        if not self.parts:
            return np.zeros((0, 2), np.int64)
        if not self.ready:
            self.matrix = np.concatenate(self.parts)
            self.single = self.matrix.astype(np.float32)
            self.links, self.labels, self.ready = np.zeros(len(self.node), np.int64), np.arange(len(self.node)), True
        # Single precision settles all pairs but those within its error of the limit; doubles settle these.
        error = np.float32(1e-6 + 5e-7 * rows.shape[1])
        near = rows.astype(np.float32) @ self.single.T
        there, here = np.nonzero(near >= np.float32(least) - error)
        close = np.flatnonzero(near[there, here] < np.float32(least) + error)
        if len(close):
            exact = (rows[there[close]] * self.matrix[here[close]]).sum(axis=1) >= least
            keep = np.ones(len(there), dtype=bool)
            keep[close] = exact
            there, here = there[keep], here[keep]
        if not len(there):
            return np.zeros((0, 2), np.int64)
        np.add.at(self.links, here, copies[there])
        first = np.r_[True, there[1:] != there[:-1]]
        lead = here[np.maximum.accumulate(np.where(first, np.arange(len(there)), 0))]
        self.labels = join_labels(self.labels, here, lead)
        return np.stack([node[there[first]], self.node[here[first]]], 1)

    def told(self) -> list[np.ndarray]:
        if not self.ready:
            return []
        kinds = np.zeros(len(self.node), np.int64)
        counts = np.stack([kinds, self.node, self.links - 1], 1)  # it has linked with itself
        star = np.stack([kinds + 1, self.node, self.node[self.labels]], 1)
        return [counts, star[star[:, 1] != star[:, 2]]]


def _join(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (0, node, links) and (1, node, node); rows come by (dim, cell, block, role)."""
    now, block = None, _Block()

    def out(rows: list[np.ndarray]) -> pa.RecordBatch:
        all_rows = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(all_rows[:, i])) for i in range(3)], names=["kind", "a", "b"])

    for batch in batches:
        keys = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in ("dim", "cell", "block", "role")], 1)
        if not len(keys):
            continue
        cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        for start, end in zip(cuts, [*cuts[1:], len(keys)], strict=True):
            key = tuple(keys[start, :3].tolist())
            if key != now:
                yield out(block.told())
                now, block = key, _Block()
            for a in range(start, end, STREAM):
                part = batch.slice(a, min(STREAM, end - a))
                node = part.column("node").to_numpy(zero_copy_only=False)
                rows = _matrix(part.column("bytes"))
                if keys[start, 3] == 0:
                    block.home(node, rows)
                    continue
                edges = block.stream(node, part.column("copies").to_numpy(zero_copy_only=False), rows, least)
                edges = edges[edges[:, 0] != edges[:, 1]]
                if len(edges):
                    yield out([np.concatenate([np.ones((len(edges), 1), np.int64), edges], 1)])
    yield out(block.told())


def near_vectors(table: DataFrame, least: float = LEAST, cell: int = CELL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``table(vec_id, embedding)``.

    Links join vectors of equal length whose cosine, in double precision, is ``least`` or more.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing.
    Rows with equal vectors link with each other. ``component_id`` is the least non-null id reachable
    (a vector without links: its own), ``kept`` whether that is the row's own id (false for a null
    id). Other columns are not looked at; an empty table gives an empty one.
    """
    rows = staged(vectors(table).withColumn("node", F.xxhash64("bytes")), "vectors")
    nodes = rows.filter(F.col("bytes").isNotNull()).groupBy("bytes", "dim", "node").agg(F.count(F.lit(1)).alias("copies"))
    nodes = staged(nodes, "nodes")
    sizes = {r["dim"]: r["n"] for r in nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    wanted = max(1, min(MOST_PIVOTS, math.ceil(total / cell)))
    chosen = nodes.orderBy(F.xxhash64("node", F.lit("pivot")), "node").limit(wanted).select("dim", "bytes").collect()
    pivots = {d: _matrix(pa.array([r["bytes"] for r in chosen if r["dim"] == d])) for d in {r["dim"] for r in chosen}}
    reach = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    homes = _cells(nodes, pivots, None, reach).groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")).collect()
    blocks = {(r["dim"], r["cell"]): math.ceil(r["n"] / BLOCK) for r in homes}  # one entry per pivot
    dealt = _cells(nodes, pivots, blocks, reach).repartition("dim", "cell", "block")
    dealt = dealt.sortWithinPartitions("dim", "cell", "block", "role")
    found = staged(dealt.mapInArrow(lambda batches: _join(batches, least), "kind long, a long, b long"), "links")
    links = found.filter("kind = 0").select(F.col("a").alias("node"), F.col("b").alias("n_links"))
    joined = components(found.filter("kind = 1").select("a", "b"))
    named = links.join(joined, "node", "left").select("node", "n_links", F.coalesce("component", "node").alias("_component"))
    lowest = rows.filter(F.col("bytes").isNotNull()).groupBy("node").agg(F.min("vec_id").alias("_least"))
    named = staged(named.join(lowest, "node"), "named")
    least_id = named.groupBy("_component").agg(F.min("_least").alias("component_id"))
    named = named.join(least_id, "_component").select(F.col("node").alias("_n"), "n_links", "component_id")
    same = rows["bytes"].isNotNull() & (rows["node"] == named["_n"])
    return rows.join(named, same, "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id").isNotNull() & (F.coalesce("component_id", "vec_id") == F.col("vec_id"))).alias("kept"),
    )
