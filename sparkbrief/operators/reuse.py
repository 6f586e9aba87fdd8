"""Which lookups a cache of a given number of entries would have served: least recently used entries leave first.

A lookup is served if fewer than ``capacity`` other keys were looked up since its key was last. That number, the reuse
distance, tells hits at every capacity at once. With all lookups numbered in order and ``prev`` the number of the key's
last one, the keys between are those whose own ``prev`` lies further back, so the distance is a count of pairs
(smaller number, smaller ``prev``). Numbers and ``prev`` are each cut into blocks: whole blocks are counted in a
grid, the rest within one block of numbers or one of ``prev``, which a task holds.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkbrief.operators.ordered import HOT_ROWS, numbered, scan
from sparkbrief.staging import staged

# Fixed value.
CACHE_ENTRIES = 128

BLOCK = 1 << 18  # lookups in a block, which a task holds; more only where the grid would outgrow the lookups

_KEYS = ["query", "num_results"]


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each value, how many before it are smaller."""
    count = len(values)
    found = np.zeros(count, np.int64)
    # Of equal values the later comes first, so that none counts for another.
    by_value = np.lexsort((-np.arange(count), values))
    for k in range(max(count - 1, 0).bit_length()):
        # Halves of 2^k places: those of a left half count for the right half beside it.
        laid = by_value[np.argsort(by_value >> (k + 1), kind="stable")]
        left = (laid >> k) & 1 == 0
        before = np.cumsum(left) - ((laid >> (k + 1)) << k)  # lefts of the pairs of halves before are all there
        found[laid[~left]] += before[~left]
    return found


def _in_block_of_numbers(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("pos")
    rows["near"] = smaller_before(rows["prev"].to_numpy())
    return rows


def _in_block_of_prevs(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("prev")
    rows["near"] += smaller_before(rows["pos_block"].to_numpy())
    return rows


def _grid(cells: DataFrame, blocks: int) -> DataFrame:
    """``pos_block, prev_block, far``: points in earlier blocks of both kinds."""
    # Every cell, as sums must also pass through empty ones; their number is below that of the lookups.
    numbers = cells.sparkSession.range(blocks).select(F.col("id").alias("pos_block"))
    every = numbers.select("pos_block", F.explode(F.sequence(F.lit(-1).cast("long"), "pos_block")).alias("prev_block"))
    full = every.join(cells, ["pos_block", "prev_block"], "left")
    earlier = Window.partitionBy("prev_block").orderBy("pos_block").rowsBetween(Window.unboundedPreceding, -1)
    lower = Window.partitionBy("pos_block").orderBy("prev_block").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("over", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return full.select("pos_block", "prev_block", F.coalesce(F.sum("over").over(lower), F.lit(0)).alias("far"))


def reuse_distances(lookups: DataFrame, hot_rows: int = HOT_ROWS, block: int = BLOCK) -> DataFrame:
    """``query, num_results, ts, lookup_id, distance``: distinct other keys looked up since the key last was.

    Null at a key's first lookup. Lookups of one time are ordered by id, then by key; ids are unique within a
    key, and null keys are keys like others. An empty table gives an empty one.
    """
    slim = lookups.select(*_KEYS, "ts", "lookup_id")
    rows = numbered(slim, ["ts", "lookup_id", *_KEYS], "pos")
    rows = staged(scan(rows, _KEYS, ["pos"], last={"prev": F.col("pos")}, inclusive=False, hot_rows=hot_rows), "uses")
    count = rows.count()
    block = max(block, math.isqrt(count) + 1)
    points = rows.select("pos", F.coalesce("prev", F.lit(-1)).alias("prev"))
    points = points.withColumns({n + "_block": F.floor(F.col(n) / block) for n in ("pos", "prev")})
    cells = staged(points.groupBy("pos_block", "prev_block").agg(F.count(F.lit(1)).alias("n")), "cells")
    grid = staged(_grid(cells, count // block + 1), "grid")
    kind = "pos long, prev long, pos_block long, prev_block long, near long"
    near = points.groupBy("pos_block").applyInPandas(_in_block_of_numbers, kind)
    near = near.filter("prev >= 0").groupBy("prev_block").applyInPandas(_in_block_of_prevs, kind)
    told = near.join(grid, ["pos_block", "prev_block"])
    # All up to the key's last lookup have a smaller prev, and none of them lies between.
    told = told.select("pos", (F.col("near") + F.col("far") - F.col("prev") - 1).alias("distance"))
    return rows.join(told, "pos", "left").select(*_KEYS, "ts", "lookup_id", "distance")


def lru_lookups(
    lookups: DataFrame, capacity: int = CACHE_ENTRIES, hot_rows: int = HOT_ROWS, block: int = BLOCK
) -> DataFrame:
    """``reuse_distances`` with ``hit``: whether a cache of ``capacity`` entries still held the key."""
    held = F.coalesce(F.col("distance") < capacity, F.lit(False))
    return reuse_distances(lookups, hot_rows, block).withColumn("hit", held)
