"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two grouped minima and two joins, so no component is ever gathered anywhere;
the join against a hub's single minimum row is one that adaptive execution can split. Rounds
are written to the shared folder, which cuts the lineage. About log2 of the longest path rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkbrief.staging import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return (
        both.filter(F.col("b") > F.col("a"))
        .join(least, "a")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = (
        edges.join(least, "a")
        .filter(F.col("b") != F.col("m"))
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
    )
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``edges(a, b)`` (longs) but the least of each component.

    ``component`` is the least node reachable. Loops and edges with a null end are ignored.
    """
    now = staged(
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )

    def state(df: DataFrame):
        row = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        return tuple(row)

    before = state(now)
    while before[0]:
        now = staged(_small_star(_large_star(now)), "edges")
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
