"""Follow pointers from a start row to the end of its chain, by doubling.

Each round joins the pointer table with itself, so a chain of n steps takes
about log2(n) joins on row ids, and no task walks a chain row by row.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkbrief.staging import staged


def reached_from(roots: DataFrame, pointers: DataFrame, longest: int) -> DataFrame:
    """Ids (``id``) on the chains that start at ``roots`` and follow ``pointers(id, next)``.

    ``longest`` is an upper bound of the number of steps in a chain.
    """
    jumps = [staged(pointers.filter(F.col("next").isNotNull()).select("id", "next"), "jump")]
    while 2 ** len(jumps) <= longest:
        ahead = jumps[-1].select(F.col("id").alias("next"), F.col("next").alias("far"))
        doubled = jumps[-1].join(ahead, "next").select("id", F.col("far").alias("next"))
        doubled = staged(doubled, "jump")
        if doubled.isEmpty():
            break
        jumps.append(doubled)
    reached = staged(roots.select("id"), "reached")
    for jump in reversed(jumps):
        step = reached.join(jump, "id").select(F.col("next").alias("id"))
        reached = staged(reached.union(step).distinct(), "reached")
    return reached
