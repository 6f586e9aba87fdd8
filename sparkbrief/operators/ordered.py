"""Running values along an order within a key, also for keys too large for one task.

A plain window puts each key into one task. Keys above ``hot_rows`` rows are
instead cut into runs by a range partitioning on (key, order): a window works
inside each run, and one small row per (run, key) carries the value across the
cut. The rows of the result do not depend on which way a key took.
"""

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkbrief.staging import staged

HOT_ROWS = 5_000_000
PART_ROWS = 250_000
RUN = "_run"


def split_hot(
    df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame | None, int]:
    """Rows of ordinary keys, rows of hot keys (None if there are none), and the hot row count."""
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > hot_rows)
    hot = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], "_rows")
    hot = staged(hot, "hot-keys")
    hot_total = hot.agg(F.sum("_rows")).first()[0]
    if hot_total is None:
        return df, None, 0
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(hot[f"_hot_{k}"]) for k in keys])
    return (
        df.join(hot, same, "left_anti"),
        df.join(hot, same, "left_semi"),
        int(hot_total),
    )


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: each row's place, from 0, in ``order``, which must tell all rows apart.

    Parts of a range partitioning are numbered by themselves; one row per part carries what lies before it.
    """
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = staged(laid.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "numbered")
    parts = laid.groupBy("_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over a row per part
    parts = parts.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_add"))
    return laid.join(parts, "_part").withColumn(name, F.col("_at") + F.col("_add")).drop("_part", "_at", "_add")


def cut_runs(df: DataFrame, keys: list[str], order: list[str], rows: int, run_rows: int) -> DataFrame:
    """Rows in (key, order) cut into runs of about ``run_rows``; the run number is stored with them.

    A range partitioning samples rows by its number of parts, and each part is a task, so parts are of at least
    ``PART_ROWS``; a part is cut into runs by its rows' places. Run numbers ascend in (key, order).
    """
    runs = max(1, math.ceil(rows / run_rows))
    parts = max(1, min(runs, math.ceil(rows / PART_ROWS)))
    ranged = df.repartitionByRange(parts, *keys, *order)
    if parts == runs:
        return staged(ranged.withColumn(RUN, F.spark_partition_id().cast("long")), "runs")
    # The part's number is in the upper bits, the row's place in the lower ones.
    laid = ranged.sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    place = F.col("_at").bitwiseAND((1 << 33) - 1)
    within = F.floor(place / F.lit(run_rows)).cast("long")
    return staged(laid.withColumn(RUN, F.col("_at") - place + within).drop("_at"), "runs")


def _window(by: list[str], order: list[str], inclusive: bool, backward: bool):
    ordering = [F.col(c).desc() if backward else F.col(c).asc() for c in order]
    return (
        Window.partitionBy(*by)
        .orderBy(*ordering)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )


def _scan_whole(df, by, order, last, total, inclusive, backward) -> DataFrame:
    over = _window(by, order, inclusive, backward)
    columns = {out: F.last(value, ignorenulls=True).over(over) for out, value in last.items()}
    columns |= {out: F.coalesce(F.sum(value).over(over), F.lit(0)) for out, value in total.items()}
    return df.withColumns(columns)


def scan_runs(
    runs: DataFrame,
    keys: list[str],
    order: list[str],
    last: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None,
    inclusive: bool = True,
    backward: bool = False,
) -> DataFrame:
    """``scan`` over the output of ``cut_runs``."""
    last, total = last or {}, total or {}
    pick = F.min_by if backward else F.max_by
    within = _scan_whole(runs, [RUN, *keys], order, last, total, inclusive, backward)
    ends = runs.groupBy(RUN, *keys).agg(
        *[
            pick(value, F.when(value.isNotNull(), F.struct(*order))).alias(f"_end_{out}")
            for out, value in last.items()
        ],
        *[F.sum(value).alias(f"_end_{out}") for out, value in total.items()],
    )
    before = (
        Window.partitionBy(*keys)
        .orderBy(F.col(RUN).desc() if backward else F.col(RUN).asc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = ends.select(
        F.col(RUN).alias("_c_run"),
        *[F.col(k).alias(f"_c_{k}") for k in keys],
        *[
            F.last(F.col(f"_end_{out}"), ignorenulls=True).over(before).alias(f"_c_last_{out}")
            for out in last
        ],
        *[F.sum(f"_end_{out}").over(before).alias(f"_c_sum_{out}") for out in total],
    )
    # One row per run and hot key in it; written, so that the planner sees how small it is.
    carry = staged(carry, "carried")
    same = reduce(
        lambda a, b: a & b,
        [within[RUN] == carry["_c_run"]] + [within[k].eqNullSafe(carry[f"_c_{k}"]) for k in keys],
    )
    joined = within.join(carry, same, "left")
    joined = joined.withColumns(
        {out: F.coalesce(F.col(out), F.col(f"_c_last_{out}")) for out in last}
        | {out: F.col(out) + F.coalesce(F.col(f"_c_sum_{out}"), F.lit(0)) for out in total}
    )
    return joined.select(*runs.columns, *last, *total)


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    last: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None,
    inclusive: bool = True,
    backward: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add running columns per key.

    ``last`` gives the latest non-null value, ``total`` the running sum, up to the
    row itself (``inclusive``) or the row before it. ``backward`` runs from the end.
    (keys, order) must tell rows apart. Counting the keys reads ``df`` once more, so
    stage a ``df`` that is costly to compute and whose unused columns cannot be pruned.
    """
    last, total = last or {}, total or {}
    cold, hot, hot_total = split_hot(df, keys, hot_rows)
    result = _scan_whole(cold, keys, order, last, total, inclusive, backward)
    if hot is None:
        return result
    runs = cut_runs(hot, keys, order, hot_total, hot_rows)
    return result.unionByName(
        scan_runs(runs, keys, order, last, total, inclusive, backward).drop(RUN)
    )


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    ts: str,
    right_id: str,
    values: list[str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Each left row with ``values`` of the latest right row of its key at or before its time.

    Right rows of one time are ordered by ``right_id`` in its own type (text as text, numbers as numbers).
    """
    left_columns = left.columns
    id_type = right.schema[right_id].dataType
    probes = left.select(
        *keys,
        F.col(ts).alias("_ts"),
        F.lit(1).alias("_side"),
        F.lit(None).cast(id_type).alias("_id"),
        F.struct(*left_columns).alias("_left"),
    )
    facts = right.select(
        *keys,
        F.col(ts).alias("_ts"),
        F.lit(0).alias("_side"),
        F.col(right_id).alias("_id"),
        F.struct(*values).alias("_right"),
    )
    both = probes.unionByName(facts, allowMissingColumns=True)
    found = scan(both, keys, ["_ts", "_side", "_id"], last={"_seen": F.col("_right")}, hot_rows=hot_rows)
    return found.filter(F.col("_side") == 1).select(
        *[F.col(f"_left.{c}").alias(c) for c in left_columns],
        *[F.col(f"_seen.{v}").alias(v) for v in values],
    )
