"""Time-to-live cache of lookups: which ones hit, and what is stored when."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkbrief.operators.chains import reached_from
from sparkbrief.operators.ordered import HOT_ROWS, asof, cut_runs, scan_runs, split_hot

# Fixed value.
CACHE_SECONDS = 300.0

_KEYS = ["query", "num_results"]


def look_up(stored: int | None, us: int, ttl_us: int) -> tuple[int, bool]:
    """One lookup at time ``us``: time of the entry it leaves behind, and whether it was a hit."""
    if stored is not None and us - stored < ttl_us:
        return stored, True
    return us, False


def _fold(ttl_us: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stored = object(), None
        for rows in batches:
            hits, since = [], []
            columns = [rows.column(n).to_pylist() for n in ("query", "num_results", "us")]
            for query, n, us in zip(*columns, strict=True):
                if (query, n) != key:
                    key, stored = (query, n), None
                stored, hit = look_up(stored, us, ttl_us)
                hits.append(hit)
                since.append(stored)
            told = [pa.array(hits, pa.bool_()), pa.array(since, pa.int64())]
            yield pa.RecordBatch.from_arrays([*rows.columns, *told], names=[*rows.schema.names, "hit", "stored_us"])

    return run


def _whole_keys(lookups: DataFrame, ttl_us: int) -> DataFrame:
    schema = T.StructType(
        lookups.schema.fields
        + [T.StructField("hit", T.BooleanType()), T.StructField("stored_us", T.LongType())]
    )
    ordered = lookups.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "us", "lookup_id")
    return ordered.mapInArrow(_fold(ttl_us), schema)


def _hot_keys(lookups: DataFrame, rows: int, ttl_us: int, run_rows: int) -> DataFrame:
    """Misses of a hot key: each points to the first lookup after its entry's life."""
    order = ["us", "side", "lookup_id"]
    # Lookup ids tell apart the lookups of one key only, so pointers carry the key with them.
    columns = lookups.columns
    lookups = lookups.withColumn("node", F.struct(*_KEYS, "lookup_id"))
    seen = lookups.withColumns({"side": F.lit(1), "target": F.col("node")})
    ends = lookups.withColumns({"us": F.col("us") + ttl_us, "side": F.lit(0)})
    both = seen.unionByName(ends, allowMissingColumns=True)
    pointers = scan_runs(
        cut_runs(both, _KEYS, order, 2 * rows, run_rows),
        _KEYS,
        order,
        last={"next": F.col("target")},
        backward=True,
    ).filter(F.col("side") == 0)
    pointers = pointers.select(F.col("node").alias("id"), "next")
    first = lookups.groupBy(*_KEYS).agg(F.min_by("node", F.struct("us", "lookup_id")).alias("id"))
    span = lookups.agg((F.max("us") - F.min("us")).alias("span")).first()["span"]
    misses = reached_from(first, pointers, span // ttl_us + 1)
    marked = lookups.join(misses.withColumnRenamed("id", "node").withColumn("miss", F.lit(True)), "node", "left")
    runs = cut_runs(marked, _KEYS, ["us", "lookup_id"], rows, run_rows)
    told = scan_runs(
        runs, _KEYS, ["us", "lookup_id"], last={"stored_us": F.when(F.col("miss"), F.col("us"))}
    )
    return told.select(*columns, F.col("miss").isNull().alias("hit"), "stored_us")


def ttl_lookups(
    lookups: DataFrame, ttl_seconds: float = CACHE_SECONDS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Hit or miss of each lookup (``query, num_results, ts, lookup_id``); ids are unique within a key.

    The first lookup of a key misses and stores; its entry serves lookups for
    ``ttl_seconds`` from storing, and a hit does not extend it.
    """
    ttl_us = round(ttl_seconds * 1_000_000)
    slim = lookups.select(*_KEYS, F.unix_micros("ts").alias("us"), "lookup_id")
    cold, hot, hot_total = split_hot(slim, _KEYS, hot_rows)
    folded = _whole_keys(cold, ttl_us)
    if hot is not None:
        folded = folded.unionByName(_hot_keys(hot, hot_total, ttl_us, hot_rows))
    return folded.select(
        *_KEYS,
        F.timestamp_micros("us").alias("ts"),
        "lookup_id",
        "hit",
        F.timestamp_micros("stored_us").alias("stored_at"),
    )


def serve_from_cache(
    requests: DataFrame,
    entries: DataFrame,
    ttl_seconds: float = CACHE_SECONDS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Requests with the entry that serves them, if one is alive.

    ``requests`` has ``request_id, query, num_results, ts``; ``entries`` has
    ``query, num_results, ts, entry_id, results``. A later entry replaces an earlier
    one, so only the latest can serve. An empty result list is served too.
    """
    known = entries.withColumn("stored_at", F.col("ts"))
    found = asof(requests, known, _KEYS, "ts", "entry_id",
                 ["entry_id", "stored_at", "results"], hot_rows)
    age = F.unix_micros("ts") - F.unix_micros("stored_at")
    alive = F.coalesce(age < round(ttl_seconds * 1_000_000), F.lit(False))
    return found.select(
        *requests.columns,
        alive.alias("hit"),
        F.when(alive, F.col("entry_id")).alias("entry_id"),
        F.when(alive, F.col("results")).alias("results"),
    )


def with_fresh_results(served: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cached answers together with those searched anew (``request_id, results``) for the misses."""
    hits = served.filter("hit").select("request_id", "query", "results", F.lit(True).alias("cached"))
    misses = served.filter(~F.col("hit")).select("request_id", "query")
    searched = misses.join(fresh, "request_id").select(
        "request_id", "query", "results", F.lit(False).alias("cached")
    )
    return hits.unionByName(searched)
