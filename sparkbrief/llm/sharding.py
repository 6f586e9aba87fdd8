"""Shards of near-equal bytes by sampled splitters.

Records are ordered by a hash of their text and then their id, so equal texts are
neighbours. A sample weighted by size gives quantile boundaries that range-partition that
order; ranges that hold too many bytes are cut by further samples of their own records, at ids
inside a text if need be. Running sums inside ranges and one total per range then place each
record exactly: shards are equal to within one record, however the sample fell.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkbrief.llm.common import arrow_map
from sparkbrief.staging import staged

SHARDS = 24
RANGE_ROWS = 1_000_000
LEAST_RANGES, MOST_RANGES = 192, 20_000
SAMPLE = 24  # sampled keys per range; at most MOST_RANGES * SAMPLE come to the driver, about
ROUNDS = 3  # of cutting overfull ranges; what is left over only makes a task larger


def _keys(order: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Pairs of signed longs as 16 bytes that sort like the pairs."""
    pair = np.stack([order, doc], 1).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(pair.astype(">u8")).view("S16").ravel()


def _ranges(rows: DataFrame, splitters: np.ndarray) -> DataFrame:
    columns = rows.columns

    def make(part: pa.RecordBatch) -> dict[str, list]:
        order, doc = (part.column(n).to_numpy(zero_copy_only=False) for n in ("_order", "_doc"))
        kept = {n: part.column(n) for n in columns}
        return kept | {"_range": np.searchsorted(splitters, _keys(order, doc), side="right")}

    return arrow_map(rows, make, ", ".join(f"{n} long" for n in [*columns, "_range"]))


def _draw(rows: DataFrame, per_byte, seed: int) -> np.ndarray:
    """Keys drawn with a probability in proportion to size, by a hash: the same on every try."""
    luck = F.pmod(F.xxhash64("_order", "_doc", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    drawn = rows.filter(luck < F.col("size") * per_byte).select("_order", "_doc").toPandas()
    return np.sort(_keys(drawn["_order"].to_numpy(np.int64), drawn["_doc"].to_numpy(np.int64)))


def _quantiles(keys: np.ndarray, parts: int) -> np.ndarray:
    at = (np.arange(1, parts) * len(keys)) // parts
    return np.unique(keys[at]) if len(keys) else keys


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row of ``docs(doc_id, text)``.

    ``size`` is the text's UTF-8 bytes plus 8 (a null text has none, and checksum 0). The law is
    ``bytes``: a record is in the shard in which its middle byte falls when all are laid end to
    end in order. ``slot`` counts a shard's records from 0; ``grown_shard`` is null under this law.
    Rows that repeat, or share id and text, each have a slot. A null id sorts as 0 and stays null.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_crc32"),
        F.xxhash64("text").alias("_order"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_doc"),
    )
    rows = staged(rows, "records")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = min(MOST_RANGES, max(LEAST_RANGES, math.ceil(count / RANGE_ROWS)))
    aim = max(1.0, total / ranges)
    splitters = _quantiles(_draw(rows, SAMPLE / aim, 0), ranges)
    for turn in range(ROUNDS + 1):
        placed = staged(_ranges(rows, splitters), "ranges")
        sums = placed.groupBy("_range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).toPandas()
        full = sums[(sums["bytes"] > 2 * aim) & (sums["rows"] > 1)]
        if turn == ROUNDS or not len(full):
            break
        inside = placed.filter(F.col("_range").isin([int(r) for r in full["_range"]]))
        more = _draw(inside, 4 * SAMPLE / aim, turn + 1)
        where = np.searchsorted(splitters, more, side="right")
        cuts = [splitters]
        for number, size in zip(full["_range"], full["bytes"], strict=True):
            cuts.append(_quantiles(more[where == number], math.ceil(size / aim)))
        wider = np.unique(np.concatenate(cuts))
        if len(wider) == len(splitters):
            break
        splitters = wider
    sums = sums.sort_values("_range")
    starts = rows.sparkSession.createDataFrame(
        [
            (int(r), int(b), int(n))
            for r, b, n in zip(
                sums["_range"],
                sums["bytes"].cumsum() - sums["bytes"],
                sums["rows"].cumsum() - sums["rows"],
                strict=True,
            )
        ],
        "_range long, _bytes_before long, _rows_before long",
    )
    inside = Window.partitionBy("_range").orderBy("_order", "_doc", "doc_id", "size", "text_crc32")
    # One row per range: MOST_RANGES and the cuts of overfull ones bound what is broadcast.
    numbered = placed.join(F.broadcast(starts), "_range").withColumns(
        {
            "_at": F.col("_bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
            "_row": F.col("_rows_before") + F.row_number().over(inside) - 1,
        }
    )
    middle = 2 * F.col("_at") - F.col("size")  # twice the middle byte
    number = F.least(F.lit(shards - 1), F.floor(middle * shards / (2 * max(total, 1)))).cast("int")
    numbered = staged(
        numbered.select("doc_id", "size", "text_crc32", number.alias("shard"), "_row"), "numbered"
    )
    firsts = numbered.groupBy("shard").agg(F.min("_row").alias("_first"))  # one row per shard
    return numbered.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_row") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
