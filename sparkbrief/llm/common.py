"""What the operators of this subpackage share: bounded Arrow slices, document keys, text columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkbrief.staging import staged

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SLICE_BYTES = 4_000_000
BATCH_ROWS = 1_000
MOST_LONGS = 1 << 17  # of a sieve's broadcast bits (1 MB); with more hashes than these can tell apart it lets more rows through
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def slices(batch: pa.RecordBatch, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``most_bytes`` each (one row at least)."""
    rows = batch.num_rows
    step = max(1, int(rows * most_bytes / max(batch.nbytes, 1)))
    for start in range(0, rows, step):
        yield batch.slice(start, min(step, rows - start))


def arrow_map(
    df: DataFrame,
    make: Callable[[pa.RecordBatch], dict[str, list] | list[dict] | pa.RecordBatch],
    schema: str,
    most_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """``mapInArrow`` by slices of bounded bytes; ``make`` returns columns (name to values)."""
    # Batches are counted in rows, and texts are long: few rows keep what lies on both sides of the pipe small.
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH)) <= BATCH_ROWS:
        conf.set(_BATCH, str(BATCH_ROWS))
    target = _arrow_schema(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for part in slices(batch, most_bytes):
                made = make(part)
                columns = [pa.array(made[f.name], type=f.type) for f in target]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    return df.mapInArrow(run, schema)


def _arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def fold_case(text: Column) -> Column:
    """A-Z to a-z, all else as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def doc_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Columns that tell documents apart when ids repeat or are null: the id and a hash of the text.

    Rows that agree in both are the same document given twice and get the same results.
    """
    number, words = F.col(doc_id).cast("long"), F.col(text).cast("string")  # alike, whatever the columns' types are
    return [F.coalesce(number, F.lit(0).cast("long")).alias("_id"), F.xxhash64(number, words).alias("_key")]


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; null where the id is null."""
    return F.crc32(F.col(doc_id).cast("string"))


def bitmap(hashes: DataFrame, most_longs: int) -> Callable[[Column], Column]:
    """A test of whether a 64-bit hash may be among ``hashes(hash)``: true for all of them, and for few others.

    A bit for each hash, in a literal array of at most ``most_longs`` longs (a power of two), which goes to every
    task; with many more hashes than bits the test lets more through and never less.
    """
    distinct = hashes.select("hash").distinct()
    longs, enough = 1 << 10, min(most_longs, distinct.count() * 8)
    while longs < enough:
        longs *= 2
    top = longs.bit_length() - 1
    bit = F.expr("shiftleft(1L, cast(hash & 63 as int))")
    place = F.shiftrightunsigned("hash", 64 - top).cast("int").alias("at")
    rows = distinct.select(place, bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    held = np.zeros(longs, np.int64)
    held[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    bits = F.split(F.lit(",".join(map(str, held.tolist()))), ",").cast("array<bigint>")

    def among(code: Column) -> Column:
        return F.getbit(F.get(bits, F.shiftrightunsigned(code, 64 - top).cast("int")), code.bitwiseAND(63).cast("int")) == 1

    return among


def sieve(hashes: DataFrame, most_longs: int) -> Callable[..., DataFrame]:
    """``rows(df, code)``: the rows of ``df`` whose 64-bit ``code`` may be among ``hashes(hash)``; all that are stay.

    The same bits as ``bitmap``, as a table of at most ``most_longs`` longs (a power of two) that is broadcast, so
    that they are in no plan's text, copies of which the driver keeps. ``rows(df, code, among=False)`` gives the others.
    Join what it gives with an inner or an outer join: a semi or anti join is moved below the broadcast by the optimizer, and
    then shuffles all of ``df``.
    """
    distinct = hashes.select("hash").distinct()
    longs, enough = 1 << 10, min(most_longs, distinct.count() * 8)
    while longs < enough:
        longs *= 2
    top = longs.bit_length() - 1

    def at(code: Column) -> Column:
        return F.shiftrightunsigned(code, 64 - top).cast("int")

    bit = F.expr("shiftleft(1L, cast(hash & 63 as int))")
    bits = distinct.select(at(F.col("hash")).alias("_at"), bit.alias("bit")).groupBy("_at").agg(F.bit_or("bit").alias("_bits"))
    bits = staged(bits, "bits")

    def rows(df: DataFrame, code: Column, among: bool = True) -> DataFrame:
        marked = df.withColumn("_at", at(code)).join(F.broadcast(bits), "_at", "inner" if among else "left")
        hit = F.coalesce(F.getbit("_bits", code.bitwiseAND(63).cast("int")) == 1, F.lit(False))
        return marked.filter(hit if among else ~hit).drop("_at", "_bits")

    return rows
