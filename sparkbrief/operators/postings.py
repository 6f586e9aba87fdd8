"""Postings of documents, counted where the documents lie: blocks of one word each, and no shuffle of single postings.

A task holds the words of as many documents as ``TASK_WORDS`` allows, numbers them, counts each document's
words with one sort, and cuts each word's postings into blocks. Only blocks travel on.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkbrief.functions import tokens
from sparkbrief.staging import staged

BLOCK = 128  # postings of a block at most
TASK_WORDS = 2_000_000  # words whose postings a task holds at once; a longer document is held whole
RARE = 16  # a word with fewer postings in a task has one block of them, whatever their density
OUT_ROWS = 10_000


def posting_blocks(corpus: DataFrame, block: int) -> DataFrame:
    """``term, documents, most_tf, least_length, rows(doc_id, length, tf)`` of ``corpus(doc_id, body)``.

    A block holds at most ``block`` postings of a term, alike in density (a power of two apart) if the term is not rare
    there, with the greatest count and the least length among them. A posting is that of a doc_id and a length: rows that repeat
    both are counted together. Rows with a null term count the corpus: ``documents``, and words as ``most_tf``.
    """
    words = corpus.select("doc_id", tokens(F.col("body")).alias("words"))
    lengths = words.select("doc_id", F.coalesce(F.size("words"), F.lit(0)).alias("length"), "words")
    single = lengths.withColumn("times", F.lit(None).cast("long"))
    ids = corpus.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    ids = staged(ids.select(F.struct("doc_id").alias("repeated")), "repeated-ids")
    counts = None
    if not ids.isEmpty():
        same = F.col("doc_id").eqNullSafe(F.col("repeated")["doc_id"])
        again = lengths.join(ids, same, "left_semi")
        counts = again.agg(F.count(F.lit(1)).alias("documents"), F.sum("length").alias("most_tf"))
        merged = (
            again.select("doc_id", "length", F.explode("words").alias("term"))
            .groupBy("term", "doc_id", "length")
            .agg(F.count(F.lit(1)).alias("times"))
            .select("doc_id", "length", F.array("term").alias("words"), "times")
        )
        single = single.join(ids, same, "left_anti").unionByName(merged)
    kind = corpus.schema["doc_id"].dataType.simpleString()
    schema = (
        "term string, documents long, most_tf long, least_length int, "
        f"rows array<struct<doc_id:{kind},length:int,tf:bigint>>"
    )
    target = _arrow_schema(corpus, schema)
    most = TASK_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        many = 0
        for batch in batches:
            held.append(batch)
            many += len(batch.column("words").flatten())
            if many >= most:
                yield from _blocks_of(held, block, target)
                held, many = [], 0
        yield from _blocks_of(held, block, target)

    made = single.mapInArrow(run, schema)
    if counts is None:
        return made
    return made.unionByName(counts, allowMissingColumns=True)


def _arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema))


def _blocks_of(held: list[pa.RecordBatch], block: int, target: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = [b for b in held if b.num_rows]
    if not held:
        return
    ids, length, times = (pa.concat_arrays([b.column(c) for b in held]) for c in ("doc_id", "length", "times"))
    length = length.to_numpy(zero_copy_only=False).astype(np.int64)
    own = times.is_null().to_numpy(zero_copy_only=False)  # documents of their own; the others are counted already
    times = times.fill_null(1).to_numpy(zero_copy_only=False).astype(np.int64)
    total = {"term": [None], "documents": [int(own.sum())], "most_tf": [int(length[own].sum())], "least_length": [None], "rows": [None]}
    yield pa.RecordBatch.from_pydict(total, schema=target)
    coded = pa.concat_arrays([b.column("words").flatten() for b in held]).dictionary_encode()
    if not len(coded):
        return
    many = np.concatenate([b.column("words").value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for b in held])
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pair, tf = np.unique(code * len(ids) + np.repeat(np.arange(len(ids)), many), return_counts=True)
    code, row = np.divmod(pair, len(ids))
    tf = tf * times[row]
    density = np.minimum(np.log2(length[row] / tf).astype(np.int64), 15)
    density[np.bincount(code)[code] < RARE] = 0
    order = np.argsort(code * 16 + density, kind="stable")
    code, row, tf, density = code[order], row[order], tf[order], density[order]
    new = np.r_[True, (code[1:] != code[:-1]) | (density[1:] != density[:-1])]
    place = np.arange(len(code))
    begin = np.flatnonzero((place - np.maximum.accumulate(np.where(new, place, 0))) % block == 0)
    bounds = np.r_[begin, len(code)].astype(np.int32)
    fields = [pa.field("doc_id", ids.type), pa.field("length", pa.int32()), pa.field("tf", pa.int64())]
    postings = pa.StructArray.from_arrays([ids.take(pa.array(row)), pa.array(length[row], pa.int32()), pa.array(tf)], fields=fields)
    columns = [
        coded.dictionary.take(pa.array(code[begin])),
        pa.array(np.diff(bounds).astype(np.int64)),
        pa.array(np.maximum.reduceat(tf, begin)),
        pa.array(np.minimum.reduceat(length[row], begin), pa.int32()),
        pa.ListArray.from_arrays(pa.array(bounds), postings),
    ]
    made = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)
    for start in range(0, len(begin), OUT_ROWS):
        yield made.slice(start, OUT_ROWS)
