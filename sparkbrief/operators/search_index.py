"""A stored index for text search: postings by term in blocks, extended by deltas.

A block holds at most ``BLOCK`` postings of one term, with the greatest count and the least document length
among them, which bound what any of them can weigh whatever the corpus' average length becomes. A frequent term's
postings are dealt to blocks by how dense the term is in the document, so that the blocks' bounds differ and
weak ones can be skipped; it has many blocks, none of them large. Blocks are cut where the documents lie. Files are
split by a hash of the term and sorted by it, so a search reads only what may hold its words.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbrief.operators.postings import BLOCK, posting_blocks
from sparkbrief.operators.search import HITS_PER_QUERY, ranked_hits
from sparkbrief.staging import staged

BUCKETS = 64


def _bucket(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _deltas(spark: SparkSession, path: str) -> DataFrame | None:
    """``delta, documents, words, buckets, id_type`` of what has been written whole: its counts are written last."""
    try:
        return spark.read.parquet(f"{path}/counts")
    except AnalysisException:
        return None


def extend_index(corpus: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """Add the documents of ``corpus(doc_id, body)`` to the index at ``path`` as one more delta; gives its number.

    Documents must be new to the index. A reader sees a delta once it is whole; what a lost writer
    left is overwritten by the next. One writer at a time. The first call settles ``buckets``.
    """
    spark = corpus.sparkSession
    known = _deltas(spark, path)
    number = 0
    if known is not None:
        number, buckets = known.agg(F.max("delta") + 1, F.max("buckets")).first()
    blocks = staged(posting_blocks(corpus, BLOCK), "index-parts")
    of_terms = blocks.filter("term is not null").withColumn("bucket", _bucket(F.col("term"), buckets))
    laid = of_terms.repartition("bucket").sortWithinPartitions("bucket", "term")
    laid.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks/delta={number}")
    counts = blocks.filter("term is null").agg(
        F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("most_tf"), F.lit(0)).alias("words")
    )
    kind = corpus.schema["doc_id"].dataType.simpleString()
    counts = counts.withColumns({"buckets": F.lit(buckets), "id_type": F.lit(kind)})
    counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/counts/delta={number}")
    return number


def search_index(spark: SparkSession, queries: DataFrame, path: str, k: int = HITS_PER_QUERY) -> DataFrame:
    """``search_topk`` over the documents of the index at ``path``: the same rows, without reading the documents."""
    known = _deltas(spark, path)
    if known is None:
        raise ValueError(f"no index at {path}")
    documents, words, buckets, kind = known.agg(
        F.sum("documents"), F.sum("words"), F.max("buckets"), F.max("id_type")
    ).first()
    numbers = [r["delta"] for r in known.select("delta").collect()]  # one a call of extend_index
    # Named, as a delta without words has no file to read the columns from.
    fields = f"bucket int, term string, most_tf long, least_length int, rows array<struct<doc_id:{kind},length:int,tf:bigint>>"
    reader = spark.read.schema(fields).option("basePath", f"{path}/blocks")
    index = reader.parquet(*[f"{path}/blocks/delta={n}" for n in numbers])

    def read(vocabulary: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
        asked = vocabulary.withColumn("bucket", _bucket(F.col("term"), buckets))
        # The words' buckets, at most ``buckets`` numbers, prune files; their order inside prunes the rest.
        places = [r["bucket"] for r in asked.select("bucket").distinct().collect()]
        met = index.filter(F.col("bucket").isin(places)).join(asked, ["bucket", "term"])
        blocks = staged(met.select("tid", "most_tf", "least_length", "rows"), "index-blocks")
        return blocks.select("tid", F.inline("rows")), blocks, documents, words

    return ranked_hits(queries, read, index.schema["rows"].dataType.elementType["doc_id"].dataType, k)
