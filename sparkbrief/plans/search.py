"""Questions of the benchmark table, split into subqueries and searched over the documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbrief.functions import strip
from sparkbrief.operators.requests import expand
from sparkbrief.operators.research import research_report
from sparkbrief.operators.search import search_topk
from sparkbrief.operators.search_index import extend_index, search_index
from sparkbrief.sources.tables import corpus, spread, table
from sparkbrief.staging import stage_path, staged


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    """A request per item; its sentences are the model's subqueries, some responses are unusable."""
    sentences = F.filter(
        F.transform(F.split("text", r"[.\n]+"), strip), lambda s: s != ""
    )
    kind = F.col("item_id") % 10
    response = (
        F.when(kind == 8, F.lit('["x"] here you are'))
        .when(kind == 9, F.lit("[]"))
        .otherwise(F.to_json(sentences))
    )
    asked = F.when(F.col("item_id") % 13 == 12, F.lit(" \t")).otherwise(F.col("text"))
    return table(spark, sf, "benchmark").select(
        "item_id", asked.alias("user_input"), response.alias("response")
    )


def subquery_expansion(spark: SparkSession, sf: str) -> DataFrame:
    return expand(_requests(spark, sf)).select("item_id", "pos", "query")


_EXPANDED_SQL = r"""
sentences AS (
  SELECT item_id, text, item_id % 10 AS kind, item_id % 13 = 12 AS blank,
    list_filter(list_transform(string_split_regex(text, '[.\n]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')),
                lambda s: s <> '') AS parts
  FROM benchmark),
listed AS (
  SELECT item_id, text, blank, kind, CASE WHEN blank OR kind = 9 THEN [] WHEN kind = 8
    THEN [regexp_replace(text, '^\s+|\s+$', '', 'g')] ELSE parts[1:5] END AS queries FROM sentences),
expanded AS (
  SELECT item_id, CAST(i - 1 AS INTEGER) AS pos, queries[i] AS query
  FROM (SELECT item_id, queries, unnest(range(1, len(queries) + 1)) AS i FROM listed))
"""

SUBQUERY_EXPANSION_SQL = f"WITH {_EXPANDED_SQL} SELECT item_id, pos, query FROM expanded"


def search_topk_query(spark: SparkSession, sf: str) -> DataFrame:
    asked = expand(_requests(spark, sf)).select("item_id", "pos", "query")
    documents = corpus(spread(table(spark, sf, "documents")))
    hits = search_topk(asked, documents)
    return asked.join(hits, "query").select("item_id", "pos", "rank", "doc_id", "score")


def search_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The same search over a stored index, which the documents enter in two deltas."""
    asked = expand(_requests(spark, sf)).select("item_id", "pos", "query")
    documents = corpus(spread(table(spark, sf, "documents")))
    path = stage_path(spark, "index")
    for half in (0, 1):
        extend_index(documents.filter(F.pmod("doc_id", F.lit(2)) == half), path)
    hits = search_index(spark, asked, path)
    return asked.join(hits, "query").select("item_id", "pos", "rank", "doc_id", "score")


_HITS_SQL = rf"""
{_EXPANDED_SQL},
doc_words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '') AS words
  FROM documents),
stats AS (SELECT count(*)::DOUBLE AS n, sum(len(words))::DOUBLE / count(*)::DOUBLE AS average FROM doc_words),
tf AS (
  SELECT doc_id, length, term, count(*)::DOUBLE AS tf
  FROM (SELECT doc_id, len(words)::DOUBLE AS length, unnest(words) AS term FROM doc_words)
  GROUP BY doc_id, length, term),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
query_terms AS (
  SELECT DISTINCT query, term
  FROM (SELECT query, unnest(string_split_regex(lower(query), '[^\p{{L}}\p{{N}}]+')) AS term
        FROM (SELECT DISTINCT query FROM expanded))
  WHERE term <> ''),
scores AS (
  SELECT query, doc_id, sum(CAST(floor(1000000.0::DOUBLE * (
      ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) *
      (tf * (1.2::DOUBLE + 1.0::DOUBLE) /
       (tf + 1.2::DOUBLE * (1.0::DOUBLE - 0.75::DOUBLE + 0.75::DOUBLE * length / average))))) AS BIGINT)) AS score
  FROM query_terms JOIN tf USING (term) JOIN df USING (term), stats
  GROUP BY query, doc_id),
hits AS (
  SELECT query, doc_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank
  FROM scores WHERE score > 0 QUALIFY rank <= 5)
"""

SEARCH_TOPK_SQL = f"""
WITH {_HITS_SQL}
SELECT item_id, pos, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
FROM expanded JOIN hits USING (query)
"""


def search_report(spark: SparkSession, sf: str) -> DataFrame:
    """Expansion, search, failed searches, gathering and summary of every request."""
    requests = _requests(spark, sf).withColumn("request_id", F.col("item_id").cast("string"))
    asked = expand(requests)
    breaks = (F.col("item_id") % 3 == 0) & (F.col("pos") == 1)
    error = F.when(breaks, F.lit("network error"))
    searched = asked.filter(~breaks)
    documents = corpus(spread(table(spark, sf, "documents")))
    # Written, so that the planner sees how few rows meet the documents and moves those, not the bodies.
    hits = staged(search_topk(searched, documents), "hits")
    # Only hits meet the documents; the join is by document, not by query.
    found = hits.join(documents, "doc_id").groupBy("query").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", F.struct("title", "href", "body").alias("hit")))),
            lambda r: r["hit"],
        ).alias("results")
    )
    none = F.array().cast(found.schema["results"].dataType)
    searches = (
        asked.withColumn("error", error)
        .join(found, "query", "left")
        .withColumn("results", F.when(breaks, none).otherwise(F.coalesce("results", none)))
    )
    kind = F.col("item_id") % 4
    about = F.concat(F.lit("about "), F.col("request_id"))
    responses = requests.select(
        "request_id",
        F.when(kind == 0, F.lit("no JSON"))
        .when(kind == 1, F.lit('{"sources": ["a", "b"]}'))
        .otherwise(F.to_json(F.struct(about.alias("summary"), F.array(F.lit("s")).alias("sources"))))
        .alias("response"),
    )
    earlier = F.when(kind == 1, F.array(F.lit("earlier"))).otherwise(F.array().cast("array<string>"))
    report = research_report(requests.select("request_id", "user_input", earlier.alias("errors")), searches, responses)
    return report.select(
        F.col("request_id").cast("long").alias("item_id"),
        "summary",
        F.concat_ws(",", "sources").alias("sources"),
        F.concat_ws("\n", "subqueries_used").alias("subqueries"),
        F.when(F.col("errors").isNotNull(), F.concat_ws("\n", "errors")).alias("errors"),
        F.size("hits").alias("n_hits"),
        F.concat_ws("|", F.transform("hits", lambda h: h["title"])).alias("titles"),
        F.aggregate(
            "hits", F.lit(0).cast("long"), lambda n, h: n + F.char_length(h["body"])
        ).alias("body_chars"),
    )


SEARCH_REPORT_SQL = rf"""
WITH {_HITS_SQL},
tried AS (SELECT *, item_id % 3 = 0 AND pos = 1 AS broken FROM expanded),
gathered AS (
  SELECT item_id, string_agg(query, chr(10) ORDER BY pos) AS subqueries,
    coalesce(string_agg('查詢「' || query || '」失敗: network error', chr(10) ORDER BY pos) FILTER (WHERE broken), '') AS errors
  FROM tried GROUP BY item_id),
flat AS (
  SELECT item_id, count(*) AS n_hits, sum(length(text)) AS body_chars,
    string_agg(split_part(text, chr(10), 1), '|' ORDER BY pos, rank) AS titles
  FROM tried JOIN hits USING (query) JOIN documents USING (doc_id) WHERE NOT broken GROUP BY item_id)
SELECT item_id,
  CASE WHEN blank THEN '無有效查詢內容' WHEN n_hits IS NULL THEN '無搜尋結果' WHEN item_id % 4 = 0 THEN '摘要無法產生'
    WHEN item_id % 4 = 1 THEN '無摘要' ELSE 'about ' || item_id END AS summary,
  CASE WHEN blank OR n_hits IS NULL OR item_id % 4 = 0 THEN '' WHEN item_id % 4 = 1 THEN 'a,b' ELSE 's' END AS sources,
  coalesce(subqueries, '') AS subqueries,
  CASE WHEN NOT blank THEN concat_ws(chr(10), CASE WHEN item_id % 4 = 1 THEN 'earlier' END, nullif(errors, '')) END AS errors,
  CAST(coalesce(n_hits, 0) AS INTEGER) AS n_hits, coalesce(titles, '') AS titles,
  CAST(coalesce(body_chars, 0) AS BIGINT) AS body_chars
FROM listed LEFT JOIN gathered USING (item_id) LEFT JOIN flat USING (item_id)
"""

QUERIES = {
    "subquery_expansion": (subquery_expansion, SUBQUERY_EXPANSION_SQL),
    "search_topk": (search_topk_query, SEARCH_TOPK_SQL),
    "search_indexed": (search_indexed, SEARCH_TOPK_SQL),
    "search_report": (search_report, SEARCH_REPORT_SQL),
}
