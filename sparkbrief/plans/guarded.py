"""Searches behind breakers: what the breakers let through, searched and gathered."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbrief.functions import breaker_key
from sparkbrief.operators.breaker import OPEN, breaker_timeline, guard_searches, search_loop
from sparkbrief.operators.ordered import numbered
from sparkbrief.operators.requests import expand
from sparkbrief.operators.research import failed, gather
from sparkbrief.operators.search import search_topk
from sparkbrief.plans.reliability import _LINE_SQL, _READ_SQL, REPORT_AT, RULE
from sparkbrief.plans.search import _EXPANDED_SQL, _HITS_SQL, _requests
from sparkbrief.sources.tables import corpus, spread, table
from sparkbrief.staging import staged


def _subqueries(spark: SparkSession, sf: str) -> DataFrame:
    asked = expand(_requests(spark, sf)).select("item_id", "pos", "query")
    return asked.withColumns(
        {
            "request_id": F.concat_ws("/", F.col("item_id").cast("string"), F.col("pos").cast("string")),
            "key": breaker_key(F.col("query")),
            "ts": F.lit(REPORT_AT).cast("timestamp"),
        }
    )


def _past_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Every event is a past search of some subquery: the breakers' keys are dealt out over the events."""
    keys = staged(numbered(_subqueries(spark, sf).select("key").distinct(), ["key"], "nth"), "keys")
    count = max(1, keys.count())
    return (
        table(spark, sf, "events")
        .join(keys, F.col("event_id") % count == F.col("nth"))
        .select(
            "key", F.col("ts").cast("timestamp").alias("ts"), "event_id",
            (F.col("event_type") != "error").alias("ok"),
        )
    )


def guarded_search(spark: SparkSession, sf: str) -> DataFrame:
    """Searches of every request at the report time; an open breaker makes one fail unsearched."""
    asked = _subqueries(spark, sf)
    # Read twice below: what is searched, and what is told.
    line = staged(breaker_timeline(_past_calls(spark, sf), RULE), "timeline")
    met = staged(guard_searches(asked, line, RULE), "met")
    hits = search_topk(met.filter(F.col("state") != OPEN), corpus(spread(table(spark, sf, "documents"))))
    found = hits.groupBy("query").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "doc_id"))),
            lambda h: F.struct(
                h["doc_id"].cast("string").alias("title"),
                F.lit(None).cast("string").alias("href"),
                F.lit("").alias("body"),
            ),
        ).alias("results")
    )
    searches = met.join(found, "query", "left").withColumn(
        "results", F.when(F.col("error").isNull(), F.col("results"))
    )
    refused = failed(searches).groupBy("item_id").agg(F.count(F.lit(1)).alias("refused"))
    return (
        gather(searches, ["item_id"])
        .join(refused, "item_id", "left")
        .select(
            "item_id",
            F.size("subqueries_used").alias("subqueries"),
            F.coalesce("refused", F.lit(0)).alias("refused"),
            F.concat_ws("\n", "new_errors").alias("errors"),
            F.concat_ws(",", F.transform("hits", lambda h: h["title"])).alias("doc_ids"),
        )
    )


GUARDED_SEARCH_SQL = f"""
WITH RECURSIVE {_HITS_SQL},
keyed AS (SELECT *, 'ddg_search:' || substring(query, 1, 20) AS key FROM expanded),
numbered AS (
  SELECT key AS user_id, event_id, ts, event_type <> 'error' AS ok,
    row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS n
  FROM events JOIN (
    SELECT key, row_number() OVER (ORDER BY encode(key)) - 1 AS nth FROM (SELECT DISTINCT key FROM keyed)) ON event_id % (SELECT count(DISTINCT key) FROM keyed) = nth),
{_LINE_SQL},
newest AS (
  SELECT user_id AS key, arg_max(state, n) AS state, arg_max(last, n) FILTER (WHERE last IS NOT NULL) AS last
  FROM line WHERE n > 0 AND ts <= TIMESTAMP '{REPORT_AT}' GROUP BY user_id),
met AS (
  SELECT item_id, pos, query, {_READ_SQL.format(at=f"TIMESTAMP '{REPORT_AT}'")} = 'open' AS refused
  FROM keyed LEFT JOIN newest USING (key)),
found AS (
  SELECT item_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY pos, rank) AS doc_ids
  FROM met JOIN hits USING (query) WHERE NOT refused GROUP BY item_id)
SELECT item_id, CAST(count(*) AS INTEGER) AS subqueries, count(*) FILTER (WHERE refused) AS refused,
  coalesce(string_agg('查詢「' || query || '」失敗: CircuitBreaker OPEN', chr(10) ORDER BY pos) FILTER (WHERE refused), '') AS errors,
  coalesce(any_value(doc_ids), '') AS doc_ids
FROM met LEFT JOIN found USING (item_id) GROUP BY item_id
"""

def guarded_loop(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a search behind its breaker, which it feeds; keys with many are cut into runs."""
    attempts = _past_calls(spark, sf).withColumn("error", F.concat(F.lit("search failed: "), F.col("event_id").cast("string")))
    return search_loop(staged(attempts, "attempts"), RULE, hot_rows=400, run_rows=2_000).select(
        "event_id", "key", "state", "outcome", "error"
    )


GUARDED_LOOP_SQL = f"""
WITH RECURSIVE {_EXPANDED_SQL},
keyed AS (SELECT DISTINCT 'ddg_search:' || substring(query, 1, 20) AS key FROM expanded),
numbered AS (
  SELECT key AS user_id, event_id, ts, event_type <> 'error' AS ok,
    row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS n
  FROM events JOIN (SELECT key, row_number() OVER (ORDER BY encode(key)) - 1 AS nth FROM keyed)
    ON event_id % (SELECT count(*) FROM keyed) = nth),
{_LINE_SQL},
told AS (
  SELECT event_id, user_id AS key, state, CASE WHEN NOT admitted AND state = 'open' THEN 'refused' WHEN NOT ok THEN 'failed'
    WHEN NOT admitted THEN 'lost' ELSE 'found' END AS outcome
  FROM line WHERE n > 0)
SELECT *, CASE outcome WHEN 'refused' THEN 'CircuitBreaker OPEN' WHEN 'failed' THEN 'search failed: ' || event_id
  WHEN 'lost' THEN 'breaker[' || key || '] HALF_OPEN（試探中），已達上限' END AS error
FROM told
"""

QUERIES = {"guarded_loop": (guarded_loop, GUARDED_LOOP_SQL), "guarded_search": (guarded_search, GUARDED_SEARCH_SQL)}
