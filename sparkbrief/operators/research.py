"""Gather the searches of a request: results in order, error messages, flat hits."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkbrief.functions import json_object, has_key, not_blank, search_error_text

# Fixed values.
BLANK_SUMMARY = "無有效查詢內容"
NO_HITS_SUMMARY = "無搜尋結果"
NO_SUMMARY = "無摘要"
BROKEN_SUMMARY = "摘要無法產生"


def failed(searches: DataFrame) -> DataFrame:
    return searches.filter(F.col("error").isNotNull())


def _in_order(entries: Column) -> Column:
    return F.transform(F.array_sort(entries), lambda e: e["entry"])


def gather(searches: DataFrame, by: list[str]) -> DataFrame:
    """One row per request from one row per subquery (``pos, query, results, error``).

    Adds ``subqueries_used``, ``raw``, ``new_errors`` and ``hits``, all in subquery
    order. A request has at most five subqueries of at most five hits each.
    """
    hit = F.transform(
        F.coalesce(F.col("results"), F.array().cast(searches.schema["results"].dataType)),
        lambda r: F.struct(
            F.coalesce(r["title"], F.lit("")).alias("title"),
            F.coalesce(r["body"], F.lit("")).alias("body"),
        ),
    )
    entry = F.struct(
        "query", "results", "error", hit.alias("hits"),
        search_error_text(F.col("query"), F.col("error")).alias("message"),
    )
    listed = searches.groupBy(*by).agg(
        F.collect_list(F.struct("pos", entry.alias("entry"))).alias("entries")
    )
    entries = _in_order(F.col("entries"))
    return listed.select(
        *by,
        F.transform(entries, lambda e: e["query"]).alias("subqueries_used"),
        F.transform(entries, lambda e: F.struct(e["query"], e["results"], e["error"])).alias("raw"),
        F.filter(F.transform(entries, lambda e: e["message"]), lambda m: m.isNotNull()).alias("new_errors"),
        F.flatten(F.transform(entries, lambda e: e["hits"])).alias("hits"),
    )


def research_summary(hits: Column, response: Column) -> Column:
    """``struct(summary, sources)`` read from a model response, with its fixed fallbacks."""
    doc = json_object(response)
    summary = F.when(has_key(doc, "summary"), F.try_variant_get(doc, "$.summary", "string"))
    sources = F.try_variant_get(doc, "$.sources", "array<string>")
    none = F.array().cast("array<string>")
    return (
        F.when(F.size(hits) == 0, F.struct(F.lit(NO_HITS_SUMMARY).alias("summary"), none.alias("sources")))
        .when(doc.isNull(), F.struct(F.lit(BROKEN_SUMMARY).alias("summary"), none.alias("sources")))
        .otherwise(
            F.struct(
                F.coalesce(summary, F.lit(NO_SUMMARY)).alias("summary"),
                F.coalesce(sources, none).alias("sources"),
            )
        )
    )


def research_report(
    requests: DataFrame, searches: DataFrame, responses: DataFrame | None = None
) -> DataFrame:
    """Research output per request: blank requests and searched ones together.

    ``requests`` has ``request_id, user_input`` and maybe ``errors`` from before;
    ``searches`` as in ``gather`` with ``request_id``; ``responses`` has
    ``request_id, response``.
    """
    none = F.array().cast("array<string>")
    if "errors" not in requests.columns:
        requests = requests.withColumn("errors", none)
    blank = requests.filter(~not_blank(F.col("user_input"))).select(
        "request_id",
        "user_input",
        F.lit(BLANK_SUMMARY).alias("summary"),
        none.alias("sources"),
        none.alias("subqueries_used"),
        F.lit(None).cast("array<string>").alias("errors"),
    )
    found = gather(searches, ["request_id"])
    if responses is None:
        found = found.withColumn("response", F.lit(None).cast("string"))
    else:
        found = found.join(responses.select("request_id", "response"), "request_id", "left")
    asked = requests.filter(not_blank(F.col("user_input"))).join(found, "request_id", "left")
    empty_hits = F.array().cast(found.schema["hits"].dataType)
    empty_raw = F.array().cast(found.schema["raw"].dataType)
    hits = F.coalesce(F.col("hits"), empty_hits)
    told = asked.withColumn("told", research_summary(hits, F.col("response")))
    normal = told.select(
        "request_id",
        "user_input",
        F.col("told.summary").alias("summary"),
        F.col("told.sources").alias("sources"),
        F.coalesce(F.col("subqueries_used"), none).alias("subqueries_used"),
        F.concat(F.coalesce(F.col("errors"), none), F.coalesce(F.col("new_errors"), none)).alias("errors"),
        F.coalesce(F.col("raw"), empty_raw).alias("raw"),
        hits.alias("hits"),
    )
    return normal.unionByName(blank.withColumns({"raw": empty_raw, "hits": empty_hits}))
