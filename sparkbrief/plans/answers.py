"""From requests to answers: every step of a request, for a whole table of them at once."""

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbrief.functions import not_blank, strip
from sparkbrief.operators.infer import batch_infer
from sparkbrief.operators.positions import numbers_json, params_from_text, position_levels
from sparkbrief.operators.requests import expand
from sparkbrief.operators.research import gather, research_report
from sparkbrief.operators.responses import (
    document_context,
    document_output,
    finance_output,
    finance_payload,
    synthesis_payload,
    synthesizer_update,
)
from sparkbrief.operators.search import search_topk
from sparkbrief.plans.positions import sql_round2
from sparkbrief.plans.search import _HITS_SQL
from sparkbrief.sources.tables import corpus, spread, table
from sparkbrief.staging import staged

Model = Callable[[str], str]


def search_results(asked: DataFrame, documents: DataFrame) -> DataFrame:
    """Add the hits of each ``query`` as ``results``, best first; none are an empty list."""
    # Written, so that the planner sees how few rows meet the documents and moves those, not the bodies.
    hits = staged(search_topk(asked, documents), "hits").join(documents, "doc_id")
    listed = hits.groupBy("query").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", F.struct("title", "href", "body").alias("hit")))),
            lambda r: r["hit"],
        ).alias("results")
    )
    none = F.array().cast(listed.schema["results"].dataType)
    return asked.join(listed, "query", "left").withColumn("results", F.coalesce("results", none))


def research(requests: DataFrame, documents: DataFrame, split: Model, summarize: Model) -> DataFrame:
    """Research output per request (``request_id, user_input``)."""
    wordy = requests.filter(not_blank(F.col("user_input"))).withColumn("asked", strip(F.col("user_input")))
    split_up = batch_infer(wordy, "asked", split).select("request_id", "user_input", "response")
    asked = expand(split_up).withColumn("error", F.lit(None).cast("string"))
    searches = staged(search_results(asked, documents), "searches")
    found = gather(searches, ["request_id", "user_input"]).filter(F.size("hits") > 0)
    payload = F.to_json(
        F.struct("user_input", F.col("subqueries_used").alias("subqueries"), F.col("hits").alias("raw_results"))
    )
    asked = staged(found.select("request_id", payload.alias("payload")), "research-asked")
    told = batch_infer(asked, "payload", summarize)
    return research_report(requests, searches, told.select("request_id", "response"))


def finance(requests: DataFrame, interpret: Model) -> DataFrame:
    """Numbers that a request names, their levels, and what the model says about them."""
    read = params_from_text(requests).withColumnRenamed("status", "param_status")
    leveled = position_levels(read)
    numbers = numbers_json(leveled.withColumn("has_params", F.col("param_status") == "ok"))
    asked = numbers.select(
        "request_id", "numbers", finance_payload(F.col("user_input"), F.col("numbers")).alias("payload")
    )
    told = batch_infer(staged(asked, "finance-asked"), "payload", interpret)
    return told.select("request_id", "numbers", finance_output(F.col("response")).alias("said"))


def document(outputs: DataFrame, write: Model) -> DataFrame:
    """Document of each request (``request_id, user_input, research, finance`` as JSON), as JSON."""
    context = document_context(F.col("user_input"), F.col("research"), F.col("finance"))
    asked = staged(outputs.select("request_id", context.alias("context")), "document-asked")
    told = batch_infer(asked, "context", write)
    return told.select("request_id", F.to_json(document_output(F.col("response"))).alias("document"))


def answer_requests(requests: DataFrame, documents: DataFrame, models: dict[str, Model]) -> DataFrame:
    """Answer, outputs, errors and end status of each request (``request_id, user_input``, maybe ``errors``).

    ``models`` has a function from prompt to response for ``subqueries``, ``research``,
    ``finance``, ``document`` and ``synthesizer``. A request fails if its closing call fails.
    """
    found = research(requests, documents, models["subqueries"], models["research"])
    found = found.select(
        "request_id",
        "user_input",
        "errors",
        F.to_json(F.struct("summary", "sources", "subqueries_used")).alias("research"),
    )
    priced = finance(requests, models["finance"]).select(
        "request_id",
        F.to_json(F.struct(F.try_parse_json("numbers").alias("numbers"), "said.summary", "said.risk_notes"))
        .alias("finance"),
    )
    both = staged(found.join(priced, "request_id", "left"), "researched")
    written = both.join(document(both, models["document"]), "request_id", "left")
    agents = ("research", "finance", "document")
    outputs = F.create_map(*[x for a in agents for x in (F.lit(a), F.col(a))])
    closing = written.withColumn("agent_outputs", F.map_filter(outputs, lambda _, v: v.isNotNull()))
    closing = closing.withColumn(
        "payload", synthesis_payload(F.col("user_input"), F.col("agent_outputs"), F.col("errors"))
    )
    told = batch_infer(staged(closing, "closing"), "payload", models["synthesizer"])
    kept = told.select(
        "request_id",
        "agent_outputs",
        "errors",
        F.when(F.col("error").isNull(), "done").otherwise("error").alias("status"),
        F.col("error").alias("error_detail"),
        "response",
    )
    return synthesizer_update(kept, "response")


def _split(prompt: str) -> str:
    return json.dumps([s for s in (p.strip() for p in re.split(r"[.\n]+", prompt)) if s])


def _summarize(prompt: str) -> str:
    return json.dumps({"summary": f"{len(json.loads(prompt)['raw_results'])} hits", "sources": []})


def _interpret(prompt: str) -> str:
    numbers = json.loads(prompt)["calculated_numbers"]
    return json.dumps({"interpretation": f"up {numbers['upside_pct']}"}) if numbers else "no numbers"


def _write(prompt: str) -> str:
    lines = prompt.split("\n")
    return json.dumps({"title": lines[0][:20], "summary": f"{len(lines)} lines", "sections": []})


def _close(prompt: str) -> str:
    seen = json.loads(prompt)
    said = [seen["agent_outputs"][agent]["summary"] for agent in ("research", "finance")]
    pages = seen["agent_outputs"]["document"]["summary"]
    return f"  {said[0]}; {said[1]}; {pages.split()[1]}; {len(seen['errors'])} errors\n"


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as requests, some of which name prices; rules stand in for the models."""
    item = F.col("item_id")
    priced = F.concat(
        F.col("text"), F.lit("\n成本價 "), (100 + item).cast("string"), F.lit("，壓力 321.5，支撐 90")
    )
    requests = table(spark, sf, "benchmark").select(
        item.cast("string").alias("request_id"),
        F.when(item % 5 == 4, F.lit(" ")).when(item % 3 == 0, priced).otherwise(F.col("text")).alias("user_input"),
        F.when(item % 4 == 1, F.array(F.lit("earlier"))).otherwise(F.array().cast("array<string>")).alias("errors"),
    )
    models = {"subqueries": _split, "research": _summarize, "finance": _interpret, "document": _write, "synthesizer": _close}
    told = answer_requests(requests, corpus(spread(table(spark, sf, "documents"))), models)
    return told.select(
        F.col("request_id").cast("long").alias("item_id"), "final_answer", "status", "next_agent",
        F.concat_ws(",", F.array_sort(F.map_keys("agent_outputs"))).alias("outputs"),
    )


_ANSWER_HITS_SQL = _HITS_SQL.split("doc_words AS", 1)[1]

ANSWERS_SQL = rf"""
WITH asked AS (
  SELECT item_id, item_id % 5 = 4 AS blank, item_id % 3 = 0 AS priced,
    CASE WHEN item_id % 3 = 0 THEN text || chr(10) || '成本價 ' || (100 + item_id) || '，壓力 321.5，支撐 90' ELSE text END AS text
  FROM benchmark),
listed AS (
  SELECT item_id, list_filter(list_transform(string_split_regex(text, '[.\n]+'),
      lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')[1:5] AS queries
  FROM asked WHERE NOT blank),
expanded AS (
  SELECT item_id, i - 1 AS pos, queries[i] AS query
  FROM (SELECT item_id, queries, unnest(range(1, len(queries) + 1)) AS i FROM listed)),
doc_words AS {_ANSWER_HITS_SQL},
found AS (SELECT item_id, count(*) AS n FROM expanded JOIN hits USING (query) GROUP BY item_id),
gains AS (
  SELECT *, (321.5::DOUBLE - (100 + item_id)::DOUBLE) / (100 + item_id)::DOUBLE * 100.0::DOUBLE AS up FROM asked),
said AS (
  SELECT item_id, blank, CASE WHEN blank THEN '無有效查詢內容' WHEN n IS NULL THEN '無搜尋結果' ELSE n || ' hits' END AS research,
    CASE WHEN priced AND NOT blank THEN 'up ' || CAST({sql_round2("up")} AS VARCHAR) ELSE 'no numbers' END AS finance
  FROM gains LEFT JOIN found USING (item_id))
SELECT item_id, research || '; ' || finance || '; lines; ' || CASE WHEN item_id % 4 = 1 AND NOT blank THEN '1' ELSE '0' END || ' errors' AS final_answer, 'done' AS status, 'end' AS next_agent,
  'document,finance,research' AS outputs
FROM said
"""

QUERIES = {"answers": (answers, ANSWERS_SQL)}
