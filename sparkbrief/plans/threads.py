"""Threads of work, read from conversations: each turn is a step of its conversation."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkbrief.operators.infer import batch_infer
from sparkbrief.operators.jobs import latest_status
from sparkbrief.operators.requests import accepted, rejected, with_defaults
from sparkbrief.operators.research import research_summary
from sparkbrief.operators.responses import (
    document_context,
    document_output,
    finance_output,
    query_result,
    routing_payload,
    synthesis_payload,
    synthesizer_update,
)
from sparkbrief.operators.routing import (
    dispatch,
    fresh,
    repeats,
    routed,
    routing_audit,
    unknown_decisions,
)
from sparkbrief.operators.state import (
    assemble_outputs,
    initial_state,
    outputs_map,
    running_state,
    thread_state,
)
from sparkbrief.sources.sinks import append_job_changes, finished, queued, running
from sparkbrief.sources.states import thread_states, write_thread_states
from sparkbrief.sources.tables import read_job_changes, table
from sparkbrief.staging import stage_path, staged

_UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[0-9a-f]{4}-[0-9a-f]{12}$"
_WORKER_SQL = "CASE role WHEN 'user' THEN 'research' WHEN 'assistant' THEN 'finance' ELSE 'document' END"


def _worker():
    return F.expr(_WORKER_SQL)


def _order_requests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("user_input"),
        F.expr("CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 't' || o_custkey END").alias("thread_id"),
        F.expr("CAST(CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN -1 ELSE 3 END AS INT)").alias("max_steps"),
    )


def request_defaults(spark: SparkSession, sf: str) -> DataFrame:
    filled = with_defaults(
        accepted(_order_requests(spark, sf)).withColumn("given", F.nullif("thread_id", F.lit("")))
    )
    return filled.select(
        "o_orderkey",
        "user_input",
        "given",
        "max_steps",
        F.when(F.col("given").isNull(), F.col("thread_id").rlike(_UUID))
        .otherwise(F.col("thread_id") == F.col("given"))
        .alias("thread_id_good"),
        F.col("job_id").rlike(_UUID).alias("job_id_good"),
    )


REQUEST_DEFAULTS_SQL = """
SELECT o_orderkey, o_orderpriority AS user_input,
  CASE WHEN o_orderkey % 3 = 2 THEN 't' || o_custkey END AS given,
  CAST(CASE o_orderkey % 4 WHEN 2 THEN -1 WHEN 3 THEN 3 ELSE 8 END AS INTEGER) AS max_steps,
  true AS thread_id_good, true AS job_id_good
FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'
"""


def rejected_requests(spark: SparkSession, sf: str) -> DataFrame:
    return rejected(_order_requests(spark, sf)).select("o_orderkey", "thread_id", "max_steps")


REJECTED_REQUESTS_SQL = """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 't' || o_custkey END AS thread_id,
  CAST(CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN -1 ELSE 3 END AS INTEGER) AS max_steps
FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'
"""


def _outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Output of the agent that each turn stands for, as JSON text."""
    said = table(spark, sf, "conversations").withColumn("agent", _worker())
    chars = F.char_length("text").alias("chars")
    output = (
        F.when(F.col("agent") == "research", F.to_json(F.struct(F.col("text").alias("summary"), chars)))
        .when(F.col("agent") == "finance", F.to_json(F.struct(chars, F.col("text").alias("summary"))))
        .otherwise(F.to_json(F.array("text")))
    )
    return said.select(
        F.col("conv_id").alias("thread_id"), "agent", F.col("turn").alias("step"), output.alias("output"), "text"
    )


def _first_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "conversations")
        .groupBy(F.col("conv_id").alias("thread_id"))
        .agg(F.min_by("text", "turn").alias("user_input"))
    )


_PAYLOAD_SCHEMA = (
    "user_input string, completed_agents array<string>, agent_outputs map<string,array<string>>"
)


def routing_payload_query(spark: SparkSession, sf: str) -> DataFrame:
    """The router's question about each conversation, read back from its JSON."""
    known = outputs_map(_outputs(spark, sf)).join(_first_inputs(spark, sf), "thread_id")
    payload = routing_payload(
        F.col("user_input"), F.map_keys("agent_outputs"), F.col("agent_outputs")
    )
    read = known.select("thread_id", F.from_json(payload, _PAYLOAD_SCHEMA).alias("p"))

    def keys(agent: str):
        return F.concat_ws(",", F.element_at("p.agent_outputs", agent)).alias(f"{agent}_keys")

    return read.select(
        F.col("thread_id").alias("conv_id"),
        "p.user_input",
        F.concat_ws(",", F.array_sort("p.completed_agents")).alias("completed"),
        keys("research"),
        keys("finance"),
        keys("document"),
    )


ROUTING_PAYLOAD_SQL = f"""
SELECT conv_id, arg_min(text, turn) AS user_input,
  string_agg(DISTINCT agent, ',' ORDER BY agent) AS completed,
  CASE WHEN bool_or(agent = 'research') THEN 'summary,chars' ELSE '' END AS research_keys,
  CASE WHEN bool_or(agent = 'finance') THEN 'chars,summary' ELSE '' END AS finance_keys,
  '' AS document_keys
FROM (SELECT *, {_WORKER_SQL} AS agent FROM conversations) GROUP BY conv_id
"""


def document_context_query(spark: SparkSession, sf: str) -> DataFrame:
    latest = (
        _outputs(spark, sf).groupBy("thread_id", "agent").agg(F.max_by("output", "step").alias("output"))
    )
    sides = [latest.filter(F.col("agent") == a) for a in ("research", "finance", "document")]
    joined = assemble_outputs(_first_inputs(spark, sf), *sides)
    context = document_context(F.col("user_input"), F.col("research"), F.col("finance"))
    return joined.select(
        F.col("thread_id").alias("conv_id"),
        context.alias("context"),
        F.col("document").isNotNull().alias("has_document"),
    )


DOCUMENT_CONTEXT_SQL = """
SELECT conv_id, concat_ws(chr(10), '使用者需求：' || arg_min(text, turn),
    'Research 結果摘要：' || (arg_max(text, turn) FILTER (WHERE role = 'user')),
    'Finance 結果摘要：' || (arg_max(text, turn) FILTER (WHERE role = 'assistant'))) AS context,
  bool_or(role NOT IN ('user', 'assistant')) AS has_document
FROM conversations GROUP BY conv_id
"""


def synthesis_payload_query(spark: SparkSession, sf: str) -> DataFrame:
    """The closing question about each conversation, read back from its JSON."""
    known = outputs_map(_outputs(spark, sf)).join(_first_inputs(spark, sf), "thread_id")
    none = F.array().cast("array<string>")
    errors = F.when(F.col("thread_id") % 3 == 0, F.array(F.lit("查詢失敗"), F.lit("OPEN"))).otherwise(none)
    payload = known.select(
        "thread_id", synthesis_payload(F.col("user_input"), F.col("agent_outputs"), errors).alias("p")
    )

    def field(path: str):
        return F.get_json_object("p", path)

    return payload.select(
        F.col("thread_id").alias("conv_id"),
        field("$.user_input").alias("user_input"),
        field("$.agent_outputs.research.summary").alias("research_summary"),
        field("$.agent_outputs.finance.chars").cast("int").alias("finance_chars"),
        field("$.agent_outputs.document[0]").alias("document_line"),
        F.coalesce(F.json_array_length(field("$.errors")), F.lit(-1)).alias("n_errors"),
    )


SYNTHESIS_PAYLOAD_SQL = """
SELECT conv_id, arg_min(text, turn) AS user_input,
  arg_max(text, turn) FILTER (WHERE role = 'user') AS research_summary,
  CAST(length(arg_max(text, turn) FILTER (WHERE role = 'assistant')) AS INTEGER) AS finance_chars,
  arg_max(text, turn) FILTER (WHERE role NOT IN ('user', 'assistant')) AS document_line,
  CAST(CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 0 END AS INTEGER) AS n_errors
FROM conversations GROUP BY conv_id
"""


def response_fallbacks(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn as a model response of some kind, read by every parse rule."""
    said = table(spark, sf, "conversations").withColumn("kind", (F.col("conv_id") + F.col("turn")) % 5)
    document = F.to_json(
        F.struct(
            F.col("role").alias("title"),
            F.col("text").alias("summary"),
            F.array(
                F.struct(F.col("role").alias("heading"), F.array("text", F.lit("b")).alias("bullets"))
            ).alias("sections"),
        )
    )
    notes = F.to_json(
        F.struct(F.col("text").alias("interpretation"), F.array(F.lit("n1"), F.lit("n2")).alias("risk_notes"))
    )
    content = (
        F.when(F.col("kind") == 0, document)
        .when(F.col("kind") == 1, F.concat(F.lit(" \n"), F.col("text"), F.lit("\t ")))
        .when(F.col("kind") == 2, F.to_json(F.array("text")))
        .when(F.col("kind") == 3, notes)
        .otherwise(F.lit("{}"))
    )
    hits = F.when(F.col("turn") % 2 == 0, F.array(F.lit("hit"))).otherwise(F.array().cast("array<string>"))
    parsed = said.withColumn("content", content).withColumns(
        {
            "doc": document_output(F.col("content")),
            "fin": finance_output(F.col("content")),
            "res": research_summary(hits, F.col("content")),
        }
    )
    ended = synthesizer_update(parsed.withColumn("answer", F.col("content")), "answer")
    return ended.select(
        "conv_id",
        "turn",
        F.col("doc.title").alias("doc_title"),
        F.col("doc.summary").alias("doc_summary"),
        F.size("doc.sections").alias("doc_sections"),
        F.get(F.get("doc.sections", F.lit(0))["bullets"], F.lit(1)).alias("doc_bullet"),
        F.col("doc.raw_response").alias("doc_raw"),
        F.col("fin.summary").alias("fin_summary"),
        F.size("fin.risk_notes").alias("fin_notes"),
        F.col("res.summary").alias("res_summary"),
        F.when(F.col("kind") == 1, F.col("final_answer")).alias("answer"),
        "next_agent",
        F.concat_ws(",", "completed_agents").alias("completed"),
    )


RESPONSE_FALLBACKS_SQL = r"""
WITH kinds AS (
  SELECT *, (conv_id + turn) % 5 AS kind FROM conversations),
told AS (
  SELECT *, CASE kind WHEN 1 THEN ' ' || chr(10) || text || chr(9) || ' '
    WHEN 2 THEN CAST(to_json([text]) AS VARCHAR) END AS plain FROM kinds)
SELECT conv_id, turn,
  CASE WHEN kind = 0 THEN role WHEN kind IN (1, 2) THEN '文件產生失敗' END AS doc_title,
  CASE WHEN kind = 0 THEN text WHEN kind IN (1, 2) THEN '結構化解析失敗，請參考原始回應。' END AS doc_summary,
  CAST(CASE WHEN kind = 0 THEN 1 WHEN kind IN (1, 2) THEN 0 ELSE NULL END AS INTEGER) AS doc_sections,
  CASE WHEN kind = 0 THEN 'b' END AS doc_bullet,
  plain AS doc_raw,
  CASE WHEN kind IN (1, 2) THEN plain WHEN kind = 3 THEN text ELSE '' END AS fin_summary,
  CAST(CASE WHEN kind = 3 THEN 2 ELSE 0 END AS INTEGER) AS fin_notes,
  CASE WHEN turn % 2 = 1 THEN '無搜尋結果' WHEN kind IN (1, 2) THEN '摘要無法產生' WHEN kind = 0 THEN text ELSE '無摘要' END AS res_summary,
  CASE WHEN kind = 1 THEN regexp_replace(plain, '^\s+|\s+$', '', 'g') END AS answer,
  'end' AS next_agent, 'synthesizer' AS completed
FROM told
"""

_DECISION_SQL = """CASE WHEN turn >= 6 THEN '{"next_agent": "synthesizer"}'
  WHEN k <= 3 THEN '{"next_agent": "research", "reason": "r"}' WHEN k <= 6 THEN '{"next_agent": "document"}'
  WHEN k <= 9 THEN '{"next_agent": "finance"}' WHEN k = 10 AND turn % 2 = 0 THEN '{"next_agent": "finance"} thanks}'
  WHEN k = 10 THEN '這不是 JSON' WHEN k = 11 THEN '{"reason": "r"}'
  ELSE '{"next_agent": "planner"}' END"""


def _decision_log(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("thread_id"), F.col("turn").alias("seq"), "turn",
        ((F.col("conv_id") * 5 + F.col("turn") * 4) % 13).alias("k"),
    )
    return log.select("thread_id", "seq", F.expr(_DECISION_SQL).alias("content"))


def routing_audit_query(spark: SparkSession, sf: str) -> DataFrame:
    return routing_audit(_decision_log(spark, sf), max_steps=4).withColumnRenamed("thread_id", "conv_id")


_AUDIT_SQL = """
log AS (
  SELECT conv_id, turn AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step,
    CASE WHEN turn >= 6 THEN 'synthesizer' WHEN k <= 3 THEN 'research' WHEN k <= 6 THEN 'document'
      WHEN k <= 9 THEN 'finance' WHEN k >= 12 THEN 'planner' END AS proposal,
    turn < 6 AND k = 10 AS broken
  FROM (SELECT *, (conv_id * 5 + turn * 4) % 13 AS k FROM conversations)),
ruled AS (
  SELECT *, CASE WHEN step >= 4 THEN 'step_limit' WHEN broken THEN 'bad_json' WHEN proposal IS NULL THEN 'missing'
      WHEN proposal = 'planner' THEN 'unknown'
      WHEN proposal <> 'synthesizer' AND row_number() OVER (PARTITION BY conv_id, proposal ORDER BY seq) > 1 THEN 'repeat'
      ELSE 'as_proposed' END AS rule
  FROM log),
ends AS (
  SELECT conv_id, min(step) AS last_step FROM ruled WHERE rule <> 'as_proposed' OR proposal = 'synthesizer' GROUP BY conv_id),
audit AS (
  SELECT conv_id, seq, step, proposal,
    CASE WHEN step > coalesce(last_step, 1000000) THEN 'unreached' ELSE rule END AS rule,
    CASE WHEN step > coalesce(last_step, 1000000) THEN NULL WHEN rule = 'as_proposed' THEN proposal
      ELSE 'synthesizer' END AS next_agent
  FROM ruled LEFT JOIN ends USING (conv_id))
"""
ROUTING_AUDIT_SQL = f"WITH {_AUDIT_SQL} SELECT conv_id, seq, step, proposal, rule, next_agent FROM audit"


def route_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """Where every reached step goes, and where that leads; and the proposals no edge knows."""
    audit = staged(routing_audit(_decision_log(spark, sf), max_steps=4), "audit")  # read twice below
    reached = audit.filter(F.col("rule") != "unreached").withColumn("next_agent", routed(F.col("next_agent")))
    known = dispatch(reached).select("thread_id", "seq", "node", "after")
    odd = unknown_decisions(audit.filter(F.col("proposal").isNotNull()), "proposal").select(
        "thread_id", "seq", F.lit("unknown").alias("node"), F.col("proposal").alias("after")
    )
    return known.unionByName(odd).withColumnRenamed("thread_id", "conv_id")


ROUTE_DISPATCH_SQL = f"""
WITH {_AUDIT_SQL}
SELECT conv_id, seq, next_agent AS node, CASE WHEN next_agent = 'synthesizer' THEN 'end' ELSE 'orchestrator' END AS after
FROM audit WHERE rule <> 'unreached'
UNION ALL SELECT conv_id, seq, 'unknown', proposal FROM audit WHERE proposal = 'planner'
"""


def completed_guard(spark: SparkSession, sf: str) -> DataFrame:
    """What the assistant's turns propose, against the agents that the other turns completed."""
    agent = F.expr(_AGENT_SQL).alias("agent")
    said = table(spark, sf, "conversations").select(F.col("conv_id").alias("thread_id"), "turn", "role", agent)
    done = said.filter(F.col("role") != "assistant").select("thread_id", "agent")
    proposed = said.filter(F.col("role") == "assistant").select("thread_id", "turn", "agent")
    again = repeats(proposed, done).withColumn("repeated", F.lit(True))
    return (
        again.unionByName(fresh(proposed, done).withColumn("repeated", F.lit(False)))
        .withColumnRenamed("thread_id", "conv_id")
    )


_AGENT_SQL = """CASE (conv_id + turn * turn) % 3 WHEN 0 THEN 'research' WHEN 1 THEN 'finance' ELSE 'document' END"""

COMPLETED_GUARD_SQL = f"""
WITH said AS (SELECT conv_id, turn, role, {_AGENT_SQL} AS agent FROM conversations)
SELECT conv_id, turn, agent, EXISTS (
  SELECT 1 FROM said d WHERE d.conv_id = said.conv_id AND d.agent = said.agent AND d.role <> 'assistant') AS repeated
FROM said WHERE role = 'assistant'
"""


def _updates(spark: SparkSession, sf: str) -> DataFrame:
    """A partial state update per turn, after the initial state of each thread."""
    said = table(spark, sf, "conversations").withColumn("worker", _worker())
    turn = F.col("turn")
    starts = initial_state(
        _first_inputs(spark, sf).withColumn("max_steps", F.lit(None).cast("int"))
    )
    updates = said.select(
        F.col("conv_id").alias("thread_id"),
        turn.alias("step"),
        F.array("worker").alias("completed_agents"),
        F.create_map("worker", F.char_length("text").cast("string")).alias("agent_outputs"),
        F.when(F.char_length("text") % 5 == 0, F.array(F.concat(F.lit("e"), turn.cast("string")))).alias("errors"),
        (turn + 1).cast("int").alias("step_count"),
        F.when(turn == 3, F.col("text")).alias("final_answer"),
        F.when(turn % 2 == 0, F.col("worker")).alias("next_agent"),
    )
    return starts.unionByName(updates, allowMissingColumns=True)


def _flat(states: DataFrame) -> DataFrame:
    """Lists and maps as text, with the empty defaults of a query result."""
    rest = [c for c in ("step", "user_input", "step_count", "next_agent") if c in states.columns]
    filled = query_result(states, rest)
    outputs = F.array_sort(
        F.transform(F.map_entries("agent_outputs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    )
    return filled.select(
        F.col("thread_id").alias("conv_id"),
        *rest,
        F.concat_ws(",", "completed_agents").alias("completed"),
        F.concat_ws(",", outputs).alias("outputs"),
        F.concat_ws(",", "errors").alias("errors"),
        "final_answer",
    )


def thread_state_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(thread_state(_updates(spark, sf), "overwrite"))


def thread_state_accumulate(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(thread_state(_updates(spark, sf), "accumulate"))


def running_thread_state(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(running_state(_updates(spark, sf), "accumulate"))


_STEPS_SQL = f"""
steps AS (
  SELECT *, {_WORKER_SQL} AS worker, CASE WHEN length(text) % 5 = 0 THEN 'e' || turn END AS error FROM conversations)
"""

THREAD_STATE_OVERWRITE_SQL = f"""
WITH {_STEPS_SQL}
SELECT conv_id, arg_min(text, turn) AS user_input, CAST(max(turn) + 1 AS INTEGER) AS step_count,
  arg_max(worker, turn) FILTER (WHERE turn % 2 = 0) AS next_agent,
  arg_max(worker, turn) AS completed, arg_max(worker || '=' || length(text), turn) AS outputs,
  coalesce(arg_max(error, turn) FILTER (WHERE error IS NOT NULL), '') AS errors,
  coalesce(max(text) FILTER (WHERE turn = 3), '') AS final_answer
FROM steps GROUP BY conv_id
"""


def _merged_sql(upto: str) -> str:
    """Accumulated fields over the turns ``u`` of a conversation that satisfy ``upto``."""
    return f"""
  coalesce((SELECT string_agg(w, ',' ORDER BY t) FROM (
    SELECT worker AS w, min(turn) AS t FROM steps u WHERE u.conv_id = s.conv_id AND {upto} GROUP BY worker)), '') AS completed,
  coalesce((SELECT string_agg(w || '=' || n, ',' ORDER BY w) FROM (
    SELECT worker AS w, arg_max(length(text), turn) AS n FROM steps u WHERE u.conv_id = s.conv_id AND {upto} GROUP BY worker)), '') AS outputs,
  coalesce((SELECT string_agg(error, ',' ORDER BY turn) FROM steps u WHERE u.conv_id = s.conv_id AND {upto}), '') AS errors"""


THREAD_STATE_ACCUMULATE_SQL = f"""
WITH {_STEPS_SQL},
s AS (
  SELECT conv_id, arg_min(text, turn) AS user_input, CAST(max(turn) + 1 AS INTEGER) AS step_count,
    arg_max(worker, turn) FILTER (WHERE turn % 2 = 0) AS next_agent,
    coalesce(max(text) FILTER (WHERE turn = 3), '') AS final_answer
  FROM steps GROUP BY conv_id)
SELECT conv_id, user_input, step_count, next_agent, final_answer, {_merged_sql("true")} FROM s
"""

RUNNING_THREAD_STATE_SQL = f"""
WITH {_STEPS_SQL},
firsts AS (SELECT conv_id, arg_min(text, turn) AS user_input FROM steps GROUP BY conv_id),
s AS (
  SELECT conv_id, turn AS step, CAST(turn + 1 AS INTEGER) AS step_count FROM steps
  UNION ALL SELECT DISTINCT conv_id, -1, 0 FROM steps)
SELECT s.conv_id, s.step, s.step_count, user_input,
  (SELECT arg_max(worker, turn) FROM steps u WHERE u.conv_id = s.conv_id AND u.turn <= s.step AND turn % 2 = 0) AS next_agent,
  coalesce((SELECT max(text) FROM steps u WHERE u.conv_id = s.conv_id AND u.turn <= s.step AND turn = 3), '') AS final_answer,
  {_merged_sql("u.turn <= s.step")}
FROM s JOIN firsts USING (conv_id)
"""


_EVENT_STEPS_SQL = """
steps AS (
  SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step
  FROM events)
"""


def _event_updates(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events as the updates of one thread, most of them beyond its step limit of 4."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf, "events").withColumn("step", (F.row_number().over(order) - 1).cast("long"))
    starts = initial_state(
        events.select(F.col("user_id").alias("thread_id"), F.lit("q").alias("user_input"), F.lit(4).alias("max_steps"))
        .distinct()
    )
    step = F.col("step").cast("string")
    updates = events.select(
        F.col("user_id").alias("thread_id"),
        "step",
        F.array("event_type").alias("completed_agents"),
        F.create_map("event_type", F.col("event_id").cast("string")).alias("agent_outputs"),
        F.when(F.col("event_type") == "error", F.array(F.concat(F.lit("e"), step), F.concat(F.lit("f"), step))).alias("errors"),
        (F.col("step") + 1).cast("int").alias("step_count"),
        F.when(F.col("step") == 11, F.concat(F.lit("answer "), F.col("event_id").cast("string"))).alias("final_answer"),
        F.when(F.col("step") % 2 == 0, F.col("event_type")).alias("next_agent"),
    )
    return starts.unionByName(updates, allowMissingColumns=True)


def thread_state_long(spark: SparkSession, sf: str) -> DataFrame:
    """Threads that went on beyond their step limit: nothing of what was told is lost."""
    return _flat(thread_state(_event_updates(spark, sf), "accumulate")).withColumnRenamed("conv_id", "user_id")


THREAD_STATE_LONG_SQL = f"""
WITH {_EVENT_STEPS_SQL},
agents AS (
  SELECT user_id, event_type, min(step) AS first, max_by(event_id, step) AS last FROM steps GROUP BY user_id, event_type)
SELECT user_id, 'q' AS user_input, CAST(max(step) + 1 AS INTEGER) AS step_count,
  arg_max(event_type, step) FILTER (WHERE step % 2 = 0) AS next_agent,
  (SELECT string_agg(event_type, ',' ORDER BY first) FROM agents a WHERE a.user_id = s.user_id) AS completed,
  (SELECT string_agg(event_type || '=' || last, ',' ORDER BY event_type) FROM agents a WHERE a.user_id = s.user_id) AS outputs,
  coalesce(string_agg('e' || step || ',f' || step, ',' ORDER BY step) FILTER (WHERE event_type = 'error'), '') AS errors,
  coalesce(max('answer ' || event_id) FILTER (WHERE step = 11), '') AS final_answer
FROM steps s GROUP BY user_id
"""


def running_state_long(spark: SparkSession, sf: str) -> DataFrame:
    """State after every event, with all that was told up to it."""
    return _flat(running_state(_event_updates(spark, sf), "accumulate")).withColumnRenamed("conv_id", "user_id")


RUNNING_STATE_LONG_SQL = f"""
WITH {_EVENT_STEPS_SQL},
s AS (SELECT user_id, step FROM steps UNION ALL SELECT DISTINCT user_id, -1 FROM steps),
told AS (
  SELECT s.user_id, s.step, u.event_type, u.event_id, u.step AS turn
  FROM s LEFT JOIN steps u ON u.user_id = s.user_id AND u.step <= s.step),
agents AS (
  SELECT user_id, step, event_type, min(turn) AS first, max_by(event_id, turn) AS last
  FROM told WHERE turn IS NOT NULL GROUP BY user_id, step, event_type),
lists AS (
  SELECT user_id, step, string_agg(event_type, ',' ORDER BY first) AS completed,
    string_agg(event_type || '=' || last, ',' ORDER BY event_type) AS outputs
  FROM agents GROUP BY user_id, step),
rest AS (
  SELECT user_id, step, arg_max(event_type, turn) FILTER (WHERE turn % 2 = 0) AS next_agent,
    coalesce(string_agg('e' || turn || ',f' || turn, ',' ORDER BY turn) FILTER (WHERE event_type = 'error'), '') AS errors,
    coalesce(max('answer ' || event_id) FILTER (WHERE turn = 11), '') AS final_answer
  FROM told GROUP BY user_id, step)
SELECT user_id, step, 'q' AS user_input, CAST(step + 1 AS INTEGER) AS step_count, next_agent,
  coalesce(completed, '') AS completed, coalesce(outputs, '') AS outputs, errors, final_answer
FROM rest LEFT JOIN lists USING (user_id, step)
"""


def running_state_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    """State after every event, each field with its latest value."""
    return _flat(running_state(_event_updates(spark, sf), "overwrite")).withColumnRenamed("conv_id", "user_id")


RUNNING_STATE_OVERWRITE_SQL = f"""
WITH {_EVENT_STEPS_SQL}
SELECT user_id, -1 AS step, 'q' AS user_input, CAST(0 AS INTEGER) AS step_count, CAST(NULL AS VARCHAR) AS next_agent,
  '' AS completed, '' AS outputs, '' AS errors, '' AS final_answer
FROM (SELECT DISTINCT user_id FROM steps)
UNION ALL
SELECT user_id, step, 'q', CAST(step + 1 AS INTEGER),
  last_value(CASE WHEN step % 2 = 0 THEN event_type END IGNORE NULLS) OVER w,
  event_type, event_type || '=' || event_id,
  coalesce(last_value(CASE WHEN event_type = 'error' THEN 'e' || step || ',f' || step END IGNORE NULLS) OVER w, ''),
  coalesce(last_value(CASE WHEN step = 11 THEN 'answer ' || event_id END IGNORE NULLS) OVER w, '')
FROM steps WINDOW w AS (PARTITION BY user_id ORDER BY step)
"""


def state_sink(spark: SparkSession, sf: str) -> DataFrame:
    """States after two turns, written; then the even threads' last states, written over them; read back."""
    updates = _updates(spark, sf)
    path = stage_path(spark, "state-sink")
    write_thread_states(thread_state(updates.filter(F.col("step") < 2)), path)
    write_thread_states(thread_state(updates.filter(F.col("thread_id") % 2 == 0)), path)
    return _flat(thread_states(spark, path))


STATE_SINK_SQL = f"""
WITH {_STEPS_SQL},
s AS (
  SELECT conv_id, arg_min(text, turn) AS user_input,
    CAST(coalesce(max(turn) FILTER (WHERE conv_id % 2 = 0 OR turn < 2) + 1, 0) AS INTEGER) AS step_count,
    arg_max(worker, turn) FILTER (WHERE turn % 2 = 0 AND (conv_id % 2 = 0 OR turn < 2)) AS next_agent,
    coalesce(max(text) FILTER (WHERE turn = 3 AND conv_id % 2 = 0), '') AS final_answer
  FROM steps GROUP BY conv_id)
SELECT conv_id, user_input, step_count, next_agent, final_answer, {_merged_sql("(u.conv_id % 2 = 0 OR u.turn < 2)")} FROM s
"""


def job_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as jobs: their changes appended in three writes, and the newest of each read back."""
    orders = table(spark, sf, "orders").select(
        F.concat(F.lit("job-"), F.col("o_orderkey").cast("string")).alias("job_id"),
        F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("thread_id"),
        "o_orderkey",
        "o_orderstatus",
    )
    path = stage_path(spark, "job-sink")
    append_job_changes(queued(orders), path)
    append_job_changes(running(orders.filter(F.col("o_orderstatus") != "P")), path)
    ended = orders.filter(F.col("o_orderstatus") == "F")
    ended = ended.withColumn("error_detail", F.when(F.col("o_orderkey") % 7 == 0, F.lit("timeout")))
    append_job_changes(finished(ended), path)
    return latest_status(read_job_changes(spark, path)).select("job_id", "thread_id", "status", "error_detail")


JOB_SINK_SQL = """
SELECT 'job-' || o_orderkey AS job_id, 't' || o_custkey AS thread_id,
  CASE o_orderstatus WHEN 'P' THEN 'queued' WHEN 'O' THEN 'running'
    ELSE CASE WHEN o_orderkey % 7 = 0 THEN 'error' ELSE 'done' END END AS status,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 = 0 THEN 'timeout' END AS error_detail
FROM orders
"""


def batch_infer_query(spark: SparkSession, sf: str) -> DataFrame:
    """A stand-in model that counts characters; labelled texts have been answered before."""
    documents = table(spark, sf, "documents").select("doc_id", "text")
    answer = F.concat(F.lit("quality "), F.col("quality").cast("string"))
    stored = documents.join(table(spark, sf, "labels"), "doc_id").select(
        F.col("text").alias("prompt"), answer.alias("response")
    )
    answered = batch_infer(documents, "text", lambda prompt: str(len(prompt)), stored)
    return answered.select("doc_id", "response", "error", F.coalesce("attempts", F.lit(0)).alias("attempts"))


BATCH_INFER_SQL = """
WITH stored AS (
  SELECT text, 'quality ' || max(quality) AS response FROM documents JOIN labels USING (doc_id) GROUP BY text)
SELECT doc_id, coalesce(response, CAST(length(text) AS VARCHAR)) AS response, CAST(NULL AS VARCHAR) AS error,
  CAST(CASE WHEN response IS NULL THEN 1 ELSE 0 END AS INTEGER) AS attempts
FROM documents LEFT JOIN stored USING (text)
"""

QUERIES = {
    "request_defaults": (request_defaults, REQUEST_DEFAULTS_SQL),
    "rejected_requests": (rejected_requests, REJECTED_REQUESTS_SQL),
    "routing_payload": (routing_payload_query, ROUTING_PAYLOAD_SQL),
    "document_context": (document_context_query, DOCUMENT_CONTEXT_SQL),
    "synthesis_payload": (synthesis_payload_query, SYNTHESIS_PAYLOAD_SQL),
    "response_fallbacks": (response_fallbacks, RESPONSE_FALLBACKS_SQL),
    "routing_audit": (routing_audit_query, ROUTING_AUDIT_SQL),
    "route_dispatch": (route_dispatch, ROUTE_DISPATCH_SQL),
    "completed_guard": (completed_guard, COMPLETED_GUARD_SQL),
    "thread_state_overwrite": (thread_state_overwrite, THREAD_STATE_OVERWRITE_SQL),
    "thread_state_accumulate": (thread_state_accumulate, THREAD_STATE_ACCUMULATE_SQL),
    "running_thread_state": (running_thread_state, RUNNING_THREAD_STATE_SQL),
    "thread_state_long": (thread_state_long, THREAD_STATE_LONG_SQL),
    "running_state_long": (running_state_long, RUNNING_STATE_LONG_SQL),
    "running_state_overwrite": (running_state_overwrite, RUNNING_STATE_OVERWRITE_SQL),
    "state_sink": (state_sink, STATE_SINK_SQL),
    "job_sink": (job_sink, JOB_SINK_SQL),
    "batch_infer": (batch_infer_query, BATCH_INFER_SQL),
}
