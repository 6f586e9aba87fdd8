import json

import pytest
from pyspark.sql import functions as F

from sparkbrief.operators.responses import (
    document_context,
    document_output,
    finance_output,
    finance_payload,
    query_result,
    routing_payload,
    synthesis_payload,
    synthesizer_update,
)
from sparkbrief.operators.routing import (
    dispatch,
    fresh,
    next_agent,
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


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


def test_document_output(spark):
    good = '{"title": "t", "summary": "s", "sections": [{"heading": "h", "bullets": ["b1", "b2"]}]}'
    rows = spark.createDataFrame([(good,), ("純文字",), ("[]",)], "c string").select(
        document_output(F.col("c")).alias("d")
    )
    full, text, listed = [r.d for r in rows.collect()]
    assert (full.title, full.sections[0].bullets, full.raw_response) == ("t", ["b1", "b2"], None)
    assert (text.title, text.sections, text.raw_response) == ("文件產生失敗", [], "純文字")
    assert text.summary == "結構化解析失敗，請參考原始回應。" and listed.raw_response == "[]"


def test_finance_output(spark):
    rows = ['{"interpretation": "i", "risk_notes": ["a"]}', "純文字回覆，不是 JSON", "{}"]
    df = spark.createDataFrame([(r,) for r in rows], "c string").select(finance_output(F.col("c")).alias("f"))
    assert [(r.f.summary, r.f.risk_notes) for r in df.collect()] == [
        ("i", ["a"]), ("純文字回覆，不是 JSON", []), ("", []),
    ]


def test_payloads(spark):
    outputs = F.create_map(
        F.lit("research"), F.lit('{"summary": "摘要", "raw": []}'), F.lit("document"), F.lit("[1]")
    )
    routing = json.loads(one(spark, routing_payload(F.lit("q"), F.array(F.lit("research")), outputs)))
    assert routing["completed_agents"] == ["research"]
    assert routing["agent_outputs"]["research"] == ["summary", "raw"]
    assert routing["agent_outputs"].get("document") is None
    mixed = F.create_map(F.lit("a"), F.lit('{"n": 1}'), F.lit("b"), F.lit("plain text"))
    closing = json.loads(one(spark, synthesis_payload(F.lit("問"), mixed, F.array(F.lit("e1")))))
    assert closing == {"user_input": "問", "agent_outputs": {"a": {"n": 1}, "b": "plain text"}, "errors": ["e1"]}
    assert json.loads(one(spark, synthesis_payload(F.lit("q"), mixed, F.lit(None).cast("array<string>"))))["errors"] == []
    assert json.loads(one(spark, finance_payload(F.lit("q"), F.lit(None).cast("string")))) == {
        "user_input": "q", "calculated_numbers": {},
    }


def test_document_context(spark):
    none = F.lit(None).cast("string")
    assert one(spark, document_context(F.lit("q"), none, none)) == "使用者需求：q"
    both = one(spark, document_context(F.lit("q"), F.lit('{"summary": "r"}'), F.lit("{}")))
    assert both == "使用者需求：q\nResearch 結果摘要：r\nFinance 結果摘要："


def test_synthesizer_and_result(spark):
    update = synthesizer_update(spark.createDataFrame([("t", " 答案\n")], "thread_id string, content string")).first()
    assert (update.final_answer, update.next_agent, update.completed_agents) == ("答案", "end", ["synthesizer"])
    empty = spark.createDataFrame(
        [("t", None, None, None, None)],
        "thread_id string, final_answer string, agent_outputs map<string,string>, errors array<string>, completed_agents array<string>",
    )
    assert tuple(query_result(empty).first()) == ("t", "", {}, [], [])


def test_next_agent_cases(spark):
    rows = [
        ([], 0, 8, '{"next_agent": "research", "reason": "r"}', "research"),
        ([], 0, 8, "這不是 JSON，只是隨便講講", "synthesizer"),
        (["research"], 1, 8, '{"next_agent": "research"}', "synthesizer"),
        (["research", "finance"], 8, 8, '{"next_agent": "document"}', "synthesizer"),
        ([], 0, 8, '{"reason": "x"}', "synthesizer"),
        ([], 0, 8, '{"next_agent": null}', "synthesizer"),
        ([], 0, 8, '{"next_agent": "planner"}', "synthesizer"),
        (None, 0, 8, '["research"]', "synthesizer"),
        (None, 0, 8, '{"next_agent": "finance"}', "finance"),
    ]
    df = spark.createDataFrame(rows, "done array<string>, step int, cap int, content string, expect string")
    got = df.select("expect", next_agent(F.col("content"), F.col("done"), F.col("step"), F.col("cap")).alias("n"))
    assert all(r.n == r.expect for r in got.collect())
    assert one(spark, routed(F.lit(None).cast("string"))) == "synthesizer"


def audit_by_hand(log, cap):
    """The router walked step by step over each thread's log."""
    out = {}
    for thread in {t for t, _, _ in log}:
        done, ended = [], False
        for step, (_, seq, content) in enumerate(sorted(r for r in log if r[0] == thread)):
            if ended:
                out[thread, seq] = (step, "unreached", None)
                continue
            try:
                doc = json.loads(content)
            except json.JSONDecodeError:
                doc = None
            name = doc.get("next_agent") if isinstance(doc, dict) else None
            if step >= cap:
                rule = "step_limit"
            elif not isinstance(doc, dict):
                rule = "bad_json"
            elif name is None:
                rule = "missing"
            elif name not in ("research", "document", "finance", "synthesizer"):
                rule = "unknown"
            elif name in done:
                rule = "repeat"
            else:
                rule = "as_proposed"
            agent = name if rule == "as_proposed" else "synthesizer"
            ended = agent == "synthesizer"
            done.append(agent)
            out[thread, seq] = (step, rule, agent)
    return out


@pytest.mark.parametrize("hot_rows", [1000, 15])
def test_routing_audit(spark, hot_rows):
    import random

    rng = random.Random(4)
    contents = [f'{{"next_agent": "{a}"}}' for a in ("research", "document", "finance") for _ in range(6)]
    contents += ['{"next_agent": "synthesizer"}', '{"next_agent": "planner"}', "oops", "{}"]
    log = [(f"t{t}", seq, rng.choice(contents)) for t in range(12) for seq in range(rng.randrange(1, 7))]
    log += [("hot", seq, rng.choice(contents)) for seq in range(60)]
    df = spark.createDataFrame(log, "thread_id string, seq int, content string")
    got = {(r.thread_id, r.seq): (r.step, r.rule, r.next_agent) for r in routing_audit(df, 3, hot_rows).collect()}
    assert got == audit_by_hand(log, 3)


def test_audit_uses_own_step_limit(spark):
    df = spark.createDataFrame(
        [("t", i, '{"next_agent": "%s"}' % a, 1) for i, a in enumerate(["research", "finance"])],
        "thread_id string, seq int, content string, max_steps int",
    )
    assert [r.rule for r in routing_audit(df).orderBy("seq").collect()] == ["as_proposed", "step_limit"]


def test_dispatch_and_guards(spark):
    df = spark.createDataFrame(
        [("t", "research"), ("t", "synthesizer"), ("t", "planner")], "thread_id string, next_agent string"
    )
    assert {(r.node, r.after) for r in dispatch(df).collect()} == {
        ("research", "orchestrator"), ("synthesizer", "end"),
    }
    assert [r.next_agent for r in unknown_decisions(df).collect()] == ["planner"]
    asked = spark.createDataFrame([("t", "research"), ("t", "finance")], "thread_id string, agent string")
    done = spark.createDataFrame([("t", "research"), ("t", "research")], "thread_id string, agent string")
    assert [r.agent for r in repeats(asked, done).collect()] == ["research"]
    assert [r.agent for r in fresh(asked, done).collect()] == ["finance"]


UPDATE = (
    "thread_id string, step long, completed_agents array<string>, agent_outputs map<string,string>, "
    "errors array<string>, final_answer string, next_agent string"
)
UPDATES = [
    ("t", 0, ["research"], {"research": "r1"}, ["e1"], None, "finance"),
    ("t", 1, ["finance"], {"finance": "f"}, None, None, None),
    ("t", 2, ["research"], {"research": "r2"}, ["e1", "e2"], "a", None),
    ("u", 0, None, None, None, None, "research"),
]


def test_thread_state_modes(spark):
    updates = spark.createDataFrame(UPDATES, UPDATE).repartition(3)
    over = {r.thread_id: r for r in thread_state(updates, "overwrite").collect()}
    assert over["t"].completed_agents == ["research"] and over["t"].agent_outputs == {"research": "r2"}
    assert (over["t"].errors, over["t"].next_agent, over["t"].final_answer) == (["e1", "e2"], "finance", "a")
    grown = {r.thread_id: r for r in thread_state(updates, "accumulate").collect()}
    assert grown["t"].completed_agents == ["research", "finance"]
    assert grown["t"].agent_outputs == {"research": "r2", "finance": "f"}
    assert grown["t"].errors == ["e1", "e1", "e2"]
    assert (grown["u"].completed_agents, grown["u"].errors, grown["u"].next_agent) == ([], [], "research")


def test_updates_beyond_the_step_limit_are_merged(spark):
    start = initial_state(spark.createDataFrame([("t", "q", 2)], "thread_id string, user_input string, max_steps int"))
    told = [("t", i, [f"a{i % 3}"], {f"a{i % 3}": str(i)}, [f"e{i}"], "answer" if i == 11 else None, None) for i in range(12)]
    updates = start.unionByName(spark.createDataFrame(told, UPDATE), allowMissingColumns=True)
    merged = thread_state(updates, "accumulate").first()
    assert merged.completed_agents == ["a0", "a1", "a2"] and merged.final_answer == "answer"
    assert merged.agent_outputs == {"a0": "9", "a1": "10", "a2": "11"} and merged.errors == [f"e{i}" for i in range(12)]
    last = running_state(updates, "accumulate").filter("step = 11").first()
    assert (last.completed_agents, last.agent_outputs, last.errors) == (merged.completed_agents, merged.agent_outputs, merged.errors)


@pytest.mark.parametrize("hot_rows", [100, 1])
def test_running_state(spark, hot_rows):
    updates = spark.createDataFrame(UPDATES, UPDATE)
    got = {(r.thread_id, r.step): r for r in running_state(updates, "accumulate", hot_rows=hot_rows).collect()}
    assert got["t", 1].completed_agents == ["research", "finance"] and got["t", 1].next_agent == "finance"
    assert got["t", 0].agent_outputs == {"research": "r1"} and got["t", 2].agent_outputs["research"] == "r2"
    over = {(r.thread_id, r.step): r for r in running_state(updates, "overwrite", hot_rows=hot_rows).collect()}
    assert over["t", 1].errors == ["e1"] and over["t", 1].agent_outputs == {"finance": "f"}


def test_running_state_gathers_no_history_over_a_window(spark):
    told = [("t", i, [f"a{i % 2}"], {f"a{i % 2}": str(i // 4)}, [f"e{i}"] if i % 5 == 0 else None, None, None) for i in range(40)]
    updates = spark.createDataFrame(told, UPDATE)
    whole, cut = (running_state(updates, "accumulate", hot_rows=n) for n in (100, 7))
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "collect_list" in line and "windowspecdefinition" in line]
    rows = sorted(whole.collect(), key=lambda r: r.step)
    assert rows == sorted(cut.collect(), key=lambda r: r.step) and len(rows) == 40
    assert rows[7].completed_agents == ["a0", "a1"] and rows[7].agent_outputs == {"a0": "1", "a1": "1"}
    assert rows[39].errors == [f"e{i}" for i in range(0, 40, 5)]


def test_initial_state_and_assembly(spark):
    start = initial_state(spark.createDataFrame([("t", "q", 8)], "thread_id string, user_input string, max_steps int"))
    assert start.first().asDict() == {
        "thread_id": "t", "step": -1, "user_input": "q", "completed_agents": [], "agent_outputs": {},
        "errors": [], "step_count": 0, "max_steps": 8,
    }
    outputs = spark.createDataFrame(
        [("t", "research", 0, "old"), ("t", "research", 2, "new"), ("t", "finance", 1, "f")],
        "thread_id string, agent string, step int, output string",
    )
    assert outputs_map(outputs).first().agent_outputs == {"finance": "f", "research": "new"}
    side = {a: outputs.filter(F.col("agent") == a).filter("step > 0") for a in ("research", "finance", "document")}
    joined = assemble_outputs(start.select("thread_id"), side["research"], side["finance"], side["document"]).first()
    assert (joined.research, joined.finance, joined.document) == ("new", "f", None)
