"""Cases at the edges of the rules: ids local to a key, odd ids, strict JSON, large numbers, failed results."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkbrief.functions import json_object, round2
from sparkbrief.functions.jsontext import json_field, json_value
from sparkbrief.operators.breaker import BreakerRule, breaker_timeline, guard_searches
from sparkbrief.operators.cache import serve_from_cache, ttl_lookups
from sparkbrief.operators.infer import batch_infer
from sparkbrief.operators.limits import admit
from sparkbrief.operators.logs import parse_lines
from sparkbrief.operators.positions import numbers_json, params_from_text, position_levels, validated_params
from sparkbrief.operators.requests import subqueries
from sparkbrief.operators.responses import decision, document_output, finance_output
from sparkbrief.operators.state import thread_state
from sparkbrief.sources.states import read_thread_state, thread_states, write_thread_states

T0 = datetime(2024, 1, 1, tzinfo=UTC).replace(tzinfo=None)
BIG = 9_007_199_254_740_993  # no double holds it


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("ids", ["number", "text"])
def test_breaker_with_ids_of_their_own_per_key(spark, ids):
    draw = random.Random(1)
    keys = [BIG, BIG + 1, None, -7]
    rows = []
    for key in keys:
        for i in range(40):
            made = i if ids == "number" else f"{'x' * 26}{i:03d}"
            rows.append((key, T0 + timedelta(seconds=9 * i), made, draw.choice([True, False, False, None])))
    schema = f"key long, ts timestamp, event_id {'long' if ids == 'number' else 'string'}, ok boolean"
    calls = spark.createDataFrame(rows, schema).repartition(3)
    rule = BreakerRule(2, 30)
    plain, hot = (breaker_timeline(calls, rule, hot_rows=n) for n in (1000, 2))
    assert rows_of(plain) == rows_of(hot)
    assert {r.key for r in plain.collect()} == set(keys)
    # A call without an outcome counts as failed, as far as the state goes.
    settled = breaker_timeline(calls.withColumn("ok", F.coalesce("ok", F.lit(False))), rule).drop("ok")
    assert rows_of(plain.drop("ok")) == rows_of(settled)


def test_cache_with_ids_of_their_own_per_key(spark):
    rows = [(q, n, T0 + timedelta(seconds=4 * i), i) for q in ("a", "b", None) for n in (5, None) for i in range(12)]
    lookups = spark.createDataFrame(rows, "query string, num_results int, ts timestamp, lookup_id long").repartition(3)
    assert rows_of(ttl_lookups(lookups, 25, hot_rows=1000)) == rows_of(ttl_lookups(lookups, 25, hot_rows=2))


@pytest.mark.parametrize("hot_rows", [1000, 1])
@pytest.mark.parametrize(
    ("kind", "first", "second"),
    [("string", "x" * 26 + "1", "x" * 26 + "2"), ("long", -5, -3), ("long", 3, 20), ("double", -0.5, 0.25)],
)
def test_facts_of_one_time_are_ordered_by_their_own_id(spark, kind, first, second, hot_rows):
    entries = [("q", 5, T0, second, ["new"]), ("q", 5, T0, first, ["old"])]
    known = spark.createDataFrame(entries, f"query string, num_results int, ts timestamp, entry_id {kind}, results array<string>")
    asked = spark.createDataFrame([("r" * 40, "q", 5, T0)], "request_id string, query string, num_results int, ts timestamp")
    served = serve_from_cache(asked, known, 60, hot_rows=hot_rows).first()
    assert (served.hit, served.entry_id, served.results) == (True, second, ["new"])
    line = [("k", T0, second, "closed", None), ("k", T0, first, "open", T0)]
    told = spark.createDataFrame(line, f"key string, ts timestamp, event_id {kind}, state string, opened_at timestamp")
    met = guard_searches(asked.select("request_id", F.lit("k").alias("key"), "ts"), told, BreakerRule(), hot_rows)
    assert met.first().state == "closed"


WHOLE = ['{"next_agent": "research"}', ' \n{"next_agent": "research"}\t', '{"next_agent": "a}b]", "x": [1, {"y": "}"}]}']
BROKEN = [
    '{"next_agent": "research"} thanks}', '{"next_agent": "research"} {"a": 1}', '{"next_agent": "research"}, {}',
    '[{"next_agent": "research"}]', '{"next_agent": "research"', "{} x", '"{}"', "", " ", None,
]


def test_json_with_text_behind_it_is_no_json(spark):
    told = spark.createDataFrame([(i, t) for i, t in enumerate(WHOLE + BROKEN)], "i int, t string")
    read = told.select(
        "i", "t", json_object(F.col("t")).isNotNull().alias("good"), decision(F.col("t")).alias("agent"),
        finance_output(F.col("t"))["summary"].alias("fin"), document_output(F.col("t"))["raw_response"].alias("raw"),
    )
    for r in read.collect():
        assert r.good == (r.i < len(WHOLE)), r.t
        if not r.good:
            assert (r.agent, r.fin, r.raw) == (None, r.t or "", r.t or "")
    lines = parse_lines(told.select(F.col("t").alias("value")).filter("value like '%thanks}'")).first()
    assert lines.bad_line is not None and lines.msg is None


def test_lists_with_text_behind_them_are_no_lists(spark):
    texts = ['["a", "b"]', '["a", "b"] here you are', '["a"] ["b"]', '["a"', "[]", '{"a": 1}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.q for r in df.select(subqueries(F.lit(" whole "), F.col("t")).alias("q")).collect()]
    assert got == [["a", "b"], ["whole"], ["whole"], ["whole"], [], ["whole"]]


def test_rounding_equals_python_at_every_size(spark):
    draw = random.Random(2)
    values = [draw.uniform(4e13, 7.2e13) for _ in range(800)] + [draw.uniform(7e13, 1e16) for _ in range(200)]
    values += [draw.uniform(-1, 1) * 10.0 ** draw.randint(0, 14) for _ in range(800)]
    values += [k / 200 for k in range(-400, 400)] + [2.0**45 + k / 128 for k in range(256)] + [float(1 << 46), -0.0, 0.005]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", round2(F.col("x")).alias("r"))
    wrong = [(r.x, r.r, round(r.x, 2)) for r in df.collect() if r.r != round(r.x, 2)]
    assert not wrong


@pytest.mark.parametrize(
    ("text", "entry", "top", "low", "size", "status"),
    [
        ("成本價 1,280，壓力 1,500.5，支撐 1,100", 1280.0, 1500.5, 1100.0, None, "ok"),
        ("成本價大約是每股新台幣 233.5 元，壓力 280，支撐 210", 233.5, 280.0, 210.0, None, "ok"),
        ("我以 233.5 作為成本價，壓力 280", None, 280.0, None, None, "not_found"),
        ("成本價２３３．５，壓力２８０，支撐２１０，持股數量 2,000 股", 233.5, 280.0, 210.0, 2000.0, "ok"),
        ("成本價；壓力 280，支撐 1", None, 280.0, 1.0, None, "not_found"),
        ("成本價與目標價都是 300，支撐 250", None, 300.0, 250.0, None, "not_found"),
        ("持股 10 進場價 5 壓力 6 停損價 -1", 5.0, 6.0, -1.0, 10.0, "ok"),
    ],
)
def test_numbers_of_a_text(spark, text, entry, top, low, size, status):
    r = params_from_text(spark.createDataFrame([(text,)], "user_input string")).first()
    assert (r.entry_price, r.resistance, r.support, r.position_size, r.status) == (entry, top, low, size, status)


def test_a_quoted_number_gives_an_error(spark):
    told = '{"found": true, "entry_price": "233.5", "resistance": 280, "support": 243, "position_size": %s}'
    rows = [("quoted", told % "null"), ("size", told.replace('"233.5"', "233.5") % '"ten"'), ("good", told.replace('"233.5"', "233.5") % "10")]
    df = validated_params(spark.createDataFrame([(n, "q", c) for n, c in rows], "name string, user_input string, content string"))
    leveled = position_levels(df.withColumnRenamed("status", "param_status"))
    told = numbers_json(leveled.withColumn("has_params", F.col("param_status") == "ok"))
    got = {r.name: (r.param_status, r.numbers) for r in told.collect()}
    assert got["quoted"] == got["size"] == ("bad_type", '{"error":"參數錯誤: bad_type"}')
    assert got["good"][0] == "ok" and "position_value" in got["good"][1]


def test_a_null_client_is_a_client(spark):
    rows = [(c, T0 + timedelta(seconds=i), i) for c in (None, "a") for i in range(5)]
    got = admit(spark.createDataFrame(rows, "client string, ts timestamp, request_key int"), limit=2)
    assert {(r.client, r.request_key): r.admitted for r in got.collect()} == {(c, i): i < 2 for c in (None, "a") for i in range(5)}


def test_prompts_are_asked_in_many_tasks(spark):
    from pyspark import TaskContext

    df = spark.createDataFrame([(i, f"p{i % 40}") for i in range(80)], "i int, prompt string")
    told = batch_infer(df, "prompt", lambda p: str(TaskContext.get().partitionId()) if TaskContext.get() else "x", concurrency=1)
    assert told.count() == 80 and told.select("response").distinct().count() > 3


def test_stored_nulls_are_asked_again_and_retries_go_in_rounds(spark):
    df = spark.createDataFrame([("a",), ("b",), ("bad",), (None,)], "prompt string")
    stored = spark.createDataFrame([("a", None), ("b", "kept")], "prompt string, response string")

    def model(prompt):
        if prompt == "bad":
            raise ValueError("rate limit 429")
        return "new"

    told = {r.prompt: (r.response, r.attempts) for r in batch_infer(df, "prompt", model, stored, sleep=lambda s: None).collect()}
    assert told["a"] == ("new", 1) and told["b"] == ("kept", None) and told[None] == (None, None)
    assert told["bad"][0] is None and told["bad"][1] == 4


def test_states_of_other_threads_stay(spark, tmp_path):
    path = str(tmp_path / "states")
    schema = "thread_id string, final_answer string"
    write_thread_states(spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], schema), path, buckets=2)
    write_thread_states(spark.createDataFrame([("b", "2"), ("d", "2")], schema), path, buckets=2)
    assert {r.thread_id: r.final_answer for r in thread_states(spark, path).collect()} == {"a": "1", "b": "2", "c": "1", "d": "2"}
    assert read_thread_state(spark, path, "b").first().final_answer == "2"


def test_null_thread_has_one_state(spark, tmp_path):
    path = str(tmp_path / "states")
    schema = "thread_id string, final_answer string"
    write_thread_states(spark.createDataFrame([(None, "1"), ("a", "1")], schema), path, buckets=2)
    write_thread_states(spark.createDataFrame([(None, "2")], schema), path, buckets=2)
    assert sorted(map(str, (r.final_answer for r in thread_states(spark, path).collect()))) == ["1", "2"]
    assert read_thread_state(spark, path, None).first().final_answer == "2"


def test_json_may_hold_any_text(spark):
    """Nothing inside a value makes it bad; text behind a value still does."""
    texts = [
        '{"a":"#end#"}', '"#end#"', '{"a":1}', "[1,2]", " 7 ", '{"a":1},2', '{"a":1}],[2', '{"a":1} x', '1,"#end#"],[2', "", None,
        "1,2", "]", '"]["',
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    good = {r.i for r in rows.filter(json_value(F.col("t")).isNotNull()).collect()}
    assert good == {0, 1, 2, 3, 4, 13}
    assert rows.filter("i = 0").select(json_field(json_object(F.col("t")), "a")).first()[0] == "#end#"


def test_errors_of_one_step_all_count(spark):
    schema = "thread_id string, step long, completed_agents array<string>, errors array<string>"
    rows = [("t", 1, None, ["e1"]), ("t", 1, ["a"], ["e2"]), ("t", None, None, ["x"]), ("t", None, ["b"], ["x", "y"]), ("u", 0, None, None)]
    states = {r.thread_id: r for r in thread_state(spark.createDataFrame(rows, schema)).collect()}
    assert states["t"].errors == ["x", "x", "y", "e1", "e2"] and states["t"].completed_agents == ["b", "a"]
    assert states["u"].errors == [] and states["u"].completed_agents == []
