import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkbrief.functions import tokens
from sparkbrief.operators.requests import accepted, expand, rejected, request_id, with_defaults
from sparkbrief.operators.research import failed, research_report, research_summary
from sparkbrief.operators.search import search_topk

RESULTS = "array<struct<title:string,href:string,body:string>>"


def test_expansion(spark):
    rows = [
        ("a", "正常輸入", "broken"),
        ("b", "   ", '["x"]'),
        ("c", "", None),
        ("d", "q", '["1","2","3","4","5","6","7"]'),
        ("e", "q", "[]"),
        ("f", " q ", '{"a": 1}'),
        ("g", "q", None),
        ("h", "q", '["a", 5, null]'),
    ]
    df = spark.createDataFrame(rows, "id string, user_input string, response string")
    got = {}
    for r in expand(df).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r.query)
    assert got == {
        "a": ["正常輸入"], "d": ["1", "2", "3", "4", "5"], "f": ["q"], "g": ["q"], "h": ["a", "5"],
    }


def test_request_defaults(spark):
    rows = [("q", None, None), ("q", "", 0), ("q", "t", -3), (None, "t", 1)]
    df = spark.createDataFrame(rows, "user_input string, thread_id string, max_steps int")
    assert rejected(df).count() == 1
    got = with_defaults(accepted(df)).collect()
    assert [r.max_steps for r in got] == [8, 8, -3]
    assert len(got[0].thread_id) == len(got[1].thread_id) == 36 and got[2].thread_id == "t"


def test_request_id(spark):
    rows = [([("Host", "h"), ("X-REQUEST-id", "a"), ("x-request-id", "b")],), ([("x-request-id", "")],), ([],)]
    df = spark.createDataFrame(rows, "headers array<struct<name:string,value:string>>")
    first, empty, none = [r.rid for r in df.select(request_id(F.col("headers")).alias("rid")).collect()]
    assert first == "a" and len(empty) == len(none) == 36


def test_report(spark):
    requests = spark.createDataFrame(
        [("blank", "", []), ("one", "q", ["earlier"]), ("bad", "q", []), ("none", "q", [])],
        "request_id string, user_input string, errors array<string>",
    )
    hit = ("結果一", "http://a", None)
    searches = spark.createDataFrame(
        [
            ("one", 1, "二", [], "CircuitBreaker OPEN"),
            ("one", 0, "一", [hit], None),
            ("bad", 0, "q", [], "network error"),
        ],
        f"request_id string, pos int, query string, results {RESULTS}, error string",
    )
    assert failed(searches).count() == 2
    responses = spark.createDataFrame(
        [("one", '{"summary": "結果一", "sources": ["http://a"]}')], "request_id string, response string"
    )
    got = {r.request_id: r for r in research_report(requests, searches, responses).collect()}
    assert (got["blank"].summary, got["blank"].raw, got["blank"].errors) == ("無有效查詢內容", [], None)
    one = got["one"]
    assert (one.summary, one.sources, one.subqueries_used) == ("結果一", ["http://a"], ["一", "二"])
    assert one.errors == ["earlier", "查詢「二」失敗: CircuitBreaker OPEN"]
    assert [(h.title, h.body) for h in one.hits] == [("結果一", "")]
    assert [r.error for r in one.raw] == [None, "CircuitBreaker OPEN"]
    assert got["bad"].errors == ["查詢「q」失敗: network error"]
    assert got["bad"].summary == got["none"].summary == "無搜尋結果"


def test_summary_fallbacks(spark):
    rows = [("x",), ('{"summary": "s"}',), ('{"sources": ["a"]}',), ("[1]",)]
    df = spark.createDataFrame(rows, "r string").select(
        research_summary(F.array(F.lit(1)), F.col("r")).alias("s")
    )
    assert [(r.s.summary, r.s.sources) for r in df.collect()] == [
        ("摘要無法產生", []), ("s", []), ("無摘要", ["a"]), ("摘要無法產生", []),
    ]


def test_tokens(spark):
    rows = [("AI模型 測試,Hello",), ("單 x1",), ("!!",), ("Éa-b",)]
    got = [r.t for r in spark.createDataFrame(rows, "s string").select(tokens(F.col("s")).alias("t")).collect()]
    assert got == [["ai", "模型", "測試", "hello"], ["單", "x1"], [], ["éa", "b"]]


def best_by_hand(queries, corpus, k=5):
    docs = {d: body.split() for d, body in corpus}
    n, average = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for words in docs.values() for w in set(words))
    out = []
    for query in set(queries):
        scores = {}
        for d, words in docs.items():
            total = 0
            for w in set(query.split()):
                tf = float(words.count(w))
                if tf:
                    idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                    part = tf * (1.2 + 1.0) / (tf + 1.2 * (1.0 - 0.75 + 0.75 * len(words) / average))
                    total += math.floor(1_000_000 * (idf * part))
            if total > 0:
                scores[d] = total
        ranked = sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:k]
        out += [(query, i + 1, d, s) for i, (d, s) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_search_equals_brute_force(spark, seed):
    """Common words in a third and more of the documents, copies, and words that only one has."""
    rng = random.Random(seed)
    words = ["the", "of"] * 40 + ["in", "mid"] * 10 + [f"w{i}" for i in range(60)]
    corpus = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for i in range(150)]
    corpus += [(200 + i, corpus[3][1]) for i in range(60)]
    queries = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(30)]
    queries += ["the of", "the", "absent", "w1 w2 the of in mid"]
    got = search_topk(
        spark.createDataFrame([(q,) for q in queries + queries[:5]], "query string"),
        spark.createDataFrame(corpus, "doc_id int, body string"),
    )
    assert sorted((r["query"], r["rank"], r.doc_id, r.score) for r in got.collect()) == best_by_hand(queries, corpus)


def test_search_han_and_empty(spark):
    corpus = spark.createDataFrame([(1, "電解銅 貿易"), (2, "電解質"), (3, None)], "doc_id int, body string")
    queries = spark.createDataFrame([("電解銅貿易融資",), ("",)], "query string")
    assert [(r.doc_id, r["rank"]) for r in search_topk(queries, corpus).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    none = search_topk(queries, corpus.filter("doc_id = 3"))
    assert none.columns == ["query", "rank", "doc_id", "score"] and none.count() == 0
