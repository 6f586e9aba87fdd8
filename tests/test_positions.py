import json
import math
import random

import pytest
from pyspark.sql import functions as F

from sparkbrief.functions import round2, with_rounded
from sparkbrief.operators.positions import (
    chosen_params,
    numbers_json,
    params_from_text,
    position_levels,
    validated_params,
)

POSITION = "entry_price double, resistance double, support double, position_size double"


def levels(spark, *row):
    return position_levels(spark.createDataFrame([row], POSITION)).first()


def test_published_case(spark):
    got = levels(spark, 233.5, 280.0, 243.0, None)
    assert got.upside_pct == pytest.approx(19.91, rel=1e-3)
    assert got.downside_pct == pytest.approx(4.07, rel=1e-3)
    assert got.risk_reward_ratio == pytest.approx(4.89, rel=1e-2)
    assert (got.exit_tiers.tier_2_exit, got.exit_tiers.stop_loss) == (280.0, 243.0)
    assert got.position_value is None


def test_value_infinity_and_zero(spark):
    assert levels(spark, 100.0, 120.0, 90.0, 10.0).position_value == 1000.0
    assert levels(spark, 100.0, 120.0, 90.0, 0.0).position_value == 0.0
    assert levels(spark, 100.0, 120.0, 100.0, None).risk_reward_ratio == math.inf
    zero = levels(spark, 0.0, 1.0, 1.0, 1.0)
    assert (zero.status, zero.upside_pct, zero.exit_tiers) == ("zero_entry", None, None)
    missing = levels(spark, 100.0, None, None, None)
    assert (missing.status, missing.exit_tiers) == ("missing_argument", None)


def test_rounding_is_pythons(spark):
    rng = random.Random(2)
    values = [rng.uniform(-1e4, 1e4) for _ in range(3000)]
    values += [i / 1000 for i in range(5, 20_000, 10)] + [i / 8 for i in range(-40, 40)]
    values += [2.675, 1.005, 0.0, 1e15, 4e13 - 0.13]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    rows = with_rounded(rows.withColumn("a", round2(F.col("x"))), {"b": F.col("x") * 1.0})
    assert all(r.a == round(r.x, 2) and r.b == r.a for r in rows.collect())
    odd = spark.createDataFrame([(math.inf,), (None,)], "x double").select(round2(F.col("x")).alias("r"))
    assert [r.r for r in odd.collect()] == [math.inf, None]


RESPONSES = [
    ("not json", "x", "bad_json"),
    ("[1, 2]", "x", "bad_json"),
    ('{"found": false}', "x", "not_found"),
    ('{"found": 0, "entry_price": 1}', "x", "not_found"),
    ('{"found": [], "entry_price": 1}', "x", "not_found"),
    ('{"entry_price": 1}', "x", "not_found"),
    ('{"found": true, "entry_price": null, "resistance": 1, "support": 1}', "x", "missing_entry"),
    ('{"found": true, "entry_price": 1, "resistance": null, "support": null}', "x", "missing_levels"),
    ('{"found": true, "entry_price": 1, "resistance": 2}', "x", "partial_levels"),
    ('{"found": true, "entry_price": "1", "resistance": 2, "support": 3}', "x", "bad_type"),
    ('{"found": "false", "entry_price": 1, "resistance": 2, "support": 3}', "x", "ok"),
    (' {"found": true, "entry_price": 1.5, "resistance": 2, "support": 3, "position_size": 7}\n', "x", "ok"),
    ('{"found": true, "entry_price": 1, "resistance": 2, "support": 3}', " 　", "blank"),
]


def test_response_statuses(spark):
    rows = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(RESPONSES)], "i int, content string, user_input string, expect string"
    )
    got = validated_params(rows).orderBy("i").collect()
    assert [r.status for r in got] == [r.expect for r in got]
    assert [got[11][c] for c in ("entry_price", "resistance", "support", "position_size")] == [1.5, 2, 3, 7]
    assert got[10].position_size is None
    assert got[9].entry_price is None


def test_given_parameters_win(spark):
    rows = spark.createDataFrame(
        [((1.0, 2.0, 3.0, None), (9.0, 9.0, 9.0, 9.0)), (None, (9.0, 9.0, 9.0, 9.0)), (None, None)],
        f"given struct<{POSITION.replace(' double', ':double')}>, extracted struct<{POSITION.replace(' double', ':double')}>",
    )
    got = [r.params for r in chosen_params(rows).collect()]
    assert (got[0].entry_price, got[0].position_size, got[1].entry_price, got[2]) == (1.0, None, 9.0, None)


def test_numbers_json(spark):
    rows = spark.createDataFrame(
        [(100.0, 120.0, 90.0, 10.0, True), (100.0, None, None, None, True), (None, None, None, None, False)],
        POSITION + ", has_params boolean",
    )
    full, broken, none = [r.numbers for r in numbers_json(position_levels(rows)).collect()]
    assert json.loads(full)["exit_tiers"] == {"tier_1_exit": 110.0, "tier_2_exit": 120.0, "stop_loss": 90.0}
    assert list(json.loads(broken)) == ["error"]
    assert none == "{}"


def test_text_rules(spark):
    texts = [
        ("進場價 233.5，壓力 280，支撐 243", "ok", 233.5, 280.0, 243.0),
        ("成本價是100，目標價120", "partial_levels", 100.0, 120.0, None),
        ("壓力 280，支撐 243", "not_found", None, 280.0, 243.0),
        ("台積電怎麼看", "not_found", None, None, None),
        ("  ", "blank", None, None, None),
    ]
    rows = spark.createDataFrame([(i, t[0]) for i, t in enumerate(texts)], "i int, user_input string")
    got = params_from_text(rows).orderBy("i").collect()
    assert [(r.status, r.entry_price, r.resistance, r.support) for r in got] == [t[1:] for t in texts]
