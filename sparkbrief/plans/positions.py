"""Positions made of parts and what they were sold for."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbrief.operators.positions import (
    chosen_params,
    numbers_json,
    params_from_text,
    position_levels,
    validated_params,
)
from sparkbrief.operators.responses import finance_payload
from sparkbrief.sources.tables import spread, table


def sql_round2(x: str) -> str:
    """Python's two-digit rounding in SQL; the same exact product split as ``functions.round2``."""
    high = f"(({x}) * 134217729.0::DOUBLE - (({x}) * 134217729.0::DOUBLE - ({x})))"
    product = f"(({x}) * 100.0::DOUBLE)"
    whole = f"floor({product})"
    part = f"({product} - {whole})"
    lost = f"(({high} * 100.0::DOUBLE - {product}) + (({x}) - {high}) * 100.0::DOUBLE)"
    return (
        f"(CASE WHEN isinf({x}) THEN {x} ELSE ({whole} + CASE WHEN {part} > 0.5::DOUBLE OR ({part} = 0.5::DOUBLE AND "
        f"({lost} > 0 OR ({lost} = 0 AND {whole} % 2 <> 0))) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / 100.0::DOUBLE END)"
    )


def _priced_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Each sold part: list price to enter, highest and lowest unit price, quantity sold."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    sold = (
        table(spark, sf, "lineitem")
        .groupBy("l_partkey")
        .agg(
            F.max(unit).alias("resistance"),
            F.min(unit).alias("support"),
            F.sum("l_quantity").alias("position_size"),
        )
    )
    part = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("entry_price"))
    return part.join(sold, F.col("p_partkey") == F.col("l_partkey")).drop("l_partkey")


_PRICED_SQL = """
priced AS (
  SELECT p_partkey, p_retailprice AS entry_price, resistance, support, position_size
  FROM part JOIN (
    SELECT l_partkey, max(l_extendedprice / l_quantity) AS resistance,
           min(l_extendedprice / l_quantity) AS support, sum(l_quantity) AS position_size
    FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey),
raw AS (
  SELECT *, (resistance - entry_price) / entry_price * 100.0::DOUBLE AS up,
         abs(entry_price - support) / entry_price * 100.0::DOUBLE AS down,
         entry_price + (resistance - entry_price) * 0.5::DOUBLE AS mid
  FROM priced),
ratios AS (
  SELECT *, CASE WHEN down > 0 THEN up / down ELSE 'Infinity'::DOUBLE END AS ratio FROM raw)
"""


def position_levels_query(spark: SparkSession, sf: str) -> DataFrame:
    return position_levels(_priced_parts(spark, sf)).select(
        "p_partkey", "entry_price", "resistance", "support", "position_size",
        "upside_pct", "downside_pct", "risk_reward_ratio",
        "exit_tiers.tier_1_exit", "exit_tiers.tier_2_exit", "exit_tiers.stop_loss", "position_value",
    )


POSITION_LEVELS_SQL = f"""
WITH {_PRICED_SQL}
SELECT p_partkey, entry_price, resistance, support, position_size,
       {sql_round2("up")} AS upside_pct, {sql_round2("down")} AS downside_pct,
       {sql_round2("ratio")} AS risk_reward_ratio,
       {sql_round2("mid")} AS tier_1_exit, {sql_round2("resistance")} AS tier_2_exit,
       {sql_round2("support")} AS stop_loss, {sql_round2("entry_price * position_size")} AS position_value
FROM ratios
"""


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    """An extraction response per part; the part key picks its defect."""
    price = F.col("p_retailprice")
    kind = F.col("p_partkey") % 10

    def number(column) -> F.Column:
        return column.cast("string")

    def body(entry, top, low, size) -> F.Column:
        return F.concat(
            F.lit('{"found": true, "entry_price": '), entry, F.lit(', "resistance": '), top,
            F.lit(', "support": '), low, F.lit(', "position_size": '), size, F.lit("}"),
        )

    null = F.lit("null")
    entry, top, low = number(price), number(price + 20.0), number(price - 10.0)
    content = (
        F.when(kind == 0, body(entry, top, low, F.lit("100")))
        .when(kind == 1, body(entry, top, low, null))
        .when(kind == 2, F.concat(F.lit("price "), entry))
        .when(kind == 3, F.lit('{"found": false}'))
        .when(kind == 4, body(null, top, low, null))
        .when(kind == 5, body(entry, null, null, null))
        .when(kind == 6, body(entry, top, null, null))
        .when(kind == 7, body(F.concat(F.lit('"'), entry, F.lit('"')), top, low, null))
        .when(kind == 8, body(F.lit("0"), top, low, null))
        .otherwise(body(entry, top, low, null))
    )
    asked = F.when(kind == 9, F.lit(" \n")).otherwise(F.col("p_name"))
    given = F.when(
        F.col("p_partkey") % 7 == 0,
        F.struct(
            F.lit(100.0).alias("entry_price"), F.lit(120.0).alias("resistance"),
            F.lit(90.0).alias("support"), F.lit(10.0).alias("position_size"),
        ),
    )
    return spread(table(spark, sf, "part")).select(
        "p_partkey", asked.alias("user_input"), content.alias("content"), given.alias("given")
    )


def position_params_status(spark: SparkSession, sf: str) -> DataFrame:
    names = ["entry_price", "resistance", "support", "position_size"]
    checked = validated_params(_responses(spark, sf)).withColumnRenamed("status", "param_status")
    chosen = chosen_params(checked.withColumn("extracted", F.struct(*names)))
    leveled = position_levels(chosen.drop(*names).select("*", "params.*"))
    has_params = F.col("given").isNotNull() | (F.col("param_status") == "ok")
    told = numbers_json(leveled.withColumn("has_params", F.coalesce(has_params, F.lit(False))))
    return told.select(
        "p_partkey",
        "param_status",
        "entry_price",
        F.get_json_object("numbers", "$.error").alias("error"),
        F.get_json_object("numbers", "$.exit_tiers.tier_1_exit").cast("double").alias("tier_1_exit"),
        F.get_json_object("numbers", "$.position_value").cast("double").alias("position_value"),
        (F.col("numbers") == "{}").alias("no_numbers"),
    )


POSITION_PARAMS_STATUS_SQL = f"""
WITH kinds AS (
  SELECT p_partkey, p_retailprice AS price, p_partkey % 10 AS kind, p_partkey % 7 = 0 AS given FROM part),
checked AS (
  SELECT *, CASE kind WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'bad_json' WHEN 3 THEN 'not_found'
    WHEN 4 THEN 'missing_entry' WHEN 5 THEN 'missing_levels' WHEN 6 THEN 'partial_levels'
    WHEN 7 THEN 'bad_type' WHEN 8 THEN 'ok' ELSE 'blank' END AS param_status
  FROM kinds),
chosen AS (
  SELECT *, CASE WHEN given THEN 100.0::DOUBLE WHEN kind = 8 THEN 0.0::DOUBLE
      WHEN param_status = 'ok' THEN price END AS entry_price,
    CASE WHEN given THEN 120.0::DOUBLE ELSE price + 20.0::DOUBLE END AS top,
    CASE WHEN given THEN 10.0::DOUBLE WHEN kind = 0 THEN 100.0::DOUBLE END AS size
  FROM checked),
mids AS (SELECT *, entry_price + (top - entry_price) * 0.5::DOUBLE AS mid, entry_price * size AS worth FROM chosen)
SELECT p_partkey, param_status, entry_price,
  CASE WHEN entry_price = 0 THEN '參數錯誤: zero_entry'
    WHEN param_status = 'bad_type' AND NOT given THEN '參數錯誤: bad_type' END AS error,
  CASE WHEN entry_price <> 0 THEN {sql_round2("mid")} END AS tier_1_exit,
  CASE WHEN entry_price <> 0 THEN {sql_round2("worth")} END AS position_value,
  entry_price IS NULL AND param_status <> 'bad_type' AS no_numbers
FROM mids
"""


def position_text_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers read from a sentence about each part."""
    price = F.col("p_retailprice").cast("string")
    kind = F.col("p_partkey") % 10
    thousands = F.format_number(F.col("p_retailprice"), 2)
    text = (
        F.when(kind == 0, F.concat(F.lit("我的成本價是 "), price, F.lit("，壓力 280，支撐 243")))
        .when(kind == 1, F.concat(F.lit("進場價："), price, F.lit("，目標價 300 元")))
        .when(kind == 2, F.concat(F.col("p_name"), F.lit(" 怎麼看？")))
        .when(kind == 3, F.lit("  "))
        .when(kind == 4, F.concat(F.lit("買進價"), price, F.lit("，阻力：2000.5，停損價 -1")))
        .when(kind == 5, F.concat(F.lit("成本價大約是每股新台幣 "), thousands, F.lit(" 元；壓力在 1,280，支撐 ９５．５，持股數量 2,000 股")))
        .when(kind == 6, F.concat(F.lit("我以 "), price, F.lit(" 作為成本價，壓力 280")))
        .when(kind == 7, F.concat(F.lit("成本價和壓力：300，支撐 "), price))
        .when(kind == 8, F.concat(F.lit("持股 50，進場價是 "), price, F.lit("，目標價 1,234,567.25")))
        .otherwise(F.lit("成本價，壓力 280，支撐 243"))
    )
    asked = table(spark, sf, "part").select("p_partkey", text.alias("user_input"))
    return params_from_text(asked).select(
        "p_partkey", "entry_price", "resistance", "support", "position_size", "found", "status"
    )


POSITION_TEXT_EXTRACT_SQL = """
SELECT p_partkey,
  CASE WHEN k IN (0, 1, 4, 5, 8) THEN price END AS entry_price,
  CASE k WHEN 0 THEN 280.0 WHEN 1 THEN 300.0 WHEN 4 THEN 2000.5 WHEN 5 THEN 1280.0 WHEN 6 THEN 280.0
    WHEN 7 THEN 300.0 WHEN 8 THEN 1234567.25 WHEN 9 THEN 280.0 END::DOUBLE AS resistance,
  CASE k WHEN 0 THEN 243.0 WHEN 4 THEN -1.0 WHEN 5 THEN 95.5 WHEN 7 THEN price WHEN 9 THEN 243.0 END::DOUBLE AS support,
  CASE k WHEN 5 THEN 2000.0 WHEN 8 THEN 50.0 END::DOUBLE AS position_size,
  k IN (0, 1, 4, 5, 8) AS found,
  CASE WHEN k = 3 THEN 'blank' WHEN k IN (1, 8) THEN 'partial_levels' WHEN k IN (0, 4, 5) THEN 'ok' ELSE 'not_found' END AS status
FROM (SELECT p_partkey, p_partkey % 10 AS k, p_retailprice AS price FROM part)
"""


def finance_payload_query(spark: SparkSession, sf: str) -> DataFrame:
    """Levels put into a payload and read back from its JSON."""
    leveled = position_levels(_priced_parts(spark, sf)).withColumn("has_params", F.lit(True))
    asked = F.concat(F.lit("part "), F.col("p_partkey").cast("string"))
    payload = numbers_json(leveled).select("p_partkey", finance_payload(asked, F.col("numbers")).alias("payload"))

    def number(path: str) -> F.Column:
        return F.get_json_object("payload", f"$.calculated_numbers.{path}").cast("double")

    return payload.select(
        "p_partkey",
        F.get_json_object("payload", "$.user_input").alias("user_input"),
        number("upside_pct").alias("upside_pct"),
        number("risk_reward_ratio").alias("risk_reward_ratio"),
        number("exit_tiers.stop_loss").alias("stop_loss"),
        number("position_value").alias("position_value"),
    )


FINANCE_PAYLOAD_SQL = f"""
WITH {_PRICED_SQL}
SELECT p_partkey, 'part ' || p_partkey AS user_input, {sql_round2("up")} AS upside_pct,
       {sql_round2("ratio")} AS risk_reward_ratio, {sql_round2("support")} AS stop_loss,
       {sql_round2("entry_price * position_size")} AS position_value
FROM ratios
"""

QUERIES = {
    "position_levels": (position_levels_query, POSITION_LEVELS_SQL),
    "position_params_status": (position_params_status, POSITION_PARAMS_STATUS_SQL),
    "position_text_extract": (position_text_extract, POSITION_TEXT_EXTRACT_SQL),
    "finance_payload": (finance_payload_query, FINANCE_PAYLOAD_SQL),
}
