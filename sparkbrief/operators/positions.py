"""Position levels: exit tiers, upside, downside and risk-to-reward of a priced position."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkbrief.functions import (
    has_key,
    is_number,
    json_field,
    json_object,
    not_blank,
    strip,
    truthy,
    with_rounded,
)

_PARAMS = ["entry_price", "resistance", "support", "position_size"]

# Words that name each number in a request.
ENTRY_WORDS = "進場價|成本價|買進價"
RESISTANCE_WORDS = "壓力|阻力|目標價"
SUPPORT_WORDS = "支撐|停損價"
SIZE_WORDS = "持股數量|持股|股數"


def position_levels(positions: DataFrame) -> DataFrame:
    """Add levels to ``entry_price, resistance, support, position_size``.

    The ratio uses unrounded percentages and is infinite without downside. A
    support above the entry price counts as downside. A zero entry price gives
    status ``zero_entry`` and no levels; a missing number ``missing_argument``.
    """
    entry, top, low, size = (F.col(c).cast("double") for c in _PARAMS)
    missing = entry.isNull() | top.isNull() | low.isNull()
    usable = ~missing & (entry != 0.0)
    # The divisor is made safe first: both branches of a conditional may be evaluated.
    by = F.when(entry != 0.0, entry)
    up = (top - entry) / by * 100.0
    down = F.abs(entry - low) / by * 100.0
    judged = positions.withColumn(
        "status",
        F.when(missing, "missing_argument").when(entry == 0.0, "zero_entry").otherwise("ok"),
    )
    percent = judged.withColumns({"_up": F.when(usable, up), "_down": F.when(usable, down)})
    ratio = F.when(
        F.col("_down") > 0.0, F.col("_up") / F.when(F.col("_down") > 0.0, F.col("_down"))
    ).otherwise(F.lit(float("inf")))
    rounded = with_rounded(
        percent,
        {
            "upside_pct": F.col("_up"),
            "downside_pct": F.col("_down"),
            "risk_reward_ratio": F.when(usable, ratio),
            "_tier_1": F.when(usable, entry + (top - entry) * 0.5),
            "_tier_2": F.when(usable, top),
            "_stop": F.when(usable, low),
            "position_value": F.when(usable, entry * size),
        },
    )
    tiers = F.struct(
        F.col("_tier_1").alias("tier_1_exit"),
        F.col("_tier_2").alias("tier_2_exit"),
        F.col("_stop").alias("stop_loss"),
    )
    return rounded.withColumn("exit_tiers", F.when(usable, tiers)).drop(
        "_up", "_down", "_tier_1", "_tier_2", "_stop"
    )


def validated_params(responses: DataFrame, content: str = "content") -> DataFrame:
    """Check extraction responses; add ``status`` and, where it is ``ok``, the four numbers.

    Status is one of blank, bad_json, not_found, missing_entry, missing_levels,
    partial_levels, bad_type, ok; the first that applies. ``user_input`` decides blank.
    """
    # Parsed once, into a column of its own.
    parsed = responses.withColumn("_doc", json_object(F.col(content)))
    doc = F.col("_doc")
    no_top, no_low = ~has_key(doc, "resistance"), ~has_key(doc, "support")
    wrong = F.lit(False)
    for name in _PARAMS:
        wrong = wrong | (has_key(doc, name) & ~is_number(doc, name))
    status = (
        F.when(~not_blank(F.col("user_input")), "blank")
        .when(doc.isNull(), "bad_json")
        .when(~truthy(doc, "found"), "not_found")
        .when(~has_key(doc, "entry_price"), "missing_entry")
        .when(no_top & no_low, "missing_levels")
        .when(no_top | no_low, "partial_levels")
        .when(wrong, "bad_type")
        .otherwise("ok")
    )
    checked = parsed.withColumn("status", status)
    numbers = checked.withColumns(
        {
            name: F.when(F.col("status") == "ok", json_field(doc, name, "double"))
            for name in _PARAMS
        }
    )
    return numbers.drop("_doc")


def chosen_params(df: DataFrame, given: str = "given", extracted: str = "extracted") -> DataFrame:
    """Parameters given by the caller win over extracted ones, as a whole record.

    Adds ``params``: the given struct if any of its fields is set, else the extracted one.
    """
    is_given = F.coalesce(*[F.col(f"{given}.{p}").cast("string") for p in _PARAMS]).isNotNull()
    pick = F.when(is_given, F.col(given)).otherwise(F.col(extracted))
    return df.withColumn("params", pick)


def numbers_json(df: DataFrame) -> DataFrame:
    """Add ``numbers``: JSON of the levels, an ``error`` object, or ``{}`` if nothing was calculated.

    Reads the columns of ``position_levels`` plus ``has_params``, and ``param_status`` if it is there:
    parameters of a wrong type were to be calculated with, so they give an error like a zero entry.
    """
    levels = F.struct(
        "entry_price", "resistance", "support", "upside_pct", "downside_pct",
        "risk_reward_ratio", "exit_tiers", "position_value",
    )
    wrong = F.lit(False)
    if "param_status" in df.columns:
        wrong = ~F.col("has_params") & F.coalesce(F.col("param_status") == "bad_type", F.lit(False))

    def error(status) -> Column:
        return F.to_json(F.struct(F.concat(F.lit("參數錯誤: "), status).alias("error")))

    return df.withColumn(
        "numbers",
        F.when(wrong, error(F.lit("bad_type")))
        .when(~F.col("has_params"), "{}")
        .when(F.col("status") == "ok", F.to_json(levels))
        .otherwise(error(F.col("status"))),
    )


# Full-width forms of what a number is written with.
_WIDE, _NARROW = "０１２３４５６７８９．－", "0123456789.-"
_NUMBER = r"-?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?"
# What a keyword and its number may have between them: no digit, no end of a clause, no other keyword.
_GAP = rf"(?:(?!{ENTRY_WORDS}|{RESISTANCE_WORDS}|{SUPPORT_WORDS}|{SIZE_WORDS})[^0-9\-，。；,;！？!?\n])*"


def _number_after(text: Column, words: str) -> Column:
    found = F.regexp_extract(F.translate(text, _WIDE, _NARROW), rf"(?:{words}){_GAP}({_NUMBER})", 1)
    return F.when(found != "", F.replace(found, F.lit(","), F.lit(""))).cast("double")


def params_from_text(requests: DataFrame, text: str = "user_input") -> DataFrame:
    """Read the numbers that a request names outright: a keyword and the number behind it.

    ``found`` needs an entry price and at least one level; ``status`` follows the checks of
    ``validated_params``. ``position_size`` is read too and may be absent. Thousands separators
    and full-width digits are understood; a number before its keyword is not.
    """
    body = strip(F.col(text))
    words = {
        "entry_price": ENTRY_WORDS, "resistance": RESISTANCE_WORDS, "support": SUPPORT_WORDS, "position_size": SIZE_WORDS,
    }
    read = requests.withColumns({name: _number_after(body, known) for name, known in words.items()})
    entry, top, low = F.col("entry_price"), F.col("resistance"), F.col("support")
    found = entry.isNotNull() & (top.isNotNull() | low.isNotNull())
    return read.withColumns(
        {
            "found": found,
            "status": F.when(~not_blank(F.col(text)), "blank")
            .when(~found, "not_found")
            .when(top.isNull() | low.isNull(), "partial_levels")
            .otherwise("ok"),
        }
    )
