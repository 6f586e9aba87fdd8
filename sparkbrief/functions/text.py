"""Text rules: strip, blank test, tokens, breaker key, error text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BREAKER_PREFIX = "ddg_search:"
BREAKER_KEY_CHARS = 20

_HAN = r"\p{IsHan}"


def strip(text: Column) -> Column:
    """Remove white space of every kind at both ends; ``trim`` knows only the space."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def not_blank(text: Column) -> Column:
    return F.coalesce(strip(text) != "", F.lit(False))


def _han_pairs(token: Column) -> Column:
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.char_length(token) - 1, F.lit(1))),
        lambda i: F.substring(token, i, F.lit(2)),
    )
    return F.when(token.rlike(_HAN), pairs).otherwise(F.array(token))


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits; runs of Han characters become 2-grams."""
    low = F.lower(text)
    words = F.array_remove(F.split(low, r"[^\p{L}\p{N}]+"), "")
    edges = F.split(
        low,
        rf"[^\p{{L}}\p{{N}}]+|(?<={_HAN})(?=[\p{{L}}\p{{N}}&&[^{_HAN}]])"
        rf"|(?<=[\p{{L}}\p{{N}}&&[^{_HAN}]])(?={_HAN})",
    )
    mixed = F.flatten(F.transform(F.array_remove(edges, ""), _han_pairs))
    # ASCII text is told from its length alone.
    has_han = (F.octet_length(low) != F.char_length(low)) & low.rlike(_HAN)
    return F.when(has_han, mixed).otherwise(words)


def breaker_key(query: Column) -> Column:
    return F.concat(F.lit(BREAKER_PREFIX), F.substring(query, 1, BREAKER_KEY_CHARS))


def search_error_text(query: Column, error: Column) -> Column:
    return F.concat(F.lit("查詢「"), query, F.lit("」失敗: "), error)
