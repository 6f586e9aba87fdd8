"""Column expressions: rounding, text, JSON and retry rules."""

from sparkbrief.functions.jsontext import (
    has_key,
    is_list,
    is_number,
    is_string,
    json_field,
    json_object,
    json_value,
    truthy,
)
from sparkbrief.functions.numbers import round2, with_rounded
from sparkbrief.functions.retry import backoff_bounds, backoff_delay, is_retryable
from sparkbrief.functions.text import breaker_key, not_blank, search_error_text, strip, tokens

__all__ = [
    "backoff_bounds",
    "backoff_delay",
    "breaker_key",
    "has_key",
    "is_list",
    "is_number",
    "is_retryable",
    "is_string",
    "json_field",
    "json_object",
    "json_value",
    "not_blank",
    "round2",
    "search_error_text",
    "strip",
    "tokens",
    "truthy",
    "with_rounded",
]
