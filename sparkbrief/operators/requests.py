"""Requests: required input, defaults, request ids, and expansion into subqueries."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkbrief.functions import is_list, not_blank, strip

# Fixed values.
MAX_STEPS = 8
MAX_SUBQUERIES = 5


def accepted(requests: DataFrame) -> DataFrame:
    """Requests that carry ``user_input``; the empty text counts as given."""
    return requests.filter(F.col("user_input").isNotNull())


def rejected(requests: DataFrame) -> DataFrame:
    return requests.filter(F.col("user_input").isNull())


def with_defaults(requests: DataFrame, max_steps: int = MAX_STEPS) -> DataFrame:
    """Fill a missing or empty thread id and a missing or zero step limit.

    New ids are random: write the result once before it is used twice.
    """
    return requests.withColumns(
        {
            "job_id": F.uuid(),
            "thread_id": F.coalesce(F.nullif("thread_id", F.lit("")), F.uuid()),
            "max_steps": F.coalesce(F.nullif("max_steps", F.lit(0)), F.lit(max_steps)),
        }
    )


def request_id(headers: Column) -> Column:
    """First ``x-request-id`` header, whatever its case; a new id if it is absent or empty."""
    named = F.filter(headers, lambda h: F.lower(h["name"]) == "x-request-id")
    return F.coalesce(F.nullif(F.get(named, F.lit(0))["value"], F.lit("")), F.uuid())


def subqueries(user_input: Column, response: Column) -> Column:
    """Subqueries of a request from the JSON array in ``response``.

    At most five, as text; the stripped input if the response is no array;
    none for a blank request.
    """
    parsed = F.when(is_list(response), F.from_json(strip(response), T.ArrayType(T.StringType())))
    listed = F.filter(F.slice(parsed, 1, MAX_SUBQUERIES), lambda q: q.isNotNull())
    return F.when(
        not_blank(user_input), F.coalesce(listed, F.array(strip(user_input)))
    ).otherwise(F.array().cast("array<string>"))


def expand(requests: DataFrame, response: str = "response") -> DataFrame:
    """One row per subquery: the columns of the request without the response, ``pos`` and ``query``."""
    kept = [c for c in requests.columns if c != response]
    listed = subqueries(F.col("user_input"), F.col(response))
    return requests.select(*kept, F.posexplode(listed).alias("pos", "query"))
