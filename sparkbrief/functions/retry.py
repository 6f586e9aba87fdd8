"""Which errors are worth a retry, and how long to wait."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
RETRYABLE = ("429", "503", "overloaded", "rate limit", "service unavailable")
MAX_ATTEMPTS = 4
WAIT_MIN = 1.0
WAIT_MAX = 30.0
JITTER = 0.5


def is_retryable(message: Column) -> Column:
    return F.coalesce(F.lower(message).rlike("|".join(RETRYABLE)), F.lit(False))


def _base(attempt: Column, wait_min: float) -> Column:
    return F.lit(wait_min) * F.pow(F.lit(2.0), attempt - 1)


def backoff_delay(attempt: Column, wait_min: float = WAIT_MIN, wait_max: float = WAIT_MAX) -> Column:
    """Doubling delay with random jitter, capped."""
    return F.least(_base(attempt, wait_min) + F.rand() * F.lit(JITTER), F.lit(wait_max))


def backoff_bounds(
    attempt: Column, wait_min: float = WAIT_MIN, wait_max: float = WAIT_MAX
) -> tuple[Column, Column]:
    """Least and greatest delay that ``backoff_delay`` can give."""
    base = _base(attempt, wait_min)
    return F.least(base, F.lit(wait_max)), F.least(base + F.lit(JITTER), F.lit(wait_max))
