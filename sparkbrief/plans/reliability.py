"""Calls of users, read from events: failures, breakers, caches, limits and retries."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkbrief.functions import breaker_key, is_retryable
from sparkbrief.operators.breaker import (
    BreakerRule,
    breaker_timeline,
    guard_searches,
    status_report,
)
from sparkbrief.operators.cache import serve_from_cache, ttl_lookups, with_fresh_results
from sparkbrief.operators.limits import admit, window_counts
from sparkbrief.operators.outcomes import failure_streaks
from sparkbrief.operators.retries import retry_audit
from sparkbrief.operators.reuse import lru_lookups
from sparkbrief.sources.tables import outcomes_of_events, table
from sparkbrief.staging import staged

# A user's events lie hours apart, so rules measured in seconds would hardly apply.
RULE = BreakerRule(failure_threshold=2, recovery_seconds=43_200, half_open_max_calls=3, success_threshold=2)
TTL_SECONDS = 172_800
DAILY_LIMIT = 5
REPORT_AT = "2024-01-20 00:00:00"


def _plain(name: str):
    """Without time zone, as the given tables have it."""
    return F.col(name).cast("timestamp_ntz").alias(name)


def failure_streaks_query(spark: SparkSession, sf: str) -> DataFrame:
    runs = failure_streaks(outcomes_of_events(table(spark, sf, "events")), threshold=2)
    return runs.select(
        F.col("key").alias("user_id"), "failures", _plain("first_ts"), _plain("last_ts"), "trips"
    )


FAILURE_STREAKS_SQL = """
SELECT user_id, count(*) AS failures, min(ts) AS first_ts, max(ts) AS last_ts, count(*) >= 2 AS trips
FROM (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events)
WHERE event_type = 'error' GROUP BY user_id, island
"""


def breaker_timeline_query(spark: SparkSession, sf: str) -> DataFrame:
    line = breaker_timeline(outcomes_of_events(table(spark, sf, "events")), RULE)
    return line.select(
        F.col("key").alias("user_id"), "event_id", _plain("ts"), "ok", "admitted", "state", _plain("opened_at")
    )


# Held values are those after the event; a new call first lets an old opening lapse.
_CALLS_SQL = """
numbered AS (
  SELECT user_id, event_id, ts, event_type <> 'error' AS ok,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
"""
_LINE_SQL = """
line AS (
  SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS TIMESTAMP) AS ts, true AS ok,
    true AS admitted, 'closed' AS state, 0 AS fails, 0 AS wins, 0 AS probes, CAST(NULL AS TIMESTAMP) AS last
  FROM (SELECT DISTINCT user_id FROM numbered)
  UNION ALL
  SELECT user_id, n, event_id, ts, ok, s <> 'open' AND NOT capped,
    CASE WHEN s = 'open' OR capped THEN s WHEN NOT ok AND (s = 'half_open' OR fails + 1 >= 2) THEN 'open'
      WHEN NOT ok THEN s WHEN s = 'half_open' AND w + 1 >= 2 THEN 'closed' ELSE s END,
    CASE WHEN s = 'open' OR capped THEN fails WHEN NOT ok THEN fails + 1
      WHEN s = 'half_open' AND w + 1 < 2 THEN fails ELSE 0 END,
    CASE WHEN s = 'open' OR capped THEN w WHEN s = 'half_open' AND ok AND w + 1 < 2 THEN w + 1 ELSE 0 END,
    CASE WHEN s = 'open' OR capped THEN p WHEN s = 'half_open' AND ok AND w + 1 < 2 THEN p + 1 ELSE 0 END,
    CASE WHEN s <> 'open' AND NOT capped AND NOT ok THEN ts ELSE last END
  FROM (
    SELECT *, s = 'half_open' AND p >= 3 AS capped FROM (
      SELECT e.user_id, e.n, e.event_id, e.ts, e.ok, l.fails, l.last,
        CASE WHEN l.state = 'open' AND epoch_us(e.ts) - epoch_us(l.last) >= 43200000000 THEN 'half_open' ELSE l.state END AS s,
        CASE WHEN l.state = 'open' THEN 0 ELSE l.wins END AS w,
        CASE WHEN l.state = 'open' THEN 0 ELSE l.probes END AS p
      FROM line l JOIN numbered e ON e.user_id = l.user_id AND e.n = l.n + 1)))
"""
_TIMELINE_SQL = _CALLS_SQL + _LINE_SQL

BREAKER_TIMELINE_SQL = f"""
WITH RECURSIVE {_TIMELINE_SQL}
SELECT user_id, event_id, ts, ok, admitted, state, CASE WHEN state = 'open' THEN last END AS opened_at
FROM line WHERE n > 0
"""


def breaker_local_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Calls numbered anew for each user, some without an outcome; users with many calls are cut into runs."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf, "events").withColumn("n", F.row_number().over(order))
    calls = events.select(
        F.when(F.col("user_id") > 0, F.col("user_id")).alias("key"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("n").cast("string").alias("event_id"),
        F.when(F.col("event_type") != "signup", F.col("event_type") != "error").alias("ok"),
    )
    # Text ids, of ever more digits: their order is that of text, so times alone must tell calls apart.
    calls = calls.withColumn("event_id", F.lpad("event_id", 30, "0"))
    line = breaker_timeline(staged(calls, "calls"), RULE, hot_rows=12, run_rows=2_000)
    return line.select(
        F.col("key").alias("user_id"), F.col("event_id").cast("long").alias("n"), "ok", "admitted", "state", _plain("opened_at")
    )


BREAKER_LOCAL_IDS_SQL = f"""
WITH RECURSIVE numbered AS (
  SELECT user_id, event_id, ts, event_type NOT IN ('error', 'signup') AS ok,
    CASE WHEN event_type <> 'signup' THEN event_type <> 'error' END AS told,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
{_LINE_SQL}
SELECT CASE WHEN l.user_id > 0 THEN l.user_id END AS user_id, n, told AS ok, admitted, state,
  CASE WHEN state = 'open' THEN last END AS opened_at
FROM line l JOIN numbered USING (user_id, n) WHERE n > 0
"""


def _noon_requests(spark: SparkSession, sf: str) -> DataFrame:
    """One request per user and active day, at noon."""
    noon = F.date_trunc("day", F.col("ts").cast("timestamp")) + F.expr("INTERVAL 12 HOURS")
    days = table(spark, sf, "events").select(F.col("user_id").alias("key"), noon.alias("ts")).distinct()
    return days.withColumn(
        "request_id", F.concat_ws("@", F.col("key").cast("string"), F.unix_micros("ts").cast("string"))
    )


def breaker_asof(spark: SparkSession, sf: str) -> DataFrame:
    line = staged(breaker_timeline(outcomes_of_events(table(spark, sf, "events")), RULE), "timeline")
    met = guard_searches(_noon_requests(spark, sf), line, RULE)
    return met.select(F.col("key").alias("user_id"), _plain("ts"), "state", "error")


_READ_SQL = """CASE WHEN state IS NULL THEN 'closed'
  WHEN state = 'open' AND epoch_us({at}) - epoch_us(last) >= 43200000000 THEN 'half_open' ELSE state END"""

BREAKER_ASOF_SQL = f"""
WITH RECURSIVE {_TIMELINE_SQL},
asked AS (SELECT DISTINCT user_id, date_trunc('day', ts) + INTERVAL 12 HOUR AS ts FROM events),
met AS (
  SELECT asked.user_id, asked.ts, {_READ_SQL.format(at="asked.ts")} AS state
  FROM asked ASOF LEFT JOIN (SELECT * FROM line WHERE n > 0) l ON asked.user_id = l.user_id AND asked.ts >= l.ts)
SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, state, CASE WHEN state = 'open' THEN 'CircuitBreaker OPEN' END AS error FROM met
"""


def breaker_status(spark: SparkSession, sf: str) -> DataFrame:
    """State of every user's breaker at the report time."""
    line = breaker_timeline(outcomes_of_events(table(spark, sf, "events")), RULE)
    report = status_report(line, F.lit(REPORT_AT).cast("timestamp"), RULE)
    return report.withColumnRenamed("key", "user_id")


BREAKER_STATUS_SQL = f"""
WITH RECURSIVE {_TIMELINE_SQL},
newest AS (
  SELECT user_id, arg_max(state, n) AS state, arg_max(last, n) FILTER (WHERE last IS NOT NULL) AS last
  FROM line WHERE n > 0 AND ts <= TIMESTAMP '{REPORT_AT}' GROUP BY user_id)
SELECT user_id, {_READ_SQL.format(at=f"TIMESTAMP '{REPORT_AT}'")} AS state FROM newest
"""


def breaker_registered(spark: SparkSession, sf: str) -> DataFrame:
    """State of every customer's breaker: those without calls are closed, callers who are no customers are told too."""
    line = breaker_timeline(outcomes_of_events(table(spark, sf, "events")), RULE)
    customers = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("key"))
    report = status_report(line, F.lit(REPORT_AT).cast("timestamp"), RULE, customers)
    return report.withColumnRenamed("key", "user_id")


BREAKER_REGISTERED_SQL = f"""
WITH RECURSIVE {_TIMELINE_SQL},
newest AS (
  SELECT user_id, arg_max(state, n) AS state, arg_max(last, n) FILTER (WHERE last IS NOT NULL) AS last
  FROM line WHERE n > 0 AND ts <= TIMESTAMP '{REPORT_AT}' GROUP BY user_id)
SELECT coalesce(user_id, c_custkey) AS user_id, {_READ_SQL.format(at=f"TIMESTAMP '{REPORT_AT}'")} AS state
FROM newest FULL JOIN (SELECT CAST(c_custkey AS BIGINT) AS c_custkey FROM customer) ON user_id = c_custkey
"""

# One probe, two successes needed: a half-open breaker admits one call and then stays as it is.
STUCK_RULE = dict(failure_threshold=2, recovery_seconds=43_200, half_open_max_calls=1, success_threshold=2)


def breaker_probe_cap(spark: SparkSession, sf: str) -> DataFrame:
    line = breaker_timeline(outcomes_of_events(table(spark, sf, "events")), BreakerRule(**STUCK_RULE))
    return line.select(F.col("key").alias("user_id"), "event_id", "ok", "admitted", "state")


BREAKER_PROBE_CAP_SQL = f"""
WITH RECURSIVE {_TIMELINE_SQL.replace("p >= 3", "p >= 1")}
SELECT user_id, event_id, ok, admitted, state FROM line WHERE n > 0
"""


def _lookups(spark: SparkSession, sf: str) -> DataFrame:
    query = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
    return table(spark, sf, "events").select(
        query.alias("query"), F.lit(5).alias("num_results"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("lookup_id"),
    )


def ttl_dedup(spark: SparkSession, sf: str) -> DataFrame:
    seen = ttl_lookups(_lookups(spark, sf), TTL_SECONDS)
    return seen.select(F.col("lookup_id").alias("event_id"), "query", "hit", _plain("stored_at"))


TTL_DEDUP_SQL = """
WITH RECURSIVE numbered AS (
  SELECT event_id, user_id || ':' || event_type AS query, ts,
    row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
line AS (
  SELECT event_id, query, n, false AS hit, ts AS stored_at FROM numbered WHERE n = 1
  UNION ALL
  SELECT e.event_id, e.query, e.n, epoch_us(e.ts) - epoch_us(l.stored_at) < 172800000000,
    CASE WHEN epoch_us(e.ts) - epoch_us(l.stored_at) < 172800000000 THEN l.stored_at ELSE e.ts END
  FROM line l JOIN numbered e ON e.query = l.query AND e.n = l.n + 1)
SELECT event_id, query, hit, stored_at FROM line
"""


def lru_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Lookups that a cache of 128 entries would have served, and how many other keys came between."""
    seen = lru_lookups(_lookups(spark, sf))
    return seen.select(F.col("lookup_id").alias("event_id"), "query", "distance", "hit")


LRU_CACHE_SQL = """
WITH numbered AS (
  SELECT event_id, user_id || ':' || event_type AS query, row_number() OVER (ORDER BY ts, event_id) AS n FROM events),
uses AS (SELECT *, lag(n) OVER (PARTITION BY query ORDER BY n) AS prev FROM numbered),
told AS (
  SELECT a.event_id, a.query, a.prev, count(b.n) AS others
  FROM uses a LEFT JOIN uses b ON b.n > a.prev AND b.n < a.n AND coalesce(b.prev, 0) < a.prev
  GROUP BY ALL)
SELECT event_id, query, CASE WHEN prev IS NOT NULL THEN others END AS distance, prev IS NOT NULL AND others < 128 AS hit
FROM told
"""


def ttl_cache_join(spark: SparkSession, sf: str) -> DataFrame:
    """All other events served by what the user's latest purchase stored; the rest is searched anew."""
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    query = F.col("user_id").cast("string").alias("query")
    entries = events.filter(F.col("event_type") == "purchase").select(
        query, F.lit(5).alias("num_results"), "ts",
        F.lpad(F.col("event_id").cast("string"), 30, "0").alias("entry_id"),
        F.array(F.col("value").cast("string")).alias("results"),
    )
    others = events.filter(F.col("event_type") != "purchase")
    asked = others.select(
        F.col("event_id").alias("request_id"), query, F.lit(5).alias("num_results"), "ts"
    )
    served = serve_from_cache(asked, entries, TTL_SECONDS)
    searched = others.select(F.col("event_id").alias("request_id"), F.array("props").alias("results"))
    return with_fresh_results(served, searched).select(
        F.col("request_id").alias("event_id"), "query", F.concat_ws(",", "results").alias("results"), "cached"
    )


TTL_CACHE_JOIN_SQL = """
SELECT c.event_id, CAST(c.user_id AS VARCHAR) AS query,
  CASE WHEN alive THEN CAST(c.stored AS VARCHAR) ELSE c.props END AS results, alive AS cached
FROM (
  SELECT a.event_id, a.user_id, a.props, p.value AS stored,
    coalesce(epoch_us(a.ts) - epoch_us(p.ts) < 172800000000, false) AS alive
  FROM (SELECT * FROM events WHERE event_type <> 'purchase') a
  ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON a.user_id = p.user_id AND a.ts >= p.ts) c
"""


def _accesses(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("request_key"),
    )


def rate_limit_windows(spark: SparkSession, sf: str) -> DataFrame:
    counted = window_counts(_accesses(spark, sf), DAILY_LIMIT, "1 day")
    return counted.select(F.col("client").alias("user_id"), _plain("window_start"), "requests", "over_limit")


RATE_LIMIT_WINDOWS_SQL = """
SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, count(*) AS requests, count(*) > 5 AS over_limit
FROM events GROUP BY ALL
"""


def rate_limit_admit(spark: SparkSession, sf: str) -> DataFrame:
    judged = admit(_accesses(spark, sf), DAILY_LIMIT, "1 day")
    return judged.select(
        F.col("request_key").alias("event_id"), F.col("client").alias("user_id"), _plain("window_start"), "admitted"
    )


RATE_LIMIT_ADMIT_SQL = """
SELECT event_id, user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start,
  row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) <= 5 AS admitted
FROM events
"""

_ERROR_SQL = """CASE event_id % 6 WHEN 0 THEN 'Error code: 429' WHEN 1 THEN 'Service Unavailable'
  WHEN 2 THEN 'model OVERLOADED' WHEN 3 THEN 'invalid request' WHEN 4 THEN 'Rate Limit reached' ELSE 'HTTP 503' END"""


def retryable_errors(spark: SparkSession, sf: str) -> DataFrame:
    failed = table(spark, sf, "events").filter(F.col("event_type") == "error")
    told = failed.select("event_id", F.expr(_ERROR_SQL).alias("error"))
    return told.withColumn("retryable", is_retryable(F.col("error")))


RETRYABLE_ERRORS_SQL = f"""
SELECT event_id, {_ERROR_SQL} AS error, event_id % 6 <> 3 AS retryable FROM events WHERE event_type = 'error'
"""


def retry_audit_query(spark: SparkSession, sf: str) -> DataFrame:
    """The events of every third user among six in a row are the attempts of one call."""
    call = F.concat_ws("-", F.expr("event_id DIV 6"), F.col("user_id") % 3)
    nth = F.row_number().over(Window.partitionBy("call_id").orderBy("event_id"))
    attempts = (
        table(spark, sf, "events")
        .select(
            call.alias("call_id"),
            "event_id",
            (~F.col("event_type").isin("error", "view", "click")).alias("ok"),
            F.expr(_ERROR_SQL).alias("error"),
        )
        .withColumn("attempt", nth)
    )
    return retry_audit(attempts)


RETRY_AUDIT_SQL = f"""
WITH attempts AS (
  SELECT concat_ws('-', event_id // 6, user_id % 3) AS call_id,
    CAST(row_number() OVER (PARTITION BY event_id // 6, user_id % 3 ORDER BY event_id) AS INTEGER) AS attempt,
    event_type NOT IN ('error', 'view', 'click') AS ok, {_ERROR_SQL} AS error, event_id % 6 <> 3 AS again
  FROM events),
calls AS (
  SELECT call_id, max(attempt) AS attempts, arg_max(ok, attempt) AS ok, arg_max(error, attempt) AS error,
    arg_max(again, attempt) AS again,
    sum(CASE WHEN NOT ok AND again AND attempt < 4 THEN 2.0::DOUBLE ** (attempt - 1) ELSE 0 END) AS least_wait,
    sum(CASE WHEN NOT ok AND again AND attempt < 4 THEN 2.0::DOUBLE ** (attempt - 1) + 0.5::DOUBLE ELSE 0 END) AS most_wait
  FROM attempts GROUP BY call_id)
SELECT call_id, attempts, CASE WHEN ok THEN 'success' WHEN NOT again THEN 'not_retryable'
    WHEN attempts >= 4 THEN 'exhausted' ELSE 'pending' END AS outcome,
  CASE WHEN NOT ok THEN error END AS last_error, CAST(least_wait AS DOUBLE) AS least_wait, CAST(most_wait AS DOUBLE) AS most_wait
FROM calls
"""


def breaker_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Questions that share a breaker because they begin alike."""
    keyed = table(spark, sf, "documents").select(breaker_key(F.col("text")).alias("breaker"), "n_chars")
    return keyed.groupBy("breaker").agg(
        F.count(F.lit(1)).alias("questions"), F.sum("n_chars").alias("chars")
    )


BREAKER_KEYS_SQL = """
SELECT 'ddg_search:' || substring(text, 1, 20) AS breaker, count(*) AS questions, CAST(sum(n_chars) AS BIGINT) AS chars
FROM documents GROUP BY 1
"""

QUERIES = {
    "failure_streaks": (failure_streaks_query, FAILURE_STREAKS_SQL),
    "breaker_registered": (breaker_registered, BREAKER_REGISTERED_SQL),
    "breaker_probe_cap": (breaker_probe_cap, BREAKER_PROBE_CAP_SQL),
    "breaker_local_ids": (breaker_local_ids, BREAKER_LOCAL_IDS_SQL),
    "breaker_timeline": (breaker_timeline_query, BREAKER_TIMELINE_SQL),
    "breaker_asof": (breaker_asof, BREAKER_ASOF_SQL),
    "breaker_status": (breaker_status, BREAKER_STATUS_SQL),
    "breaker_keys": (breaker_keys, BREAKER_KEYS_SQL),
    "ttl_dedup": (ttl_dedup, TTL_DEDUP_SQL),
    "lru_cache": (lru_cache, LRU_CACHE_SQL),
    "ttl_cache_join": (ttl_cache_join, TTL_CACHE_JOIN_SQL),
    "rate_limit_windows": (rate_limit_windows, RATE_LIMIT_WINDOWS_SQL),
    "rate_limit_admit": (rate_limit_admit, RATE_LIMIT_ADMIT_SQL),
    "retryable_errors": (retryable_errors, RETRYABLE_ERRORS_SQL),
    "retry_audit": (retry_audit_query, RETRY_AUDIT_SQL),
}
