"""Jobs and log lines, read from events."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbrief.operators.jobs import latest_status, look_up, transitions
from sparkbrief.operators.logs import format_lines, parse_lines, trace_rollup
from sparkbrief.operators.requests import request_id
from sparkbrief.sources.tables import spread, table

_STATUS_SQL = """CASE event_type WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'done'
  WHEN 'error' THEN 'error' ELSE 'queued' END"""


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("job_id"),
        F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("thread_id"),
        F.expr(_STATUS_SQL).alias("status"),
        "ts",
        F.col("event_id").alias("seq"),
        F.expr("CASE WHEN event_type = 'error' THEN props END").alias("error_detail"),
    )


def latest_job_status(spark: SparkSession, sf: str) -> DataFrame:
    return latest_status(_changes(spark, sf))


LATEST_JOB_STATUS_SQL = f"""
SELECT job_id, 't' || job_id AS thread_id, status, ts, seq, error_detail FROM (
  SELECT user_id AS job_id, {_STATUS_SQL} AS status, ts, event_id AS seq,
    CASE WHEN event_type = 'error' THEN props END AS error_detail,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back
  FROM events) WHERE back = 1
"""


def job_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return transitions(_changes(spark, sf)).select("job_id", "seq", "previous", "status", "legal")


JOB_TRANSITIONS_SQL = f"""
SELECT job_id, seq, previous, status,
  coalesce((previous IS NULL AND status = 'queued') OR (previous = 'queued' AND status = 'running')
    OR (previous = 'running' AND status IN ('done', 'error')), false) AS legal
FROM (
  SELECT job_id, seq, status, lag(status) OVER (PARTITION BY job_id ORDER BY ts, seq) AS previous
  FROM (SELECT user_id AS job_id, event_id AS seq, ts, {_STATUS_SQL} AS status FROM events))
"""


def job_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer asks for the job of their number; most were never submitted."""
    ids = table(spark, sf, "customer").select(F.col("c_custkey").alias("job_id"))
    return look_up(ids, latest_status(_changes(spark, sf))).select("job_id", "found", "status", "error_detail")


JOB_LOOKUP_SQL = f"""
WITH latest AS ({LATEST_JOB_STATUS_SQL})
SELECT c_custkey AS job_id, status IS NOT NULL AS found, status, error_detail
FROM customer LEFT JOIN latest ON c_custkey = job_id
"""


def _logs(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return spread(table(spark, sf, "events")).select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "error", "ERROR").otherwise("INFO").alias("level"),
        F.concat(F.lit("svc."), kind).alias("name"),
        F.concat(F.lit("事件 "), kind, F.lit(' "'), F.col("props"), F.lit('"')).alias("msg"),
        F.when(kind != "signup", F.concat(F.lit("r"), F.col("user_id").cast("string"))).alias("request_id"),
        F.when(F.col("event_id") % 2 == 0, F.lit("")).otherwise(F.lit("t1")).alias("thread_id"),
        F.create_map(
            F.lit("event_id"), F.col("event_id").cast("string"),
            F.lit("lineno"), F.lit("7"),
            F.lit("價"), F.col("value").cast("string"),
        ).alias("extras"),
    )


def log_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Events written as JSON log lines and read back; the lines of purchases are broken."""
    lines = format_lines(_logs(spark, sf))
    number = F.get_json_object("value", "$.event_id").cast("long")
    purchase = F.get_json_object("value", "$.name") == "svc.purchase"
    broken = F.when(purchase, F.concat(F.lit("Traceback "), number.cast("string"))).otherwise(F.col("value"))
    read = parse_lines(lines.select(broken.alias("value")))
    return read.select(
        F.coalesce(
            F.element_at("extras", F.lit("event_id")), F.regexp_extract("bad_line", "[0-9]+", 0)
        ).cast("long").alias("event_id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        "level",
        "name",
        "msg",
        "request_id",
        "thread_id",
        F.element_at("extras", F.lit("價")).cast("double").alias("price"),
        F.size(F.map_keys("extras")).alias("n_extras"),
        "bad_line",
    )


LOG_SCAN_SQL = """
SELECT event_id, CASE WHEN good THEN CAST(date_trunc('milliseconds', ts) AS TIMESTAMP) END AS ts,
  CASE WHEN good THEN CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END END AS level,
  CASE WHEN good THEN 'svc.' || event_type END AS name,
  CASE WHEN good THEN '事件 ' || event_type || ' "' || props || '"' END AS msg,
  CASE WHEN good AND event_type <> 'signup' THEN 'r' || user_id END AS request_id,
  CASE WHEN good AND event_id % 2 = 1 THEN 't1' END AS thread_id,
  CASE WHEN good THEN value END AS price, CAST(CASE WHEN good THEN 2 END AS INTEGER) AS n_extras,
  CASE WHEN NOT good THEN 'Traceback ' || event_id END AS bad_line
FROM (SELECT *, event_type <> 'purchase' AS good FROM events)
"""


def trace_rollup_query(spark: SparkSession, sf: str) -> DataFrame:
    rolled = trace_rollup(_logs(spark, sf))
    return rolled.select(
        "request_id", "lines", "errors",
        F.col("first_ts").cast("timestamp_ntz").alias("first_ts"),
        F.col("last_ts").cast("timestamp_ntz").alias("last_ts"),
        F.concat_ws(",", "names").alias("names"),
    )


TRACE_ROLLUP_SQL = """
SELECT 'r' || user_id AS request_id, count(*) AS lines, count(*) FILTER (WHERE event_type = 'error') AS errors,
  min(ts) AS first_ts, max(ts) AS last_ts, string_agg(DISTINCT 'svc.' || event_type, ',' ORDER BY 'svc.' || event_type) AS names
FROM events WHERE event_type <> 'signup' GROUP BY user_id
"""

_UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[0-9a-f]{4}-[0-9a-f]{12}$"


def request_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Headers of each event's request: an id, two ids, an empty id, or none."""
    def header(name: str, value):
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    number, kind = F.col("event_id").cast("string"), F.col("event_id") % 4
    own = header("X-Request-ID", F.concat(F.lit("r"), number))
    host = header("Host", F.lit("h"))
    headers = (
        F.when(kind == 0, F.array(host, own))
        .when(kind == 1, F.array(header("x-request-id", F.concat(F.lit("first"), number)), own))
        .when(kind == 2, F.array(header("X-REQUEST-ID", F.lit("")), own))
        .otherwise(F.array(host))
    )
    told = table(spark, sf, "events").select("event_id", request_id(headers).alias("id"))
    made = F.col("id").rlike(_UUID)
    return told.select("event_id", F.when(~made, F.col("id")).alias("request_id"), made.alias("made"))


REQUEST_IDS_SQL = """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'r' || event_id WHEN 1 THEN 'first' || event_id END AS request_id,
  event_id % 4 >= 2 AS made
FROM events
"""

QUERIES = {
    "latest_job_status": (latest_job_status, LATEST_JOB_STATUS_SQL),
    "job_transitions": (job_transitions, JOB_TRANSITIONS_SQL),
    "job_lookup": (job_lookup, JOB_LOOKUP_SQL),
    "log_scan": (log_scan, LOG_SCAN_SQL),
    "trace_rollup": (trace_rollup_query, TRACE_ROLLUP_SQL),
    "request_ids": (request_ids, REQUEST_IDS_SQL),
}
