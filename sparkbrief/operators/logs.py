"""JSON log lines as rows, rows as JSON log lines, and what happened per request."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkbrief.functions import json_object

# Fixed values.
TS_FORMAT = "yyyy-MM-dd HH:mm:ss,SSS"
LINE_KEYS = ("ts", "level", "name", "msg", "request_id", "thread_id")
# Record attributes that never become extras.
RESERVED = (
    "args", "asctime", "created", "exc_info", "exc_text", "filename", "funcName", "levelname",
    "levelno", "lineno", "module", "msecs", "message", "msg", "name", "pathname", "process",
    "processName", "relativeCreated", "stack_info", "thread", "threadName",
)


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Six known fields and a map of extras; ``bad_line`` keeps a line that is no JSON object."""
    whole = json_object(F.col(value)).isNotNull()
    keyed = lines.withColumn("_keys", F.when(whole, F.from_json(value, "map<string,string>")))
    field = {k: F.element_at("_keys", F.lit(k)) for k in LINE_KEYS}
    extras = F.map_filter("_keys", lambda k, _: ~k.isin(*LINE_KEYS))
    return keyed.select(
        *[c for c in lines.columns if c != value],
        F.try_to_timestamp(field["ts"], F.lit(TS_FORMAT)).alias("ts"),
        *[field[k].alias(k) for k in LINE_KEYS[1:]],
        extras.alias("extras"),
        F.when(F.col("_keys").isNull(), F.col(value)).alias("bad_line"),
    )


def format_lines(logs: DataFrame) -> DataFrame:
    """The inverse: one JSON text per row. Empty ids are left out; extras win over fields of their name."""
    fields = F.create_map(
        F.lit("ts"), F.date_format("ts", TS_FORMAT),
        *[part for k in LINE_KEYS[1:] for part in (F.lit(k), F.col(k))],
    )
    extras = F.map_filter(
        F.coalesce("extras", F.create_map().cast("map<string,string>")),
        lambda k, _: ~k.isin(*RESERVED),
    )
    shown = F.map_filter(
        fields,
        lambda k, v: ~F.map_contains_key(extras, k)
        & (~k.isin("request_id", "thread_id") | (F.coalesce(v, F.lit("")) != "")),
    )
    return logs.select(F.to_json(F.map_concat(shown, extras)).alias("value"))


def trace_rollup(logs: DataFrame) -> DataFrame:
    """Per request: lines, errors, first and last time, and the loggers that spoke."""
    return (
        logs.filter(F.col("request_id").isNotNull())
        .groupBy("request_id")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.count_if(F.col("level") == "ERROR").alias("errors"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            F.array_sort(F.collect_set("name")).alias("names"),
        )
    )
