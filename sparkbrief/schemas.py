"""Table schemas shared by sources, operators and streams."""

from pyspark.sql import types as T

_hit = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("href", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)

REQUEST = T.StructType(
    [
        T.StructField("user_input", T.StringType()),
        T.StructField("thread_id", T.StringType()),
        T.StructField("max_steps", T.IntegerType()),
    ]
)

JOB_CHANGE = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("thread_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("seq", T.LongType()),
        T.StructField("final_answer", T.StringType()),
        T.StructField("error_detail", T.StringType()),
    ]
)

THREAD_UPDATE = T.StructType(
    [
        T.StructField("thread_id", T.StringType()),
        T.StructField("step", T.LongType()),
        T.StructField("user_input", T.StringType()),
        T.StructField("completed_agents", T.ArrayType(T.StringType())),
        T.StructField("agent_outputs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("errors", T.ArrayType(T.StringType())),
        T.StructField("step_count", T.IntegerType()),
        T.StructField("max_steps", T.IntegerType()),
        T.StructField("final_answer", T.StringType()),
        T.StructField("next_agent", T.StringType()),
    ]
)

SEARCH_RESULT = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("user_input", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("query", T.StringType()),
        T.StructField("results", T.ArrayType(_hit)),
        T.StructField("error", T.StringType()),
    ]
)

DOCUMENT_OUTPUT = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField(
            "sections",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("heading", T.StringType()),
                        T.StructField("bullets", T.ArrayType(T.StringType())),
                    ]
                )
            ),
        ),
        T.StructField("raw_response", T.StringType()),
    ]
)

OUTCOME = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("ok", T.BooleanType()),
    ]
)

LOOKUP = T.StructType(
    [
        T.StructField("query", T.StringType()),
        T.StructField("num_results", T.IntegerType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("lookup_id", T.LongType()),
    ]
)

ACCESS = T.StructType(
    [
        T.StructField("client", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("request_key", T.StringType()),
    ]
)

ATTEMPT = T.StructType(
    [
        T.StructField("call_id", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)

LOG_LINE = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("level", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("msg", T.StringType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("thread_id", T.StringType()),
        T.StructField("extras", T.MapType(T.StringType(), T.StringType())),
    ]
)
