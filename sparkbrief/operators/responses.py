"""Model requests as JSON payloads, and model responses read back with fixed fallbacks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkbrief.functions import has_key, json_field, json_object, json_value, strip
from sparkbrief.schemas import DOCUMENT_OUTPUT

# Fixed values.
DOCUMENT_FAILED_TITLE = "文件產生失敗"
DOCUMENT_FAILED_SUMMARY = "結構化解析失敗，請參考原始回應。"
REQUEST_LINE = "使用者需求："
RESEARCH_LINE = "Research 結果摘要："
FINANCE_LINE = "Finance 結果摘要："


def routing_payload(user_input: Column, completed: Column, outputs: Column) -> Column:
    """What the router is asked: of each agent's output (JSON text) only the names of its keys."""
    keys = F.transform_values(outputs, lambda _, output: F.json_object_keys(output))
    return F.to_json(
        F.struct(
            user_input.alias("user_input"),
            completed.alias("completed_agents"),
            keys.alias("agent_outputs"),
        )
    )


def _as_json(text: Column) -> Column:
    """JSON text as a value; other text as a string."""
    return F.coalesce(json_value(text), text.cast("variant"))


def synthesis_payload(user_input: Column, outputs: Column, errors: Column) -> Column:
    return F.to_json(
        F.struct(
            user_input.alias("user_input"),
            F.transform_values(outputs, lambda _, output: _as_json(output)).alias("agent_outputs"),
            F.coalesce(errors, F.array().cast("array<string>")).alias("errors"),
        )
    )


def finance_payload(user_input: Column, numbers: Column) -> Column:
    """``numbers`` is JSON text of the calculated levels, or null if nothing was calculated."""
    calculated = F.try_parse_json(F.coalesce(numbers, F.lit("{}")))
    return F.to_json(
        F.struct(user_input.alias("user_input"), calculated.alias("calculated_numbers"))
    )


def document_context(user_input: Column, research: Column, finance: Column) -> Column:
    """Request line, then a summary line for each output (JSON text) that exists."""

    def line(label: str, output: Column) -> Column:
        summary = F.coalesce(F.get_json_object(output, "$.summary"), F.lit(""))
        return F.when(output.isNotNull(), F.concat(F.lit(label), summary))

    return F.concat_ws(
        "\n",
        F.concat(F.lit(REQUEST_LINE), user_input),
        line(RESEARCH_LINE, research),
        line(FINANCE_LINE, finance),
    )


def document_output(content: Column) -> Column:
    """The document of a response; a fixed one that keeps the raw text if it is no JSON object."""
    failed = F.struct(
        F.lit(DOCUMENT_FAILED_TITLE).alias("title"),
        F.lit(DOCUMENT_FAILED_SUMMARY).alias("summary"),
        F.array().cast(DOCUMENT_OUTPUT["sections"].dataType).alias("sections"),
        F.coalesce(content, F.lit("")).alias("raw_response"),
    )
    parsed = F.from_json(strip(content), DOCUMENT_OUTPUT)
    return F.when(json_object(content).isNotNull(), parsed).otherwise(failed)


def finance_output(content: Column) -> Column:
    """``struct(summary, risk_notes)``; a response that is no JSON object is itself the summary."""
    doc = json_object(content)
    none = F.array().cast("array<string>")
    read = F.struct(
        F.coalesce(json_field(doc, "interpretation"), F.lit("")).alias("summary"),
        F.coalesce(json_field(doc, "risk_notes", "array<string>"), none).alias("risk_notes"),
    )
    kept = F.struct(F.coalesce(content, F.lit("")).alias("summary"), none.alias("risk_notes"))
    return F.when(doc.isNotNull(), read).otherwise(kept)


def synthesizer_update(threads: DataFrame, content: str = "content") -> DataFrame:
    """State update of the closing step: the stripped answer ends the thread."""
    return threads.select(
        *[c for c in threads.columns if c != content],
        strip(F.coalesce(F.col(content), F.lit(""))).alias("final_answer"),
        F.lit("end").alias("next_agent"),
        F.array(F.lit("synthesizer")).alias("completed_agents"),
    )


def query_result(states: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """The four result fields of a thread state, with empty defaults, and any ``extra`` columns."""
    none = F.array().cast("array<string>")
    return states.select(
        "thread_id",
        *(extra or []),
        F.coalesce("final_answer", F.lit("")).alias("final_answer"),
        F.coalesce("agent_outputs", F.create_map().cast("map<string,string>")).alias("agent_outputs"),
        F.coalesce("errors", none).alias("errors"),
        F.coalesce("completed_agents", none).alias("completed_agents"),
    )


def decision(content: Column) -> Column:
    """The agent a router response names; null unless it is a JSON object that names one."""
    doc = json_object(content)
    return F.when(has_key(doc, "next_agent"), json_field(doc, "next_agent"))
