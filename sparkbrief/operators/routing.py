"""Routing: which agent each step of a thread goes to, and why."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbrief.functions import json_object
from sparkbrief.operators.ordered import HOT_ROWS, scan
from sparkbrief.operators.requests import MAX_STEPS
from sparkbrief.operators.responses import decision

# Decision, node it leads to, and where the node leads next.
EDGES = (
    ("research", "research", "orchestrator"),
    ("document", "document", "orchestrator"),
    ("finance", "finance", "orchestrator"),
    ("synthesizer", "synthesizer", "end"),
)
WORKERS = ("research", "document", "finance")
FALLBACK = "synthesizer"


def edge_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGES, "decision string, node string, after string")


def next_agent(
    content: Column, completed: Column, step: Column, max_steps: Column
) -> Column:
    """Next agent of a single step, given the agents completed so far."""
    named = decision(content)
    return (
        F.when(step >= max_steps, FALLBACK)
        .when(named.isNull() | ~named.isin(*WORKERS, FALLBACK), FALLBACK)
        .when(F.array_contains(F.coalesce(completed, F.array().cast("array<string>")), named), FALLBACK)
        .otherwise(named)
    )


def routed(agent: Column) -> Column:
    return F.coalesce(agent, F.lit(FALLBACK))


def dispatch(decisions: DataFrame, agent: str = "next_agent") -> DataFrame:
    """Add the node a decision leads to and where that leads; unknown decisions drop out."""
    edges = edge_table(decisions.sparkSession)
    return decisions.join(F.broadcast(edges), F.col(agent) == edges["decision"]).drop("decision")


def unknown_decisions(decisions: DataFrame, agent: str = "next_agent") -> DataFrame:
    edges = edge_table(decisions.sparkSession)
    return decisions.join(F.broadcast(edges), F.col(agent) == edges["decision"], "left_anti")


def _once(completed: DataFrame) -> DataFrame:
    """Each agent of a thread once, so that a long thread does not swell one side of a join."""
    return completed.select("thread_id", "agent").distinct()


def repeats(decisions: DataFrame, completed: DataFrame) -> DataFrame:
    """Decisions for an agent that the thread has completed; both have ``thread_id, agent``."""
    return decisions.join(_once(completed), ["thread_id", "agent"], "left_semi")


def fresh(decisions: DataFrame, completed: DataFrame) -> DataFrame:
    return decisions.join(_once(completed), ["thread_id", "agent"], "left_anti")


def routing_audit(log: DataFrame, max_steps: int = MAX_STEPS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Effective next agent of each step of a decision log.

    ``log`` has ``thread_id, seq, content`` and may have its own ``max_steps``.
    Rules in order: step limit, bad JSON, missing name, unknown name, agent
    already done; each leads to the synthesizer, which ends the thread. A worker
    proposed before the end was also visited, so earlier proposals tell which
    agents are done. Rows after the end are ``unreached``.
    """
    if "max_steps" not in log.columns:
        log = log.withColumn("max_steps", F.lit(max_steps))
    named = log.withColumns({"proposal": decision(F.col("content")),
                             "parsed": json_object(F.col("content")).isNotNull()})
    named = named.select("thread_id", "seq", "max_steps", "proposal", "parsed")
    seen = scan(
        named,
        ["thread_id"],
        ["seq"],
        last={f"seen_{w}": F.when(F.col("proposal") == w, True) for w in WORKERS},
        total={"step": F.lit(1)},
        inclusive=False,
        hot_rows=hot_rows,
    )
    done = F.lit(False)
    for worker in WORKERS:
        done = done | ((F.col("proposal") == worker) & F.coalesce(f"seen_{worker}", F.lit(False)))
    rule = (
        F.when(F.col("step") >= F.col("max_steps"), "step_limit")
        .when(~F.col("parsed"), "bad_json")
        .when(F.col("proposal").isNull(), "missing")
        .when(~F.col("proposal").isin(*WORKERS, FALLBACK), "unknown")
        .when(done, "repeat")
        .otherwise("as_proposed")
    )
    judged = seen.withColumn("rule", rule)
    effective = F.when(F.col("rule") == "as_proposed", F.col("proposal")).otherwise(FALLBACK)
    judged = judged.withColumn("effective", effective)
    ended = scan(
        judged,
        ["thread_id"],
        ["seq"],
        last={"ended": F.when(F.col("effective") == FALLBACK, True)},
        inclusive=False,
        hot_rows=hot_rows,
    )
    reached = F.col("ended").isNull()
    return ended.select(
        "thread_id",
        "seq",
        "step",
        "proposal",
        F.when(reached, F.col("rule")).otherwise("unreached").alias("rule"),
        F.when(reached, F.col("effective")).alias("next_agent"),
    )
