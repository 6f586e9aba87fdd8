"""Thread state: partial updates merged per thread, whole or step by step."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkbrief.operators.ordered import HOT_ROWS, scan
from sparkbrief.staging import staged

FIELDS = [
    "user_input", "completed_agents", "agent_outputs", "errors",
    "step_count", "max_steps", "final_answer", "next_agent",
]
_GROWING = ["completed_agents", "agent_outputs", "errors"]


def initial_state(requests: DataFrame) -> DataFrame:
    """Update 0 of a thread from its request (``thread_id, user_input, max_steps``)."""
    none = F.array().cast("array<string>")
    return requests.select(
        "thread_id",
        F.lit(-1).cast("long").alias("step"),
        "user_input",
        none.alias("completed_agents"),
        F.create_map().cast("map<string,string>").alias("agent_outputs"),
        none.alias("errors"),
        F.lit(0).alias("step_count"),
        F.col("max_steps"),
    )


def _fields(updates: DataFrame) -> list[str]:
    return [c for c in FIELDS if c in updates.columns]


def _parts(growing: list[str]) -> Column:
    """What an update adds, as (kind, key, at, value): agents by name, outputs by agent, errors without a key."""
    kinds = []
    if "completed_agents" in growing:
        agents = F.coalesce("completed_agents", F.array().cast("array<string>"))
        kinds.append(
            F.transform(
                agents,
                lambda a, i: F.struct(
                    F.lit("agent").alias("kind"), a.alias("key"), F.struct("step", i.alias("place")).alias("at"),
                    F.lit(None).cast("string").alias("value"),
                ),
            )
        )
    if "agent_outputs" in growing:
        outputs = F.coalesce(F.map_entries("agent_outputs"), F.array().cast("array<struct<key:string,value:string>>"))
        kinds.append(
            F.transform(
                outputs,
                lambda e, i: F.struct(
                    F.lit("output").alias("kind"), e["key"].alias("key"),
                    F.struct("step", i.alias("place")).alias("at"), e["value"].alias("value"),
                ),
            )
        )
    if "errors" in growing:
        errors = F.coalesce("errors", F.array().cast("array<string>"))
        kinds.append(
            F.transform(
                errors,
                lambda e, i: F.struct(
                    F.lit("error").alias("kind"), F.lit(None).cast("string").alias("key"),
                    F.struct("step", i.alias("place")).alias("at"), e.alias("value"),
                ),
            )
        )
    return F.concat(*kinds)


_GROUP = ["thread_id", "kind", "key", "error"]


def state_entries(updates: DataFrame, mode: str = "accumulate") -> DataFrame:
    """What updates tell, an entry a row: ``thread_id, kind, key, error, at, value``.

    Kinds: ``agent`` (a completion), ``output`` of an agent, ``error``, ``field`` (a field's new value as JSON), and
    ``thread`` once an update. Only an error's own place and text go into ``error``, so that no two errors fall together
    that are not equal in all of it; equal ones are counted by ``reduce_entries``.
    """
    fields = _fields(updates)
    growing = [] if mode == "overwrite" else [c for c in fields if c in _GROWING]
    at = F.struct("step", F.lit(0).alias("place")).alias("at")

    def entry(kind: str, key: Column, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), at, value.cast("string").alias("value"))

    told = [entry("thread", F.lit(None), F.lit(None))]
    for name in fields:
        if name not in growing:
            text = F.to_json(F.struct(F.col(name).alias("v")), {"ignoreNullFields": "false"})
            told.append(F.when(F.col(name).isNotNull() & F.col("step").isNotNull(), entry("field", F.lit(name), text)))
    every = F.filter(F.array(*told), lambda e: e.isNotNull())
    if growing:
        every = F.concat(every, _parts(growing))
    rows = updates.select("thread_id", F.explode(every).alias("p")).select("thread_id", "p.*")
    return rows.withColumn("error", F.when(F.col("kind") == "error", F.struct("at", "value")))


def reduce_entries(entries: DataFrame) -> DataFrame:
    """One row per thread, kind and key, an agent's or field's say, and per different error: ``first, last, n``.

    Partial aggregates, in a stream kept as the state of each key: an update costs what it tells.
    """
    last = F.struct("at", "value")
    return entries.groupBy(*_GROUP).agg(F.min("at").alias("first"), F.max(last).alias("last"), F.count(F.lit(1)).alias("n"))


def merge_entries(reduced: DataFrame) -> DataFrame:
    """The newest of several states of the same keys: as all told is kept, the widest."""
    return reduced.groupBy(*_GROUP).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("n").alias("n"))


def _lists(growing: list[str]) -> dict[str, Column]:
    """Lists and maps of a thread from its reduced rows."""

    def of(kind: str, *parts: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(*parts))))

    made = {
        "completed_agents": F.transform(of("agent", F.col("first"), F.col("key")), lambda r: r["key"]),
        "agent_outputs": F.map_from_entries(of("output", F.col("key"), F.col("last.value").alias("value"))),
        "errors": F.flatten(
            F.transform(of("error", F.col("error"), F.col("n")), lambda r: F.array_repeat(r["error"]["value"], r["n"].cast("int")))
        ),
    }
    return {c: made[c] for c in growing}


def assembled_state(reduced: DataFrame, types: dict[str, str], mode: str = "accumulate") -> DataFrame:
    """A row per thread from reduced entries; ``types`` names the fields, in order, with their SQL types."""
    growing = [] if mode == "overwrite" else [c for c in types if c in _GROWING]

    def value(name: str) -> Column:
        text = F.max(F.when((F.col("kind") == "field") & (F.col("key") == name), F.col("last.value")))
        return F.from_json(text, f"v {types[name]}")["v"]

    lists = _lists(growing)
    return reduced.groupBy("thread_id").agg(*[(lists[c] if c in growing else value(c)).alias(c) for c in types])


def thread_state(updates: DataFrame, mode: str = "accumulate") -> DataFrame:
    """Final state per thread from ``thread_id, step`` and any state fields.

    ``overwrite``: each field keeps its latest non-null value. ``accumulate``: agents are listed by
    the step that first completed them, an agent's latest output counts, and all errors are listed in
    order, those of equal or null steps by their place and text. Every update is merged; a step limit ends the routing, not what was told. Agents and outputs are reduced
    per (thread, agent) before a thread's row is made, so a thread costs what its result holds.
    """
    fields = _fields(updates)
    growing = [] if mode == "overwrite" else [c for c in fields if c in _GROWING]
    latest = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("step"))).alias(c) for c in fields if c not in growing
    ]
    held = updates.groupBy("thread_id").agg(F.count(F.lit(1)).alias("_updates"), *latest)
    if growing:
        told = state_entries(updates.select("thread_id", "step", *growing))
        grown = reduce_entries(told).groupBy("thread_id").agg(*[c.alias(n) for n, c in _lists(growing).items()])
        grown = grown.withColumnRenamed("thread_id", "_thread")
        held = held.join(grown, F.col("thread_id").eqNullSafe(F.col("_thread")), "left").withColumns(
            {c: F.coalesce(c, _none(c)) for c in growing}
        )
    return held.select("thread_id", *fields)


def _none(name: str) -> Column:
    if name == "agent_outputs":
        return F.create_map().cast("map<string,string>")
    return F.array().cast("array<string>")


def running_state(updates: DataFrame, mode: str = "accumulate", hot_rows: int = HOT_ROWS) -> DataFrame:
    """State of each thread after each of its updates; modes as in ``thread_state``.

    Each row holds all its thread has gathered, so the result itself grows with a thread's agents and errors.
    Beside it only the lists of a thread's last row are gathered; an output is carried per (thread, agent), in
    runs for hot ones. ``thread_id`` and ``step`` tell updates apart.
    """
    fields = _fields(updates)
    growing = [] if mode == "overwrite" else [c for c in fields if c in _GROWING]
    held = scan(
        updates, ["thread_id"], ["step"], last={f"_{c}": F.col(c) for c in fields if c not in growing}, hot_rows=hot_rows
    )
    if not growing:
        return held.select("thread_id", "step", *[F.col(f"_{c}").alias(c) for c in fields])
    held = staged(held.withColumn("_row", F.monotonically_increasing_id()), "updates")  # fixed once written
    told = held.select("_row", "thread_id", "step", F.explode(_parts(growing)).alias("p"))
    told = told.select("_row", "thread_id", "step", "p.*")
    # Per thread what its last row holds: each agent's first completion, and the errors.
    agents = told.filter("kind = 'agent'").groupBy("thread_id", "key").agg(F.min("at").alias("at"))
    errors = told.filter("kind = 'error'").select("thread_id", F.col("value").alias("key"), "at")
    lists = agents.withColumn("kind", F.lit("agent")).unionByName(errors.withColumn("kind", F.lit("error")))

    def listed(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("at", "key"))))

    lists = lists.groupBy("thread_id").agg(listed("agent").alias("_agents"), listed("error").alias("_errors"))
    lists = lists.withColumnRenamed("thread_id", "_thread")
    seen = held.join(lists, F.col("thread_id").eqNullSafe(F.col("_thread")), "left")
    # An output counts until its agent's next one: a row per update and agent, as the result has them.
    outputs = told.filter("kind = 'output'")
    names = outputs.select(F.col("thread_id").alias("_thread"), "key").distinct()
    cells = held.select("_row", "thread_id", "step").join(names, F.col("thread_id").eqNullSafe(F.col("_thread")))
    cells = cells.drop("_thread").join(outputs.select("_row", "key", F.struct("value").alias("_told")), ["_row", "key"], "left")
    cells = scan(staged(cells, "cells"), ["thread_id", "key"], ["step"], last={"_now": F.col("_told")}, hot_rows=hot_rows)
    maps = cells.filter(F.col("_now").isNotNull()).groupBy("_row").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.col("_now.value").alias("value"))))).alias("_outputs")
    )
    seen = seen.join(maps, "_row", "left")

    def of(name: str) -> Column:
        here = F.filter(name, lambda e: e["at"]["step"].isNull() | (e["at"]["step"] <= F.col("step")))
        return F.transform(here, lambda e: e["key"])

    made = {"completed_agents": of("_agents"), "agent_outputs": F.col("_outputs"), "errors": of("_errors")}
    made = {c: F.coalesce(value, _none(c)) for c, value in made.items()}
    return seen.select("thread_id", "step", *[(made[c].alias(c) if c in growing else F.col(f"_{c}").alias(c)) for c in fields])


def outputs_map(outputs: DataFrame) -> DataFrame:
    """``{agent: output}`` per thread from ``thread_id, agent, step, output``; the latest of an agent counts."""
    latest = outputs.groupBy("thread_id", "agent").agg(F.max_by("output", "step").alias("output"))
    return latest.groupBy("thread_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("agent", "output")))).alias("agent_outputs")
    )


def assemble_outputs(
    threads: DataFrame, research: DataFrame, finance: DataFrame, document: DataFrame
) -> DataFrame:
    """A thread's three outputs side by side; each side has one row per thread, or none."""
    joined = threads
    for name, side in (("research", research), ("finance", finance), ("document", document)):
        joined = joined.join(side.select("thread_id", F.col("output").alias(name)), "thread_id", "left")
    return joined
