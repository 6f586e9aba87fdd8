"""Circuit-breaker timelines: one three-state fold per key over ordered call outcomes."""

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkbrief.operators.chains import reached_from
from sparkbrief.operators.ordered import HOT_ROWS, asof, cut_runs, scan_runs, split_hot

CLOSED, OPEN, HALF_OPEN = "closed", "open", "half_open"
# What an unsearched query and a result beyond the probes are told as.
OPEN_ERROR = "CircuitBreaker OPEN"
PROBES_ERROR = "breaker[%s] HALF_OPEN（試探中），已達上限"


@dataclass(frozen=True)
class BreakerRule:
    failure_threshold: int = 5
    recovery_seconds: float = 30.0
    half_open_max_calls: int = 3
    success_threshold: int = 2

    def __post_init__(self):
        if self.recovery_us <= 0 or min(self.failure_threshold, self.success_threshold) < 1:
            raise ValueError("recovery time and thresholds must be positive")
        if self.half_open_max_calls < self.success_threshold:
            warnings.warn("too few probes to close again: a half-open breaker stays so", stacklevel=2)

    @property
    def recovery_us(self) -> int:
        return round(self.recovery_seconds * 1_000_000)


# (state, failures, successes, probes, time of last failure in microseconds)
START = (CLOSED, 0, 0, 0, 0)


def advance(held: tuple, us: int, ok: bool, rule: BreakerRule) -> tuple[tuple, bool]:
    """One outcome at time ``us``: the new state, and whether the call was admitted."""
    state, failures, successes, probes, last = held
    if state == OPEN:
        if us - last < rule.recovery_us:
            return held, False
        state, successes, probes = HALF_OPEN, 0, 0
    if state == HALF_OPEN:
        if probes >= rule.half_open_max_calls:
            return (state, failures, successes, probes, last), False
        probes += 1
    if not ok:
        failures += 1
        if state == HALF_OPEN or failures >= rule.failure_threshold:
            return (OPEN, failures, 0, 0, us), True
        return (state, failures, successes, probes, us), True
    if state == CLOSED:
        return (CLOSED, 0, successes, probes, last), True
    successes += 1
    if successes >= rule.success_threshold:
        return (CLOSED, 0, 0, 0, last), True
    return (state, failures, successes, probes, last), True


def _fold(rule: BreakerRule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = object(), START
        for rows in batches:
            admitted, states, opened = [], [], []
            columns = [rows.column(n).to_pylist() for n in ("key", "us", "_good")]
            for row_key, us, good in zip(*columns, strict=True):
                if row_key != key:
                    key, held = row_key, START
                held, passed = advance(held, us, good, rule)
                admitted.append(passed)
                states.append(held[0])
                opened.append(held[4] if held[0] == OPEN else None)
            told = [pa.array(admitted, pa.bool_()), pa.array(states, pa.string()), pa.array(opened, pa.int64())]
            # The given columns pass through untouched, whatever their type.
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, *told], names=[*rows.schema.names, "admitted", "state", "opened_us"]
            )

    return run


def _whole_keys(calls: DataFrame, rule: BreakerRule) -> DataFrame:
    schema = T.StructType(
        calls.schema.fields
        + [
            T.StructField("admitted", T.BooleanType()),
            T.StructField("state", T.StringType()),
            T.StructField("opened_us", T.LongType()),
        ]
    )
    ordered = calls.repartition("key").sortWithinPartitions("key", "us", "event_id")
    return ordered.mapInArrow(_fold(rule), schema)


def _hot_keys(calls: DataFrame, rows: int, rule: BreakerRule, run_rows: int) -> DataFrame:
    """The same fold without walking a key row by row.

    Every opening of the breaker is decided by an earlier one: the first call
    after the recovery time is the first probe, and what follows it is either a
    failing probe or, once closed, the next full streak of failures. Those are
    lookups, so openings form pointer chains; between openings each row's state
    follows from its distance to the opening before it.
    """
    order, keys = ["us", "event_id"], ["key"]
    # Event ids tell apart the calls of one key only, so pointers carry the key with them.
    columns = calls.columns
    calls = calls.withColumn("node", F.struct("key", "event_id"))
    runs = cut_runs(calls, keys, order, rows, run_rows)
    fail = ~F.col("_good")
    numbered = scan_runs(runs, keys, order, total={"pos": F.lit(1)})
    numbered = scan_runs(numbered, keys, order, last={"last_ok": F.when(F.col("_good"), F.col("pos"))})
    streak = F.col("pos") - F.coalesce(F.col("last_ok"), F.lit(0))
    numbered = numbered.withColumn("full", fail & (streak >= rule.failure_threshold))
    ahead = scan_runs(
        numbered,
        keys,
        order,
        last={
            "next_fail": F.when(fail, F.struct("pos", F.col("node").alias("id"))),
            "next_full": F.when(F.col("full"), F.col("node")),
        },
        backward=True,
    )
    probes = min(rule.success_threshold, rule.half_open_max_calls)
    after_close = (
        F.col("next_full")
        if rule.half_open_max_calls >= rule.success_threshold
        else F.lit(None).cast(calls.schema["node"].dataType)
    )
    # Which opening follows if this call is the first probe.
    leads_to = F.when(
        F.col("next_fail.pos") < F.col("pos") + probes, F.col("next_fail.id")
    ).otherwise(after_close)
    calls_seen = ahead.select("key", "us", F.lit(1).alias("side"), "event_id", "node",
                              F.struct("pos", leads_to.alias("opening")).alias("probe"))
    waits = ahead.filter(fail).select("key", (F.col("us") + rule.recovery_us).alias("us"),
                                      F.lit(0).alias("side"), "event_id", "node")
    both = calls_seen.unionByName(waits, allowMissingColumns=True)
    lookup_order = ["us", "side", "event_id"]
    pointers = scan_runs(
        cut_runs(both, keys, lookup_order, 2 * rows, run_rows),
        keys,
        lookup_order,
        last={"found": F.col("probe")},
        backward=True,
    ).filter(F.col("side") == 0)
    pointers = pointers.select(
        F.col("node").alias("id"),
        F.col("found.opening").alias("next"),
        F.col("found.pos").alias("probe_pos"),
    )
    first = numbered.filter("full").groupBy("key").agg(F.min_by("node", "pos").alias("id"))
    span = calls.agg((F.max("us") - F.min("us")).alias("span")).first()["span"]
    opened = reached_from(first, pointers, span // rule.recovery_us + 1)
    openings = opened.join(pointers, "id").select(
        F.col("id").alias("node"), F.struct("probe_pos").alias("opening")
    )
    marked = numbered.join(openings, "node", "left").withColumn(
        "opening",
        F.when(
            F.col("opening").isNotNull(),
            F.struct("pos", "us", F.col("opening.probe_pos").alias("probe_pos")),
        ),
    )
    told = scan_runs(marked, keys, order, last={"since": F.col("opening")})
    nth_probe = F.col("pos") - F.col("since.probe_pos")
    is_open = (F.col("since.probe_pos").isNull() | (nth_probe < 0)) & F.col("since").isNotNull()
    opens_now = F.coalesce(F.col("pos") == F.col("since.pos"), F.lit(False))
    if rule.half_open_max_calls >= rule.success_threshold:
        half_open = nth_probe < rule.success_threshold - 1
        refused = F.lit(False)
    else:
        half_open = F.lit(True)
        refused = nth_probe >= rule.half_open_max_calls
    return told.select(
        *columns,
        F.when(F.col("since").isNull() | opens_now, True)
        .when(is_open, False)
        .otherwise(~refused)
        .alias("admitted"),
        F.when(F.col("since").isNull(), CLOSED)
        .when(is_open, OPEN)
        .when(half_open, HALF_OPEN)
        .otherwise(CLOSED)
        .alias("state"),
        F.when(is_open, F.col("since.us")).alias("opened_us"),
    )


def breaker_timeline(
    calls: DataFrame, rule: BreakerRule = BreakerRule(), hot_rows: int = HOT_ROWS, run_rows: int | None = None
) -> DataFrame:
    """Decision and state after each call; keys above ``hot_rows`` are cut into runs of ``run_rows`` (as many by default).

    ``calls`` has ``key, ts, event_id, ok``; a key's calls follow each other by
    (ts, event_id), and ids need be unique only within a key. A null key is a key
    like any other, a null ``ok`` a failure. ``opened_at`` is the time of the failure that opened the
    breaker while it is open.
    """
    good = F.coalesce(F.col("ok"), F.lit(False))
    slim = calls.select("key", F.unix_micros("ts").alias("us"), "event_id", "ok", good.alias("_good"))
    cold, hot, hot_total = split_hot(slim, ["key"], hot_rows)
    folded = _whole_keys(cold, rule)
    if hot is not None:
        folded = folded.unionByName(_hot_keys(hot, hot_total, rule, run_rows or hot_rows))
    return folded.select(
        "key",
        F.timestamp_micros("us").alias("ts"),
        "event_id",
        "ok",
        "admitted",
        "state",
        F.timestamp_micros("opened_us").alias("opened_at"),
    )


def _state_at(ts, rule: BreakerRule):
    """State as read at a time: an open breaker turns half-open once the recovery time is over."""
    waited = F.unix_micros(ts) - F.unix_micros(F.col("opened_at"))
    return (
        F.when(F.col("state").isNull(), CLOSED)
        .when((F.col("state") == OPEN) & (waited >= rule.recovery_us), HALF_OPEN)
        .otherwise(F.col("state"))
    )


def guard_searches(
    requests: DataFrame,
    timeline: DataFrame,
    rule: BreakerRule = BreakerRule(),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Breaker state each request meets: latest outcome of its key at or before its time.

    ``requests`` has ``request_id, key, ts``. An open breaker gives the fixed
    error and the search is left out.
    """
    met = asof(requests, timeline, ["key"], "ts", "event_id", ["state", "opened_at"], hot_rows)
    state = _state_at(F.col("ts"), rule)
    return met.select(
        *requests.columns,
        state.alias("state"),
        F.when(state == OPEN, F.lit(OPEN_ERROR)).alias("error"),
    )


def search_loop(
    attempts: DataFrame, rule: BreakerRule = BreakerRule(), hot_rows: int = HOT_ROWS, run_rows: int | None = None
) -> DataFrame:
    """Searches that feed the breakers which guard them: each attempt with ``state, outcome, error``.

    ``attempts`` has ``key, ts, event_id, ok, error``: what a search gives if it runs, and its own error if it
    fails; a key's attempts follow each other by (ts, event_id). Whether one runs hangs on all before it, which is
    the fold of ``breaker_timeline``: an open breaker refuses (``refused``, nothing is counted). Half open, a search
    beyond the probes does run, but its outcome counts for nothing: a good result is thrown away (``lost``), a failure
    keeps its error. Else it is ``found`` or ``failed`` and counted. ``state`` is the breaker's after it. Other columns stay.
    """
    line = breaker_timeline(attempts, rule, hot_rows, run_rows)
    line = line.select(F.col("key").alias("_key"), F.col("event_id").alias("_event"), "admitted", F.col("state").alias("_after"))
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("event_id") == F.col("_event"))
    good = F.coalesce("ok", F.lit(False))
    outcome = (
        F.when(~F.col("admitted") & (F.col("_after") == OPEN), "refused")
        .when(~good, "failed")
        .when(~F.col("admitted"), "lost")
        .otherwise("found")
    )
    told = (
        F.when(outcome == "refused", F.lit(OPEN_ERROR))
        .when(outcome == "lost", F.format_string(PROBES_ERROR, F.coalesce(F.col("key").cast("string"), F.lit(""))))
        .when(outcome == "failed", F.col("error"))
    )
    rest = [c for c in attempts.columns if c not in ("error", "state", "outcome")]
    return attempts.join(line, same).select(
        *rest, F.col("_after").alias("state"), outcome.alias("outcome"), told.alias("error")
    )


def status_report(
    timeline: DataFrame, at, rule: BreakerRule = BreakerRule(), registered: DataFrame | None = None
) -> DataFrame:
    """State of every key as read at time ``at`` (a TIMESTAMP column or literal).

    A key of ``registered`` (``key``) without calls so far is closed.
    """
    latest = (
        timeline.filter(F.col("ts") <= at)
        .groupBy("key")
        .agg(F.max_by(F.struct("state", "opened_at"), F.struct("ts", "event_id")).alias("s"))
        .select("key", "s.state", "s.opened_at")
    )
    if registered is not None:
        latest = registered.select("key").distinct().join(latest, "key", "full")
    return latest.select("key", _state_at(at, rule).alias("state"))
