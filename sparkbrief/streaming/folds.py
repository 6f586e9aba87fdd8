"""Keyed folds over streams that give the rows of their batch forms.

Rows of a micro-batch come in no order, and a later batch may bring an earlier
row. Rows therefore wait in state until the watermark has passed them, and are
then folded in (time, id) order. Rows behind the watermark are dropped by Spark
and counted in the query's progress. A key's rows meet in one task, as keyed
state must; keys are dealt to buckets, and a bucket's keys are folded together.
"""

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from sparkbrief.operators.breaker import CLOSED, OPEN, START, BreakerRule, advance
from sparkbrief.operators.cache import CACHE_SECONDS, look_up


FRAME_ROWS = 10_000
#: Keys are dealt to this many groups of keyed state, since each group costs calls between Spark and Python.
#: A running stream's checkpoint holds the groups by number, so another number needs a new checkpoint.
BUCKETS = 1024


def _named(*columns: str) -> Column:
    """A key as JSON text, which is never null: pandas would read null among whole numbers as a fraction."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("named")


def _names(stream: DataFrame, *columns: str) -> list[Column]:
    """The key columns back from ``named``, with their types."""
    kind = ", ".join(f"`{c}` {stream.schema[c].dataType.simpleString()}" for c in columns)
    return [F.from_json("named", kind)[c].alias(c) for c in columns]


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("named"), F.lit(buckets)).cast("int").alias("bucket")


def _id(stream: DataFrame, column: str) -> list[Column]:
    """A whole number in two columns without nulls: whether it is known, and the number."""
    return [F.col(column).isNotNull().alias("known"), F.coalesce(F.col(column).cast("long"), F.lit(0)).alias("id")]


def _rows_of(batch: pd.DataFrame, columns: list[str]) -> list[tuple]:
    return list(zip(*[batch[c].tolist() for c in columns], strict=True))


class _Rows:
    """Rows of a bucket in state, packed in chunks: a chunk is one value to Spark, whatever the number of its rows."""

    def __init__(self, handle, name: str):
        self._chunks = handle.getListState(name, "chunk binary")

    def read(self) -> list[tuple]:
        return [row for (chunk,) in self._chunks.get() for row in pickle.loads(bytes(chunk))]

    def _packed(self, rows: list[tuple]) -> list[tuple]:
        return [(pickle.dumps(rows[a : a + FRAME_ROWS]),) for a in range(0, len(rows), FRAME_ROWS)]

    def append(self, rows: list[tuple]) -> None:
        if rows:
            self._chunks.appendList(self._packed(rows))

    def put(self, rows: list[tuple]) -> None:
        if rows:
            self._chunks.put(self._packed(rows))
        else:
            self._chunks.clear()


class _Bucket(StatefulProcessor):
    """Keyed state of a bucket of keys, with one timer for all of them."""

    def init(self, handle) -> None:
        self._handle = handle
        self._timer = handle.getValueState("timer", "ms long")

    def _wake(self, ms: int | None, only_earlier: bool = False) -> None:
        """Have the bucket's timer at ``ms`` (None: no timer), or leave it if it is no later."""
        before = self._timer.get()
        before = None if before is None else before[0]
        if before == ms or (only_earlier and before is not None and before <= ms):
            return
        if before is not None:
            self._handle.deleteTimer(before)
        if ms is None:
            self._timer.clear()
        else:
            self._handle.registerTimer(ms)
            self._timer.update((ms,))

    def _woken(self, ms: int | None) -> None:
        """After the timer went off, which has removed it: set the next one."""
        if ms is None:
            self._timer.clear()
        else:
            self._handle.registerTimer(ms)
            self._timer.update((ms,))

    def close(self) -> None:
        pass


def _frames(rows: list[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    for start in range(0, len(rows), FRAME_ROWS):
        yield pd.DataFrame(rows[start : start + FRAME_ROWS], columns=columns)


def _timer_for(us: int) -> int:
    return (us + 999) // 1000


class _InOrder(_Bucket):
    """Holds rows until the watermark has passed them; subclasses fold one row of a key at a time."""

    row_columns: list[str]  # after the key: time in microseconds, then what orders rows of one time
    told_columns: list[str]
    start: tuple

    def init(self, handle) -> None:
        super().init(handle)
        self._waiting = _Rows(handle, "waiting")
        self._kept = _Rows(handle, "kept")  # keys and their folded values

    def fold(self, held: tuple, row: tuple) -> tuple[tuple, tuple]:
        """One row: the value after it, and what is told beside the row's own columns."""
        raise NotImplementedError

    def ends(self, held: tuple) -> int | None:
        """From what time on a key's folded value means no more than a fresh start; None: not by time alone."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        earliest = None
        for batch in rows:
            arrived = _rows_of(batch, ["named", *self.row_columns])
            self._waiting.append(arrived)
            for row in arrived:
                if earliest is None or row[1] < earliest:
                    earliest = row[1]
        if earliest is not None:
            self._wake(_timer_for(earliest), only_earlier=True)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = self._waiting.read()
        ready = sorted(r for r in waiting if r[1] <= passed)
        held = dict(self._kept.read())
        out = []
        for row in ready:
            held[row[0]], told = self.fold(held.get(row[0], self.start), row[1:])
            out.append((*row, *told))
        due = None
        if len(ready) < len(waiting):
            later = [r for r in waiting if r[1] > passed]
            due = min(r[1] for r in later)
            if ready:
                self._waiting.put(later)
        elif waiting:
            self._waiting.put([])
        kept = {}
        for named, value in held.items():
            ends = self.ends(value)
            if ends is None or ends > passed:  # others leave the state; their next row starts anew
                kept[named] = value
                if ends is not None and (due is None or ends < due):
                    due = ends
        if out or len(kept) < len(held):
            self._kept.put(list(kept.items()))
        self._woken(None if due is None else _timer_for(due))
        yield from _frames(out, self.told_columns)


def _in_order(rows: DataFrame, processor: _InOrder, told: str, delay: str, buckets: int) -> DataFrame:
    """``rows(named, ts, us, ...)`` through a processor; rows without a time are never passed, so they are left out."""
    known = rows.withWatermark("ts", delay).filter(F.col("us").isNotNull())
    return known.withColumn("bucket", _bucket(buckets)).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=told, outputMode="append", timeMode="eventTime"
    )


class _Breaker(_InOrder):
    row_columns = ["us", "known", "id", "ok"]
    told_columns = ["named", *row_columns, "admitted", "state", "opened_us"]
    start = START

    def __init__(self, rule: BreakerRule):
        self._rule = rule

    def ends(self, held):
        state, failures, *_ = held
        return 0 if state == CLOSED and failures == 0 else None

    def fold(self, held, row):
        us, _, _, ok = row
        held, admitted = advance(held, us, ok, self._rule)
        return held, (admitted, held[0], held[4] if held[0] == OPEN else -1)


def breaker_stream(
    calls: DataFrame, rule: BreakerRule = BreakerRule(), delay: str = "1 minute", buckets: int = BUCKETS
) -> DataFrame:
    """Streaming form of ``breaker_timeline`` (``key, ts, event_id, ok``)."""
    rows = calls.select(
        _named("key"), "ts", F.unix_micros("ts").alias("us"), *_id(calls, "event_id"),
        F.coalesce("ok", F.lit(False)).alias("ok"),
    )
    kind = "named string, us long, known boolean, id long, ok boolean, admitted boolean, state string, opened_us long"
    told = _in_order(rows, _Breaker(rule), kind, delay, buckets)
    return told.select(
        *_names(calls, "key"),
        F.timestamp_micros("us").alias("ts"),
        F.when(F.col("known"), F.col("id")).alias("event_id"),
        "ok",
        "admitted",
        "state",
        F.when(F.col("state") == OPEN, F.timestamp_micros("opened_us")).alias("opened_at"),
    )


class _Cache(_InOrder):
    row_columns = ["us", "known", "id"]
    told_columns = ["named", *row_columns, "hit", "stored_us"]
    start = (None,)

    def __init__(self, ttl_us: int):
        self._ttl_us = ttl_us

    def ends(self, held):
        return held[0] + self._ttl_us

    def fold(self, held, row):
        stored, hit = look_up(held[0], row[0], self._ttl_us)
        return (stored,), (hit, stored)


_UNTOLD = -(2**62)  # no number of expected places


class _Gather(_Bucket):
    """Results of requests: told as soon as all places of one have come, or when its wait is over."""

    told_columns = ["named", "results", "complete", "late"]

    def __init__(self, gap_us: int):
        self._gap_us = gap_us

    def init(self, handle) -> None:
        super().init(handle)
        # Of each open round: its request, places expected, first and last time, whether it has been told, late results,
        # and what came for which place.
        self._rounds = _Rows(handle, "rounds")

    def _row(self, named, come, complete) -> tuple:
        return named, [come[p] for p in sorted(come)], complete, 0

    def _close(self, named, held) -> list[tuple]:
        """What is left to tell at the end of a round."""
        _, _, _, told, late, come = held
        if not told:
            return [self._row(named, come, False)]
        return [(named, [], None, late)] if late else []

    def _due(self, held) -> int:
        return _timer_for(held[2] + self._gap_us)

    def _hold(self, rounds: dict) -> int | None:
        self._rounds.put(list(rounds.items()))
        return min(map(self._due, rounds.values()), default=None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        out: list[tuple] = []
        arrived = []
        for batch in rows:
            arrived += _rows_of(batch, ["named", "us", "pos", "result", "expected"])
        rounds = dict(self._rounds.read())
        for named, us, pos, result, expected in sorted(arrived, key=lambda r: (*r[:3], r[3] is not None, r[3] or "")):
            held = rounds.get(named)
            if held is not None and us - held[2] >= self._gap_us:
                out += self._close(named, held)
                held = None
            if held is None:
                held = (_UNTOLD, us, us, False, 0, {})
            known, first, last, told, late, come = held
            known = max(known, expected)
            if told:
                late += pos not in come or come[pos] != result
            elif pos not in come or (result is None or (come[pos] is not None and result < come[pos])):
                come[pos] = result
            if not told and known != _UNTOLD and len(come) >= known:
                out.append(self._row(named, come, True))
                told = True
            rounds[named] = (known, min(first, us), max(last, us), told, late, come)
        self._wake(self._hold(rounds))
        yield from _frames(out, self.told_columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        out, rounds = [], {}
        for named, held in self._rounds.read():
            if self._due(held) <= passed:
                out += self._close(named, held)
            else:
                rounds[named] = held
        self._woken(self._hold(rounds))
        yield from _frames(out, self.told_columns)


def fan_in_stream(
    results: DataFrame, gap_seconds: float = 600, delay: str = "1 minute", buckets: int = BUCKETS
) -> DataFrame:
    """Results of each request gathered in ``pos`` order: ``request_id, results, complete, late``.

    ``results`` has ``request_id, ts, pos, expected, result``. Results of a request belong together while each follows
    the last within the gap. They are told, ``complete``, in the micro-batch that brings the last expected place; if
    one never comes, those that did are told once the watermark has passed the gap, not ``complete``. A null result is a
    failed search: it has arrived, and keeps its place. A replayed result counts once, and of different results for
    one place the least counts, null first. Results that differ from what has been told, or have a new place, are late:
    at the end of the gap a row with no results and a null ``complete`` has their count. Without an expected number
    a request waits for the gap. A row older than its request's open round joins it, a null place is one like any other. A request's state is at most its places.
    """
    told = (
        results.withWatermark("ts", delay)
        .filter(F.col("ts").isNotNull())
        .select(
            _named("request_id"), "ts", F.unix_micros("ts").alias("us"),
            F.coalesce(F.col("pos").cast("long"), F.lit(-1)).alias("pos"),
            F.col("result").cast("string").alias("result"),
            F.coalesce(F.col("expected").cast("long"), F.lit(_UNTOLD)).alias("expected"),
        )
        .withColumn("bucket", _bucket(buckets))
        .groupBy("bucket")
        .transformWithStateInPandas(
            statefulProcessor=_Gather(round(gap_seconds * 1_000_000)),
            outputStructType="named string, results array<string>, complete boolean, late int",
            outputMode="append",
            timeMode="eventTime",
        )
    )
    return told.select(*_names(results, "request_id"), "results", "complete", "late")


def ttl_stream(
    lookups: DataFrame, ttl_seconds: float = CACHE_SECONDS, delay: str = "1 minute", buckets: int = BUCKETS
) -> DataFrame:
    """Streaming form of ``ttl_lookups`` (``query, num_results, ts, lookup_id``)."""
    rows = lookups.select(
        _named("query", "num_results"), "ts", F.unix_micros("ts").alias("us"), *_id(lookups, "lookup_id")
    )
    kind = "named string, us long, known boolean, id long, hit boolean, stored_us long"
    told = _in_order(rows, _Cache(round(ttl_seconds * 1_000_000)), kind, delay, buckets)
    return told.select(
        *_names(lookups, "query", "num_results"),
        F.timestamp_micros("us").alias("ts"),
        F.when(F.col("known"), F.col("id")).alias("lookup_id"),
        "hit",
        F.timestamp_micros("stored_us").alias("stored_at"),
    )
