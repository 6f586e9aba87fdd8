"""Which requests of a stream a limit admits, told once and never taken back."""

from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from sparkbrief.operators.limits import LIMIT, WINDOW
from sparkbrief.streaming.folds import _bucket, _frames, _named, _names, _Rows, _rows_of

_ROW = ["named", "us", "known", "request"]
BUCKETS = 64  # groups of keyed state that a window's clients are dealt to


class _Admission(StatefulProcessor):
    """Holds each client's first requests in one window, at most ``limit``; those behind them are told at once."""

    def __init__(self, limit: int):
        self._limit = limit

    def init(self, handle) -> None:
        self._handle = handle
        self._first = _Rows(handle, "first")

    def _told(self, rows: list[tuple], admitted: bool) -> Iterator[pd.DataFrame]:
        for frame in _frames(rows, _ROW):
            yield frame.assign(admitted=admitted)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        first: dict[str, list] = {}
        held = self._first.read()
        for named, *rest in held:
            first.setdefault(named, []).append(tuple(rest))
        end = None
        for batch in rows:  # as Arrow brings them, so a crowded window is never held whole
            refused = []
            for named, *rest in _rows_of(batch, _ROW):
                own = first.setdefault(named, [])
                insort(own, tuple(rest))
                if len(own) > self._limit:
                    # Whatever still comes can only push it further back.
                    refused.append((named, *own.pop()))
            end = int(batch["end_ms"].iloc[0]) if len(batch) else end
            yield from self._told(refused, False)
        now = [(named, *rest) for named, own in first.items() for rest in own]
        if now != held:
            self._first.put(now)
        if now and not held:
            self._handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._told(self._first.read(), True)
        self._first.put([])

    def close(self) -> None:
        pass


def admit_stream(
    accesses: DataFrame, limit: int = LIMIT, window: str = WINDOW, delay: str = "1 minute", buckets: int = BUCKETS
) -> DataFrame:
    """Streaming form of ``limits.admit``: ``client, ts, request_key, window_start, admitted``.

    A request is refused as soon as ``limit`` earlier ones of its client's window have come; the others are admitted
    once the watermark has passed the window's end, as an earlier one might still come until then. So a window's state is at
    most ``limit`` requests, and nothing told changes. Request keys, whole numbers or texts, tell a client's requests of
    one time apart; null comes first, and a null client is one like any other. A null time is in no window and not told.
    """
    text = isinstance(accesses.schema["request_key"].dataType, T.StringType)
    kind, nothing = ("string", F.lit("")) if text else ("long", F.lit(0).cast("long"))
    placed = accesses.withWatermark("ts", delay).withColumn("at", F.window("ts", window))
    placed = placed.withColumn("window_start", F.col("at.start"))
    told = (
        placed.select(
            _named("client", "window_start"), "ts", F.unix_micros("ts").alias("us"),
            F.unix_millis("at.end").alias("end_ms"),
            F.col("request_key").isNotNull().alias("known"),
            F.coalesce(F.col("request_key").cast(kind), nothing).alias("request"),
        )
        .withColumn("bucket", _bucket(buckets))
        .groupBy("end_ms", "bucket")
        .transformWithStateInPandas(
            statefulProcessor=_Admission(limit),
            outputStructType=f"named string, us long, known boolean, request {kind}, admitted boolean",
            outputMode="append",
            timeMode="eventTime",
        )
    )
    request = F.when(F.col("known"), F.col("request")).cast(accesses.schema["request_key"].dataType)
    return told.select(
        *_names(placed, "client", "window_start"),
        F.timestamp_micros("us").alias("ts"),
        request.alias("request_key"),
        "admitted",
    )
