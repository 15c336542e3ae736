"""Queue abandonment with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from dwellgrid.streaming.flows import timed

OUT_SCHEMA = "store_id string, visitor_id string, event_id string, abandon_us long"


class AbandonProcessor(StatefulProcessor):
    """Per visitor: remembers the open queue stay and reports it once the limit passes without a purchase."""

    def __init__(self, limit_seconds: int = 120):
        self.limit_us = limit_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        schema = StructType([StructField("event_id", StringType()), StructField("join_us", LongType())])
        self.stay = handle.getValueState("stay", schema)

    def _row(self, key, event_id: str, join_us: int) -> tuple:
        return (key[0], key[1], event_id, join_us + self.limit_us)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["us", "event_id"])
        current = tuple(self.stay.get()) if self.stay.exists() else None
        before, out = current, []
        for event_id, us, kind in zip(frame["event_id"], frame["us"], frame["event_type"]):
            if current is not None:
                if kind != "PURCHASE" and us - current[1] >= self.limit_us:
                    out.append(self._row(key, *current))
                current = None
            if kind == "BILLING_QUEUE_JOIN":
                current = (str(event_id), int(us))
        if current != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if current is None:
                self.stay.clear()
            else:
                self.stay.update(current)
                self.handle.registerTimer(-(-(current[1] + self.limit_us) // 1000))
        yield pd.DataFrame(out, columns=["store_id", "visitor_id", "event_id", "abandon_us"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.stay.exists():
            out.append(self._row(key, *self.stay.get()))
            self.stay.clear()
        yield pd.DataFrame(out, columns=["store_id", "visitor_id", "event_id", "abandon_us"])

    def close(self) -> None:
        pass


def queue_abandons(events: DataFrame, limit_seconds: int = 120, delay: str | None = "10 minutes") -> DataFrame:
    rows = timed(events, "ts", delay).selectExpr(
        "store_id", "visitor_id", "event_id", "event_type", "ts", "unix_micros(ts) AS us"
    )
    return rows.groupBy("store_id", "visitor_id").transformWithStateInPandas(
        statefulProcessor=AbandonProcessor(limit_seconds), outputStructType=OUT_SCHEMA,
        outputMode="Append", timeMode="EventTime",
    )
