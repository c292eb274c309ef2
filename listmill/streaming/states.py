"""Keyed state that ends: processors for transformWithStateInPandas whose state goes by timers on event time.

A key's state is dropped once the watermark has passed the time after which it can no longer matter, so that idle keys hold nothing.
All need the RocksDB state store; expiring() asks the session for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def expiring(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str = "append") -> DataFrame:
    """Rows of a stream (with a watermark) by key through `processor`."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, mode, "eventTime")


class Expiring(StatefulProcessor):
    """State with one timer; it is cleared when the timer fires."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def drop(self) -> None:
        raise NotImplementedError

    def ends_at(self, ms: int | None, timers: TimerValues) -> bool:
        """Sets the timer anew; False if that time has passed already. None: no end."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if ms is None:
            return True
        if ms <= timers.getCurrentWatermarkInMs():
            return False
        self.handle.registerTimer(ms)
        return True

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.drop()
        return iter([])

    def close(self) -> None:
        pass


class Held(Expiring):
    """Requests (t, id) of a key in order: what `step(held, t)` says of each. `held`, a list of times, matters for `seconds` after its last."""

    def __init__(self, step: Callable[[list[float], float], bool], seconds: float, name: str):
        self.step, self.seconds, self.name = step, seconds, name

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("held", "t double")

    def drop(self) -> None:
        self.times.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [t for (t,) in self.times.get()]
        frame = pd.concat(list(rows)).sort_values(["t", "id"])
        out = [self.step(held, t) for t in frame["t"].tolist()]
        if held and self.ends_at(int(1000 * (held[-1] + self.seconds)) + 1, timerValues):
            self.times.put([(t,) for t in held])
        else:
            self.times.clear()
        yield pd.DataFrame({"key": frame["key"].tolist(), "t": frame["t"].tolist(), "id": frame["id"].tolist(), self.name: out})


class Lifecycle(Expiring):
    """State of a job after its actions in order; a job that has ended is forgotten `seconds` after its last event."""

    def __init__(self, fold: Callable[[tuple, list[tuple]], tuple], ended: tuple[str, ...], seconds: float | None):
        self.fold, self.ended, self.seconds = fold, ended, seconds

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", "state string, asked boolean, ms long")

    def drop(self) -> None:
        self.job.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values(["ms", "event_id", "action"])
        state, asked, ms = self.fold(self.job.get() if self.job.exists() else None, list(zip(frame["ms"].tolist(), frame["action"].tolist(), strict=True)))
        end = None if self.seconds is None or state not in self.ended else ms + int(1000 * self.seconds) + 1
        if self.ends_at(end, timerValues):
            self.job.update((state, asked, ms))
        else:
            self.job.clear()
        yield pd.DataFrame({"job_id": [key[0]], "state": [state]})
