"""Stateful streams in event order: rows wait for the watermark and are released by time, whatever micro-batch brought them.

They need the RocksDB state store.  Rows later than the watermark are dropped;
what waits of a key spans no more event time than the lateness; a null value adds nothing.  A key that has
nothing to wait for and nothing to remember holds no state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed
from .forms import LATE

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _InOrder(StatefulProcessor):
    """Keeps rows until the watermark passes them; ``step`` sees them once, by time and then id."""

    def __init__(self, forget_ms: int | None) -> None:
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at bigint, id bigint", "value double")
        self.kept = handle.getValueState("kept", "number double, at bigint")
        self.timer = handle.getValueState("timer", "at bigint")

    def step(self, kept: float | None, at: int, value: float) -> tuple[float, object | None]:
        """The number to keep after a row, and what to return for it (None: nothing)."""
        raise NotImplementedError

    def out(self, key: tuple, ids: list[int], results: list) -> pd.DataFrame:
        raise NotImplementedError

    def _wake(self, at: int) -> None:
        """One timer per key, for the earliest thing to come."""
        old = self.timer.get()[0] if self.timer.exists() else None
        if old is None or at < old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            for at, n, value in zip(batch["at_us"], batch["event_id"], batch["value"], strict=True):
                self.waiting.updateValue((int(at), int(n)), (0.0 if pd.isna(value) else float(value),))
                first = int(at) if first is None else min(first, int(at))
        if first is not None:
            self._wake(-(-first // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        held = [(*place, value[0]) for place, value in self.waiting.iterator()]
        due = sorted(x for x in held if x[0] <= now * 1000)
        number, last = self.kept.get() if self.kept.exists() else (None, None)
        ids, results = [], []
        for at, n, value in due:
            if number is not None and self.forget_ms is not None and at > last + self.forget_ms * 1000:
                number = None
            before = number
            number, result = self.step(before, at, value)
            last = at if self.remembers(before, result) else last
            if result is not None:
                ids.append(n)
                results.append(result)
            self.waiting.removeKey((at, n))
        rest = [x[0] for x in held if x[0] > now * 1000]
        ends = None if number is None or self.forget_ms is None else -(-last // 1000) + self.forget_ms + 1
        if number is not None and (ends is None or ends > now or rest):
            self.kept.update((number, last))
        else:
            self.kept.clear()
        coming = [-(-at // 1000) for at in rest] + ([ends] if ends is not None and ends > now else [])
        if coming:
            self._wake(min(coming))
        return iter([self.out(key, ids, results)] if ids else ())

    def remembers(self, before: float | None, result: object | None) -> bool:
        """Whether the time of a row is the one from which the key is forgotten."""
        return True

    def close(self) -> None:
        pass


class _Total(_InOrder):
    def step(self, kept, at, value):
        total = (kept or 0.0) + value
        return total, total

    def out(self, key, ids, results):
        return pd.DataFrame({"event_id": ids, "name": key[0], "tag": key[1], "total": results})


class _Cooldown(_InOrder):
    def step(self, kept, at, value):
        return (1.0, 1.0) if kept is None else (kept, None)

    def remembers(self, before, result):
        return result is not None

    def out(self, key, ids, results):
        return pd.DataFrame({"event_id": ids, "rule": key[0]})


def counter(stream: DataFrame, late: str = LATE, idle_seconds: float | None = None) -> DataFrame:
    """Running total of each metric and tag after every point, in event order.

    With ``idle_seconds``, a key whose last point is longer ago starts anew and its state goes.
    """
    rows = stream.withWatermark("ts", late).select("name", "tag", "event_id", "value", F.unix_micros("ts").alias("at_us"), "ts")  # names that begin with "_" do not reach the processor
    forget = None if idle_seconds is None else int(idle_seconds * 1000)
    return rows.groupBy("name", "tag").transformWithStateInPandas(_Total(forget), "event_id bigint, name string, tag bigint, total double", "Append", "EventTime")


def cooldown(alerts: DataFrame, seconds: float = fixed.COOLDOWN_SECONDS, late: str = LATE) -> DataFrame:
    """Alerts that fire, in event order: per rule only later than ``seconds`` after the last that fired; the state goes when that time is over."""
    rows = alerts.withWatermark("ts", late).select("rule", "event_id", F.lit(0.0).alias("value"), F.unix_micros("ts").alias("at_us"), "ts")
    return rows.groupBy("rule").transformWithStateInPandas(_Cooldown(int(seconds * 1000)), "event_id bigint, rule string", "Append", "EventTime")
