"""Streams whose decisions depend on what each key has done before: state by key, cleared by event-time timers.

Rows wait in the state of their key until the watermark has passed them and are then decided in the order of their times, so
that the result is that of the batch operators whatever the order of arrival (within the allowed lateness), the cut into
micro-batches, or the restarts. With `wait=False` rows are decided as they arrive, in order within a micro-batch: the answer is
there at once, and equals the batch result where the stream is in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.functions.limits import Sightings, Throttle

#: State with lists and timers is kept by this provider.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark: SparkSession) -> None:
    """Streams started from now on keep their state in the provider that lists and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _latest(past: list[int]) -> int:
    """The latest time that is remembered; answers are kept as negative numbers."""
    return max(t if t >= 0 else -t - 1 for t in past)


class InOrder(StatefulProcessor):
    """Decides each key's rows in order. rule() makes the decider of a key; what it must remember is a list of times.

    State of a key: `times` (microseconds) and `pending` (rows not decided yet). A timer stands at the first time that matters: of
    a pending row, else the one from which nothing of the past counts any more, when the state is cleared.
    """

    def __init__(self, key: str, rule: Callable[[], Any], columns: list[str], wait: bool):
        self.key, self.rule, self.columns, self.wait = key, rule, columns, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "t long")
        self.pending = handle.getListState("pending", "at timestamp, tag string") if self.wait else None

    def _past(self) -> list[int]:
        return [x[0] for x in self.times.get()] if self.times.exists() else []

    def _decide(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        rule = self.rule()
        rule.recall(self._past())
        out = [(key[0], at, tag, *rule.decide(int(at.value // 1000))) for at, tag in sorted(rows)]
        held = rule.memory()
        self.times.put([(t,) for t in held]) if held else self.times.clear()
        return pd.DataFrame(out, columns=[self.key, "at", "tag", *self.columns])

    def _wake(self, pending: list[tuple]) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        past = self._past()
        ends = [int(min(at for at, _ in pending).value // 1_000_000)] if pending else [self.rule().forgets(_latest(past)) // 1000 + 1] if past else []
        for t in ends:
            self.handle.registerTimer(t)

    def _step(self, key: tuple, rows: list[tuple], watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Decide what the watermark has passed, keep the rest."""
        ready = [r for r in rows if not self.wait or r[0].value // 1_000_000 < watermark_ms]
        rest = [r for r in rows if self.wait and r[0].value // 1_000_000 >= watermark_ms]
        if self.wait:
            self.pending.put(rest) if rest else self.pending.clear()
        if ready:
            yield self._decide(key, ready)
        self._wake(rest)

    def _waiting(self) -> list[tuple]:
        return [(pd.Timestamp(at), tag) for at, tag in self.pending.get()] if self.wait and self.pending.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(pd.Timestamp(at), tag) for pdf in rows for at, tag in zip(pdf["at"], pdf["tag"], strict=True)]
        yield from self._step(key, self._waiting() + new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        waiting, now = self._waiting(), timerValues.getCurrentWatermarkInMs()
        past = self._past()
        if not waiting and past and self.rule().forgets(_latest(past)) // 1000 < now:
            self.times.clear()
            return
        yield from self._step(key, waiting, now)

    def close(self) -> None:
        pass


def _decided(rows: DataFrame, key: str, rule: Callable[[], Any], outputs: dict[str, str], late: str, wait: bool) -> DataFrame:
    """rows is a stream of (key, at, tag); tag tells rows of one time apart and decides which of them is first."""
    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, at timestamp, tag string, {', '.join(f'{n} {t}' for n, t in outputs.items())}"
    lean = rows.select(key, "at", "tag").where(f"{key} is not null and at is not null").withWatermark("at", late)
    made = InOrder(key, rule, list(outputs), wait)
    return lean.groupBy(key).transformWithStateInPandas(statefulProcessor=made, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def throttled(rows: DataFrame, key: str, *, most: int = 30, seconds: int = 3600, late: str = "1 hour", wait: bool = True) -> DataFrame:
    """(key, at, tag, allowed, in_window, reply) for a stream of (key, at, tag): see limits.Throttle. Rows without key or time, and later than `late`, are dropped."""
    return _decided(rows, key, lambda: Throttle(most, seconds), {"allowed": "boolean", "in_window": "int", "reply": "boolean"}, late, wait)


def first_sightings(rows: DataFrame, key: str, *, hours: int = 24, late: str = "1 hour", wait: bool = True) -> DataFrame:
    """(key, at, tag, fresh) for a stream of (key, at, tag): a sighting is fresh unless a fresh one of the same key lies less than `hours` before it."""
    return _decided(rows, key, lambda: Sightings(hours * 3600), {"fresh": "boolean"}, late, wait)
