"""Attempts as a stream in the order of their event time: rows wait until the watermark has passed them, so that late ones count."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class InEventOrder(StatefulProcessor):
    """Rows of a key are kept in a list until the watermark passes them, then folded by time and id.

    fold: (state or None, time in microseconds, row) -> (state, results). ``forget``: (state, watermark in microseconds) ->
    whether a state that is idle says the same as none, and may go.
    """

    def __init__(self, fold: Callable, state: str, row: str, results: list[str], forget: Callable):
        self.fold, self.state, self.row, self.results, self.forget = fold, state, row, results, forget
        self.columns = [c.split()[0] for c in row.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.last = handle.getValueState("last", self.state)

    def _timer(self, rows: list[tuple]) -> None:
        due = min(r[0] for r in rows) // 1000 + 1  # milliseconds; what is at or before a watermark is complete
        if due not in {int(t) for t in self.handle.listTimers()}:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(int(t))
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        for part in rows:
            waiting += [tuple(x.item() if hasattr(x, "item") else x for x in r) for r in part[self.columns].itertuples(index=False, name=None)]
        self.waiting.put(waiting)
        self._timer(waiting)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        due = [r for r in rows if r[0] < passed]
        state, out = self.last.get() if self.last.exists() else None, []
        for at, row_id, *rest in due:
            state, results = self.fold(state, at, *rest)
            out.append((key[0], row_id, *results))
        left = rows[len(due) :]
        if left:
            self.waiting.put(left)
            self._timer(left)
        else:
            self.waiting.clear()
        if state is None or not left and self.forget(state, passed):
            self.last.clear()
        else:
            self.last.update(state)
            if not left:
                self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + 3_600_000)  # looked at again, to be forgotten
        yield pd.DataFrame(out, columns=["key", "event_id", *self.results])

    def close(self) -> None:
        pass


def in_event_order(stream: DataFrame, key: str, time: str, values: dict[str, str], results: dict[str, str], fold: Callable, state: str, late: str, forget: Callable = lambda state, passed: False) -> DataFrame:
    """(key, event_id, results) of a stream of (event_id, key, time, values): what ``fold`` gives for each row in the order of time.

    A row that comes up to ``late`` after later ones is in its place, so the result is that of a batch, whatever order rows
    arrive in; one that comes later still is dropped. A result comes once the watermark has passed its row.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    rows = stream.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    rows = rows.select(F.col(key).cast("string").alias("_key"), micros.alias("at"), F.col("event_id").cast("long").alias("event_id"), *[F.col(c).cast(t).alias(c) for c, t in values.items()], "_time")
    kept = ", ".join(["at long", "event_id long", *[f"{c} {t}" for c, t in values.items()]])
    out = ", ".join(["key string", "event_id long", *[f"{c} {t}" for c, t in results.items()]])

    processor = InEventOrder(fold, state, kept, list(results), forget)
    return rows.groupBy("_key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime")


def replay(attempts: DataFrame, late: str = "10 minutes") -> DataFrame:
    """ST1: (key, event_id, hit) of (event_id, key, ts, ok): a key hits once an earlier attempt of it was stored."""

    def fold(state, at, ok):
        stored = bool(state and state[0])
        return (stored or bool(ok),), (stored,)

    return in_event_order(attempts, "key", "ts", {"ok": "boolean"}, {"hit": "boolean"}, fold, "stored boolean", late)


def throttle(arrivals: DataFrame, gap: float = 1.0, late: str = "10 minutes") -> DataFrame:
    """ST2: (key, event_id, start) of (event_id, host, ts): starts of a host at least ``gap`` seconds apart, in seconds.

    A host whose next start lies before the watermark is as free as one never seen, and its state goes.
    """

    def fold(state, at):
        start = at / 1e6 if state is None else max(at / 1e6, state[0])
        return (start + gap,), (start,)

    return in_event_order(arrivals, "host", "ts", {}, {"start": "double"}, fold, "free double", late, lambda state, passed: state[0] * 1e6 <= passed)


def streaks(attempts: DataFrame, abort_at: int = 5, late: str = "10 minutes") -> DataFrame:
    """ST3: (key, event_id, streak, abort) of (event_id, run, ts, ok): failures in a row; success resets. A run without a failure has no state."""

    def fold(state, at, ok):
        n = 0 if ok else (state[0] if state else 0) + 1
        return (n,), (n, n >= abort_at)

    return in_event_order(attempts, "run", "ts", {"ok": "boolean"}, {"streak": "long", "abort": "boolean"}, fold, "n long", late, lambda state, passed: state[0] == 0)


def progress(attempts: DataFrame, every: int = 100, late: str = "10 minutes") -> DataFrame:
    """ST4, ST6: (key, event_id, done, ok_rate, checkpoint) of (event_id, run, ts, ok): running figures, and where a checkpoint is due."""

    def fold(state, at, ok):
        done, good = (state or (0, 0))[0] + 1, (state or (0, 0))[1] + bool(ok)
        return (done, good), (done, good / done, done % every == 0)

    return in_event_order(attempts, "run", "ts", {"ok": "boolean"}, {"done": "long", "ok_rate": "double", "checkpoint": "boolean"}, fold, "done long, good long", late)
