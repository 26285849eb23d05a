"""Attempts as a stream: replay against what was stored, spaced starts, failure streaks, running figures."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def replay(attempts: DataFrame) -> DataFrame:
    """(event_id, key, hit) of a stream of (event_id, key, ts, ok): a key hits once an earlier attempt of it was stored.

    State is one flag a key. Within a batch attempts are taken in order of time and id.
    """

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stored = bool(state.get[0]) if state.exists else False
        rows = pd.concat(parts).sort_values(["ts", "event_id"])
        before = rows["ok"].cumsum().shift(fill_value=0) > 0
        hit = before | stored
        state.update((bool(stored or rows["ok"].any()),))
        yield pd.DataFrame({"event_id": rows["event_id"], "key": key[0], "hit": hit})

    return attempts.groupBy("key").applyInPandasWithState(step, "event_id long, key string, hit boolean", "stored boolean", "append", GroupStateTimeout.NoTimeout)


def throttle(arrivals: DataFrame, gap: float = 1.0) -> DataFrame:
    """(event_id, host, start) of a stream of (event_id, host, at): starts of a host at least ``gap`` seconds apart."""

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else float("-inf")
        rows, starts = pd.concat(parts).sort_values(["at", "event_id"]), []
        for at in rows["at"]:
            starts.append(max(at, free))
            free = starts[-1] + gap
        state.update((float(free),))
        yield pd.DataFrame({"event_id": rows["event_id"], "host": key[0], "start": starts})

    return arrivals.groupBy("host").applyInPandasWithState(step, "event_id long, host string, start double", "free double", "append", GroupStateTimeout.NoTimeout)


def streaks(attempts: DataFrame, abort_at: int = 5) -> DataFrame:
    """(event_id, run, streak, abort) of a stream of (event_id, run, ts, ok): failures in a row; success resets."""

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows, out = pd.concat(parts).sort_values(["ts", "event_id"]), []
        for ok in rows["ok"]:
            n = 0 if ok else n + 1
            out.append(n)
        state.update((int(n),))
        yield pd.DataFrame({"event_id": rows["event_id"], "run": key[0], "streak": out, "abort": [x >= abort_at for x in out]})

    return attempts.groupBy("run").applyInPandasWithState(step, "event_id long, run string, streak long, abort boolean", "n long", "append", GroupStateTimeout.NoTimeout)


def telemetry(attempts: DataFrame, every: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """An extension: attempts, share stored and mean value by window of event time, final once the watermark has passed."""
    return (
        attempts.withWatermark("ts", late)
        .groupBy(F.window("ts", every))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("ok").cast("double")).alias("ok_rate"), F.avg("value").alias("mean_value"))
        .select(F.col("window.start").alias("start"), "n", "ok_rate", "mean_value")
    )


def upsert_sink(stream: DataFrame, path: str, keys: list[str], checkpoint: str, order: str = "seq"):
    """Each batch merged into a keyed table, the last of a key by ``order`` wins; only files with a key of the batch are written.

    The table's versions tell which batches of this checkpoint they hold, so one that runs again changes nothing.
    """
    from ..sources.keyed import KeyedTable

    def merge(batch: DataFrame, n: int) -> None:
        table = KeyedTable(batch.sparkSession, path)
        if not table.numbers():
            table.create(batch.schema, keys)
        table.upsert_retrying(batch.withColumn("_order", F.col(order)), "_order", source=(checkpoint, n))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
