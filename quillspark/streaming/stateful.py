"""Streams with state of their own: debounced queries, unread counts with corrections, and readiness that runs out.

Each has a batch operator beside it, and gives the same rows for events that
arrive in any order, repeatedly, or late by less than the watermark allows.
State is bounded: it holds what the watermark or a lifetime has not decided.
The session's state store must be RocksDB (:func:`use_rocksdb`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quillspark.operators.index import SearchIndex

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


class _Debounce(StatefulProcessor):
    """Keeps the events of a session until no other one can follow within the delay."""

    def __init__(self, delay_ms: int):
        self.delay = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, query string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {(a, q) for a, q in self.waiting.get()} if self.waiting.exists() else set()
        for batch in rows:
            held |= {(int(a), q) for a, q in zip(batch["us"], batch["query"], strict=True)}
        self.waiting.put(sorted(held, key=lambda e: (e[0], e[1] or "")))
        for at in {a for a, _ in held}:
            self.handle.registerTimer(at // 1000 + self.delay + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self.waiting.get()) if self.waiting.exists() else []
        sent, rest = [], []
        for k, (at, query) in enumerate(held):
            if at + self.delay * 1000 > now:
                rest.append((at, query))
            elif k + 1 == len(held) or held[k + 1][0] - at >= self.delay * 1000:
                sent.append((at, query))
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if sent:
            yield pd.DataFrame({"session": [key[0]] * len(sent), "at": pd.to_datetime([a for a, _ in sent], unit="us"), "query": [q for _, q in sent]})

    def close(self) -> None:
        pass


def settled(events: DataFrame, delay_ms: int, late: str = "10 seconds") -> DataFrame:
    """(session, at, query) of typed queries which are sent, as :func:`quillspark.operators.review.settled` in batches.

    A query is sent once the watermark has passed its delay without another
    one in the session. Repeated events count once; sessions without a time
    have none sent.
    """
    timed = events.filter("at is not null").withWatermark("at", late)
    rows = timed.select("session", "at", "query", F.unix_micros("at").alias("us"))
    kind = dict(events.dtypes)["session"]
    return rows.groupBy("session").transformWithStateInPandas(_Debounce(delay_ms), f"session {kind}, at timestamp, query string", "append", "EventTime")


class _Unread(StatefulProcessor):
    """The newest word on each notification of a space; those read are only remembered for a while."""

    def __init__(self, remember_ms: int):
        self.remember = remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.unread = handle.getMapState("unread", "id string", "at long")
        self.read = handle.getMapState("read", "id string", "at long", ttlDurationMs=self.remember)
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        for batch in rows:
            for i, at, is_read in zip(batch["id"], batch["us"], batch["is_read"], strict=True):
                name, at = (i,), int(at)
                was_unread, was_read = self.unread.containsKey(name), self.read.containsKey(name)
                known = self.unread.getValue(name)[0] if was_unread else self.read.getValue(name)[0] if was_read else None
                # of one time, read counts
                if known is not None and (at < known or (at == known and not (is_read and was_unread))):
                    continue
                if is_read:
                    if was_unread:
                        self.unread.removeKey(name)
                        n -= 1
                    self.read.updateValue(name, (at,))
                else:
                    if was_read:
                        self.read.removeKey(name)
                    n += not was_unread
                    self.unread.updateValue(name, (at,))
        self.count.update((n,))
        yield pd.DataFrame({"space": [key[0]], "unread": [n]})

    def close(self) -> None:
        pass


def unread_counts(changes: DataFrame, remember_ms: int = 7 * 24 * 3_600_000) -> DataFrame:
    """(space, unread) after each micro-batch, from ``changes`` (space, id, at, is_read) of notifications, corrections included.

    The newest change of a notification counts, in whatever order changes
    arrive; of equal times read wins. What was read is remembered for
    ``remember_ms`` since it came in, so an older change that arrives later
    than that counts as new. Lifetimes go by the clock: a query that shall end
    with its input needs micro-batches without data switched off.
    """
    rows = changes.filter("id is not null and at is not null").select("space", F.col("id").cast("string").alias("id"), F.unix_micros("at").alias("us"), F.coalesce("is_read", F.lit(False)).alias("is_read"))
    kind = dict(changes.dtypes)["space"]
    return rows.groupBy("space").transformWithStateInPandas(_Unread(remember_ms), f"space {kind}, unread long", "update", "ProcessingTime")


def unread_now(changes: DataFrame) -> DataFrame:
    """(space, unread) of a table of the same changes."""
    newest = changes.filter("id is not null and at is not null").groupBy("space", "id").agg(F.max(F.struct("at", F.coalesce("is_read", F.lit(False)).alias("is_read"))).alias("x"))
    return newest.groupBy("space").agg(F.count_if(~F.col("x.is_read")).alias("unread"))


class _Ready(StatefulProcessor):
    """The newest check of an agent, until it is too old."""

    def __init__(self, ms: int):
        self.ms = ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "at long, ready boolean")

    def _row(self, key, state: str) -> pd.DataFrame:
        return pd.DataFrame({"agent": [key[0]], "state": [state]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = self.newest.get() if self.newest.exists() else None
        for batch in rows:
            for at, ready in zip(batch["us"], batch["ready"], strict=True):
                if best is None or (int(at), bool(ready)) > tuple(best):
                    best = (int(at), bool(ready))
        self.newest.update(best)
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(best[0] // 1000 + self.ms + 1)
        yield self._row(key, "ready" if best[1] else "not ready")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.newest.clear()
        yield self._row(key, "unknown")

    def close(self) -> None:
        pass


def readiness(checks: DataFrame, seconds: int = 30, late: str = "10 seconds") -> DataFrame:
    """(agent, state) whenever it may have changed: ready, not ready, or unknown once the newest check is too old by event time."""
    rows = checks.filter("checked_at is not null").withWatermark("checked_at", late)
    rows = rows.select("agent", "checked_at", F.unix_micros("checked_at").alias("us"), F.coalesce("ready", F.lit(False)).alias("ready"))
    kind = dict(checks.dtypes)["agent"]
    return rows.groupBy("agent").transformWithStateInPandas(_Ready(seconds * 1000), f"agent {kind}, state string", "update", "EventTime")


def index_stream(stream: DataFrame, index: SearchIndex, name: str, checkpoint: str) -> StreamingQuery:
    """Take the pages of a stream into a stored index; each micro-batch is one version.

    The version carries the stream's ``name`` and the batch's number, so a
    batch that is run again after a crash changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        index.upsert(batch, name, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
