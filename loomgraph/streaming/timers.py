"""Keyed state with timers: transcript buffers that a time-out flushes, and a token limiter that makes messages wait.

Both run on event time: a timer fires once the watermark has passed it, so a
replay gives the same rows whatever the machine's clock says. Late rows, behind
the watermark, are left out before they reach the state. The state lives in the
RocksDB store, which ``with_timers`` chooses for queries that it starts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def with_timers(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state where timers can."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class Transcripts(StatefulProcessor):
    """A buffer a key: fragments in order, flushed by a gap between two of them or by the timer after the last."""

    def __init__(self, key: str, gap_ms: int):
        self.key, self.gap_ms = key, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "text string")
        self.about = handle.getValueState("about", "session long, last long")  # number of the open session, ms of its last fragment

    def _rows(self, key, session: int, buffers: list[list[str]]) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]] * len(buffers), "session": range(session, session + len(buffers)), "fragments": [len(b) for b in buffers], "transcript": [" ".join(b) for b in buffers]})

    def handleInputRows(self, key, rows, timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        p = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        known = self.about.get()
        session, last = known or (1, None)
        at = p["at"].to_numpy()
        # stamps are in order: the latest before a row is the one above it, or what the state holds if that is later
        before = np.maximum(np.concatenate([at[:1] if last is None else [last], at[:-1]]), at[0] if last is None else last)
        cuts = np.flatnonzero(at >= before + self.gap_ms)
        buffers = [list(b) for b in np.split(p["text"].to_numpy(), cuts)]
        if known and len(cuts):  # the first gap flushes what the state holds; nothing, if the timer has
            buffers[0] = [x[0] for x in self.parts.get()] + buffers[0]
            self.parts.clear()
        done = [b for b in buffers[:-1] if b]
        if done:
            yield self._rows(key, session, done)
            session += len(done)
        self.parts.appendList([(x,) for x in buffers[-1]])
        now = int(at[-1]) if last is None else max(last, int(at[-1]))
        if last is not None:
            self.handle.deleteTimer(last + self.gap_ms)
        self.handle.registerTimer(now + self.gap_ms)
        self.about.update((session, now))

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        session, last = self.about.get()
        words = [x[0] for x in self.parts.get()]
        if words:
            self.parts.clear()
            yield self._rows(key, session, [words])
            self.about.update((session + 1, last))

    def close(self) -> None:
        pass


def transcript_stream(events: DataFrame, key: str, ts: str, seq: str, text: str, gap_seconds: int, late: str) -> DataFrame:
    """``key, session, fragments, transcript`` as a stream, like ``sessions`` on batches: a gap of the time-out itself flushes.

    Null and blank fragments take no part, so a buffer is never blank. Fragments
    of a micro-batch are taken in order of stamp and ``seq``, those of different
    ones in order of arrival.
    """
    kind = dict(events.dtypes)
    rows = events.filter(F.trim(text) != "").withWatermark(ts, late).select(key, F.unix_millis(ts).alias("at"), F.col(seq).alias("seq"), F.col(text).alias("text"), ts)
    out = f"{key} {kind[key]}, session long, fragments long, transcript string"
    return rows.groupBy(key).transformWithStateInPandas(Transcripts(key, gap_seconds * 1000), out, "Append", "EventTime")


def release_times(recent: list[tuple[int, int]], arrivals: list[tuple[int, int]], most: int, window_ms: int) -> list[int]:
    """When each of ``arrivals(at, tokens)`` may go, first come first served, after those in ``recent(time, tokens)``, which takes them in.

    At any time no more than ``most`` tokens have gone within the window before;
    a message of more than that goes alone.
    """
    out = []
    for at, tokens in arrivals:
        t = max(at, recent[-1][0] if recent else at)
        while True:
            open_ = [r for r in recent if r[0] > t - window_ms]
            if not open_ or sum(n for _, n in open_) + tokens <= most:
                break
            t = open_[0][0] + window_ms  # the oldest falls out of the window
        recent[:] = [*open_, (t, tokens)]
        out.append(t)
    return out


class TokenLimiter(StatefulProcessor):
    """Messages that fit go at once; others are held, and a timer lets them go."""

    def __init__(self, key: str, most: int, window_ms: int):
        self.key, self.most, self.window_ms = key, most, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "time long, tokens long")
        self.held = handle.getListState("held", "id long, at long, time long")

    def _rows(self, key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]] * len(rows), "id": [r[0] for r in rows], "at": [r[1] for r in rows], "released": [r[2] for r in rows]})

    def handleInputRows(self, key, rows, timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        p = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        recent = [(int(t), int(n)) for t, n in self.recent.get()]
        times = release_times(recent, [(int(a), int(n)) for a, n in zip(p["at"], p["tokens"])], self.most, self.window_ms)
        self.recent.put(recent)
        found = [(int(i), int(a), t) for i, a, t in zip(p["id"], p["at"], times)]
        go = [r for r in found if r[2] == r[1]]
        wait = [r for r in found if r[2] > r[1]]
        if wait:
            self.held.appendList(wait)
            for t in {r[2] for r in wait}:
                self.handle.registerTimer(t)
        if go:
            yield self._rows(key, go)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = [tuple(map(int, r)) for r in self.held.get()]
        rest = [r for r in held if r[2] > now]
        self.held.put(rest) if rest else self.held.clear()
        if len(rest) < len(held):
            yield self._rows(key, [r for r in held if r[2] <= now])

    def close(self) -> None:
        pass


def token_limit_stream(messages: DataFrame, key: str, ts: str, message_id: str, tokens: str, most: int, window_seconds: int, late: str) -> DataFrame:
    """``key, id, at, released`` (ms): messages under a limit of tokens a window, held until their turn; the watermark must reach it for a held one to come out.

    Null keys, stamps, ids and numbers of tokens take no part.
    """
    kind = dict(messages.dtypes)
    rows = messages.dropna(subset=[key, ts, message_id, tokens]).withWatermark(ts, late).select(key, F.unix_millis(ts).alias("at"), F.col(message_id).cast("long").alias("id"), F.col(tokens).cast("long").alias("tokens"), ts)
    return rows.groupBy(key).transformWithStateInPandas(TokenLimiter(key, most, window_seconds * 1000), f"{key} {kind[key]}, id long, at long, released long", "Append", "EventTime")


def token_limited(messages: DataFrame, key: str, ts: str, message_id: str, tokens: str, most: int, window_seconds: int) -> DataFrame:
    """The same on a batch: a scan of each key in order of stamp, holding one window."""
    kind = dict(messages.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, recent = None, []
        for p in batches:
            out = []
            for k, at, n in zip(p[key], p["at"], p["tokens"]):
                if k != now:
                    now, recent = k, []
                out += release_times(recent, [(int(at), int(n))], most, window_seconds * 1000)
            yield pd.DataFrame({key: p[key], "id": p["id"], "at": p["at"], "released": out})

    rows = messages.dropna(subset=[key, ts, message_id, tokens]).select(key, F.unix_millis(ts).alias("at"), F.col(message_id).cast("long").alias("id"), F.col(tokens).cast("long").alias("tokens"))
    return rows.repartition(key).sortWithinPartitions(key, "at", "id").mapInPandas(run, f"{key} {kind[key]}, id long, at long, released long")


def run_with_timers(stream: DataFrame, run: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    with with_timers(stream.sparkSession):
        return run(stream, "append")
