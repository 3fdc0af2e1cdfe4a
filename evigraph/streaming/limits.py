"""Stateful limits per user: a rate limit that counts from the last accepted event, and attempt windows that begin with
their first event. Both as ordered folds over a table, and the rate limit on a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_OUT = "event_id long, user_id long, ts timestamp, accepted boolean"


def _ordered(events: DataFrame, step) -> DataFrame:
    """Fold events by user in order of time: rows pass through one by one, only the last user's state is held."""
    rows = events.select("event_id", "user_id", "ts").repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, state = None, None
        for p in parts:
            out = []
            for u, t in zip(p["user_id"].tolist(), p["ts"].tolist(), strict=True):
                if u != user:
                    user, state = u, None
                state, ok = step(state, t.timestamp())
                out.append(ok)
            yield p.assign(accepted=out)

    return rows.mapInPandas(run, _OUT)


def rate_limit(events: DataFrame, seconds: float = 10.0) -> DataFrame:
    """An event is accepted if the user's last accepted one is so long ago."""
    return _ordered(events, lambda last, t: (t, True) if last is None or t - last >= seconds else (last, False))


def attempt_window(events: DataFrame, seconds: float = 900.0, most: int = 20) -> DataFrame:
    """At most so many attempts in a window that begins with its first attempt; the next after its end begins another."""

    def step(state, t):
        began, n = state or (None, 0)
        if began is None or t - began >= seconds:
            return (t, 1), most >= 1
        return (began, n + 1), n + 1 <= most

    return _ordered(events, step)


class RateLimit(StatefulProcessor):
    """The rate limit on a stream: a user's last accepted time is the state, dropped when it no longer matters."""

    def __init__(self, seconds: float = 10.0):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at double", ttlDurationMs=int(self.seconds * 1000) + 86_400_000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        p = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        last, out = self.last.get()[0] if self.last.exists() else None, []
        for t in p["ts"].tolist():
            ok = last is None or t.timestamp() - last >= self.seconds
            last = t.timestamp() if ok else last
            out.append(ok)
        if last is not None:
            self.last.update((last,))
        yield p[["event_id", "user_id", "ts"]].assign(accepted=out)

    def close(self) -> None:
        pass


def rate_limited(stream: DataFrame, seconds: float = 10.0) -> DataFrame:
    """The stream's events with accepted; needs the RocksDB state store."""
    return stream.select("event_id", "user_id", "ts").groupBy(F.col("user_id")).transformWithStateInPandas(RateLimit(seconds), _OUT, "append", "processingTime")


CACHE_SECONDS, CACHE_ENTRIES = 300.0, 100
_HITS = "event_id long, cache long, key string, ts timestamp, hit boolean"


def _look_up(entries: dict[str, float], key: str, t: float, seconds: float, most: int) -> bool:
    """Is the key's entry still good? Else it is put in, after the oldest entry has gone if there are `most`. A key that is put in again keeps its place."""
    if entries.get(key, t) > t:
        return True
    if len(entries) >= most:
        del entries[next(iter(entries))]
    entries[key] = t + seconds
    return False


def ttl_cache(requests: DataFrame, seconds: float = CACHE_SECONDS, most: int = CACHE_ENTRIES) -> DataFrame:
    """event_id, cache, key, ts, hit of each request, in each cache in order of time: entries are good for so many seconds, the first in goes first out."""
    rows = requests.select("event_id", "cache", "key", "ts").repartition("cache").sortWithinPartitions("cache", "ts", "event_id")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, entries = None, {}
        for p in parts:
            out = []
            for c, k, t in zip(p["cache"].tolist(), p["key"].tolist(), p["ts"].tolist(), strict=True):
                if c != cache:
                    cache, entries = c, {}
                out.append(_look_up(entries, k, t.timestamp(), seconds, most))
            yield p.assign(hit=out)

    return rows.mapInPandas(run, _HITS)


class TtlCache(StatefulProcessor):
    """The cache on a stream: its keys in the order they came in, and until when each is good. A timer drops a cache that nobody has asked for so long that nothing in it is good."""

    def __init__(self, seconds: float = CACHE_SECONDS, most: int = CACHE_ENTRIES):
        self.seconds, self.most = seconds, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getValueState("entries", "keys array<string>, until array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        p = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        held = self.entries.get() if self.entries.exists() else ([], [])
        entries = dict(zip(list(held[0]), list(held[1]), strict=True))
        hits = [_look_up(entries, k, t.timestamp(), self.seconds, self.most) for k, t in zip(p["key"].tolist(), p["ts"].tolist(), strict=True)]
        self.entries.update((list(entries), list(entries.values())))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms())
        yield p[["event_id", "cache", "key", "ts"]].assign(hit=hits)

    def keep_ms(self) -> int:
        """Events may be late by a day against the clock."""
        return int(self.seconds * 1000) + 86_400_000

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.entries.clear()
        yield from ()

    def close(self) -> None:
        pass


def ttl_cached(stream: DataFrame, seconds: float = CACHE_SECONDS, most: int = CACHE_ENTRIES) -> DataFrame:
    """The stream's requests with hit; needs the RocksDB state store."""
    return stream.select("event_id", "cache", "key", "ts").groupBy(F.col("cache")).transformWithStateInPandas(TtlCache(seconds, most), _HITS, "append", "processingTime")
