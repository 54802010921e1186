"""Keyed state of streams that ends by itself: timers in event time, a time to live, list and map state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The operators below keep their state in RocksDB; a provider of the user's own stays as it is."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBacked" in spark.conf.get(name, "HDFSBacked"):
        spark.conf.set(name, _ROCKSDB)


def _micros(c: pd.Series) -> pd.Series:
    return c.astype("datetime64[us]").astype("int64")


def _one_timer(handle: StatefulProcessorHandle, at_ms: int) -> None:
    for old in list(handle.listTimers()):
        if old != at_ms:
            handle.deleteTimer(old)
    handle.registerTimer(at_ms)


class _Admission(StatefulProcessor):
    """Admitted times of a key, at most ``limit``; they go when the watermark has passed the window."""

    def __init__(self, at: str, tie: str, limit: int, seconds: float) -> None:
        self.at, self.tie, self.limit, self.span = at, tie, limit, int(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("admitted", "at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        df = pd.concat(list(rows)).sort_values([self.at, self.tie], kind="stable")
        times, flags = [t for (t,) in self.times.get()], []
        for t in _micros(df[self.at]):
            times = [x for x in times if t - x < self.span]
            flags.append(len(times) < self.limit)
            if flags[-1]:
                times.append(int(t))
        self.times.put([(x,) for x in times])
        _one_timer(self.handle, max(times) // 1000 + self.span // 1000 + 1)
        yield pd.DataFrame({"key": [str(key[0])] * len(df), "id": df[self.tie].astype(str).to_list(), "admitted": flags})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        self.times.clear()  # the timer was set for the newest of them
        yield from ()

    def close(self) -> None:
        pass


def admission_stream(events: DataFrame, *, key: str, at: str, limit: int, seconds: float, tie: str, late: str = "1 hour") -> DataFrame:
    """(key, id, admitted) of a stream: fewer than ``limit`` admitted ones of the key lie within the window before.

    Rows of a batch are taken in order of time; a key's state is its admitted times in the window, and ends once the
    watermark is past them, as no row that is still let in can see them. Rows later than ``late`` may be dropped.
    """
    use_rocksdb(events.sparkSession)
    grouped = events.withWatermark(at, late).groupBy(key)
    return grouped.transformWithStateInPandas(_Admission(at, tie, limit, seconds), "key string, id string, admitted boolean", "Append", "EventTime")


class _Views(StatefulProcessor):
    """The latest view of each job of a user; the newest ``keep`` stay, and each ends after its time to live."""

    def __init__(self, job: str, at: str, keep: int, ttl_ms: int | None) -> None:
        self.job, self.at, self.keep, self.ttl_ms = job, at, keep, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.views = handle.getMapState("views", "job string", "at bigint", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        newest: dict[str, int] = {}
        for df in rows:
            for job, t in zip(df[self.job].astype(str), _micros(df[self.at]), strict=True):
                newest[job] = max(t, newest.get(job, t))
        changed = []
        for job, t in newest.items():
            old = self.views.getValue((job,)) if self.views.containsKey((job,)) else None
            if old is None or t > old[0]:
                self.views.updateValue((job,), (int(t),))
                changed.append((job, t))
        held = sorted(((at, job) for (job,), (at,) in self.views.iterator()), key=lambda x: (-x[0], x[1]))
        for _, job in held[self.keep :]:
            self.views.removeKey((job,))
        kept = {job for _, job in held[: self.keep]}
        changed = [c for c in changed if c[0] in kept]
        yield pd.DataFrame({"user": [str(key[0])] * len(changed), "job": [j for j, _ in changed], "viewed_at": pd.to_datetime([t for _, t in changed], unit="us")})

    def close(self) -> None:
        pass


def viewed_stream(views: DataFrame, *, user: str = "user_id", job: str = "job_id", at: str = "viewed_at", keep: int = 200, days: float | None = None) -> DataFrame:
    """(user, job, viewed_at) where a view is newer than the one known and among the newest ``keep`` of its user.

    State is a map of at most ``keep`` jobs a user; with ``days`` an entry ends so long after it was last written.
    """
    use_rocksdb(views.sparkSession)
    ttl = None if days is None else max(1, int(days * 86_400_000))
    return views.groupBy(user).transformWithStateInPandas(_Views(job, at, keep, ttl), "user string, job string, viewed_at timestamp", "Update", "ProcessingTime" if ttl else "None")


class _Due(StatefulProcessor):
    """The last good check and last attempt of a page; a timer says when it is due again."""

    def __init__(self, at: str, verified: str, ttl_ms: int, retry_ms: int, forget: int) -> None:
        self.at, self.verified, self.ttl_ms, self.retry_ms, self.forget = at, verified, ttl_ms, retry_ms, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.page = handle.getValueState("page", "checked bigint, attempted bigint, misses int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        checked, attempted, misses = self.page.get() if self.page.exists() else (None, None, 0)
        df = pd.concat(list(rows))
        for t, good in sorted(zip(_micros(df[self.at]) // 1000, df[self.verified], strict=True)):
            attempted = max(int(t), attempted or 0)
            if good:
                checked, misses = max(int(t), checked or 0), 0
        self.page.update((checked, attempted, misses))
        _one_timer(self.handle, max(attempted + self.retry_ms, (checked + self.ttl_ms) if checked is not None else 0) + 1)
        yield pd.DataFrame({"key": pd.Series([], dtype=str), "due_at": pd.Series([], dtype="datetime64[us]")})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        due = expiredTimerInfo.getExpiryTimeInMs() - 1
        checked, attempted, misses = self.page.get()
        if misses + 1 >= self.forget:
            self.page.clear()
        else:
            self.page.update((checked, attempted, misses + 1))
            self.handle.registerTimer(due + self.ttl_ms + 1)
        yield pd.DataFrame({"key": [str(key[0])], "due_at": pd.to_datetime([due], unit="ms")})

    def close(self) -> None:
        pass


def due_stream(
    attempts: DataFrame, *, key: str = "url_key", at: str = "attempted_at", verified: str = "verified", ttl_hours: float = 6, retry_minutes: float = 30, late: str = "0 seconds", forget: int = 8
) -> DataFrame:
    """(key, due_at) when a page is due: over ``ttl_hours`` after its last good check and over ``retry_minutes`` after its last attempt.

    Event time is that of the attempts. A page that nobody fetches is called again after each time to live, ``forget`` times, then its
    state goes.
    """
    use_rocksdb(attempts.sparkSession)
    processor = _Due(at, verified, int(ttl_hours * 3_600_000), int(retry_minutes * 60_000), forget)
    return attempts.withWatermark(at, late).groupBy(key).transformWithStateInPandas(processor, "key string, due_at timestamp", "Append", "EventTime")


def state_rows(spark: SparkSession, checkpoint: str, name: str) -> int:
    """Rows of one state variable that a stopped query left in its checkpoint; for tests and watching."""
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load().count()
