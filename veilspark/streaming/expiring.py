"""Streaming jobs whose state ends: typed state per key with event-time timers, so that what is kept follows the live keys.

Each processor folds the rows of a key in the order of time and lets a limit act at its own time: when a later row comes, or when the
watermark has passed it.  So the result doesn't depend on how the stream is cut into batches.  State lives in the store on disk that
:func:`on_disk_state` names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilspark import fixed_values as fx

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def on_disk_state(spark: SparkSession) -> None:
    """Typed state with timers needs the store on disk; call before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _us(t) -> int:
    return int(pd.Timestamp(t).value // 1000)


class _Folding(StatefulProcessor):
    """Rows in order, one timer per key for the nearest limit."""

    order: tuple[str, ...] = ("ts",)
    out: tuple[str, ...] = ()

    def open(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open(handle)
        self.handle = handle

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(list(self.order), kind="stable")
        self.begin(key)
        found: list[tuple] = []
        for row in batch.to_dict("records"):
            found += self.step(key, row)
        self.settle(key, timerValues)
        if found:
            yield pd.DataFrame(found, columns=list(self.out))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.begin(key)
        found = self.expire(key, timerValues.getCurrentWatermarkInMs() * 1000)
        self.settle(key, timerValues)
        if found:
            yield pd.DataFrame(found, columns=list(self.out))

    def settle(self, key, timerValues) -> None:
        """Writes the state and sets the timer anew."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at if isinstance(at, int) else at[0])
        limit = self.save()
        if limit is not None:
            self.handle.registerTimer(max(limit // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))

    def close(self) -> None:
        pass


class SessionEnd(_Folding):
    """Ends a session that idles beyond ``ttl``, or, if pinned, beyond the hard limit from the pin."""

    out = ("session", "last_touch")

    def __init__(self, ttl: int, hard: int):
        self.ttl, self.hard = ttl * 1_000_000, hard * 1_000_000

    def open(self, handle):
        self.value = handle.getValueState("session", "touch bigint, pin bigint")

    def begin(self, key):
        self.touch, self.pin = self.value.get() if self.value.exists() else (None, None)

    def limit(self) -> int:
        return max(self.touch + self.ttl, self.pin + self.hard if self.pin is not None else 0)

    def expire(self, key, now) -> list[tuple]:
        if self.touch is None or self.limit() > now:
            return []
        ended = [(key[0], self.touch / 1e6)]
        self.touch = self.pin = None
        return ended

    def step(self, key, row) -> list[tuple]:
        t = _us(row["ts"])
        ended = self.expire(key, t)
        if row["kind"] == "unpin":
            self.pin = None
        else:
            self.touch = t if self.touch is None else max(t, self.touch)
            if row["kind"] == "pin":
                self.pin = t
        return ended

    def save(self):
        if self.touch is None:
            self.value.clear()
            return None
        self.value.update((self.touch, self.pin))
        return self.limit()


class LatestRequest(_Folding):
    """Pairs a reply with the latest request of its client within the limit; a request is forgotten after it."""

    order = ("ts", "is_reply", "id")
    out = ("client", "resp_id", "req_id")

    def __init__(self, limit: int):
        self.keep = limit * 1_000_000

    def open(self, handle):
        self.value = handle.getValueState("request", "id bigint, at bigint")

    def begin(self, key):
        self.id, self.at = self.value.get() if self.value.exists() else (None, None)

    def expire(self, key, now) -> list[tuple]:
        if self.at is not None and now - self.at >= self.keep:
            self.id = self.at = None
        return []

    def step(self, key, row) -> list[tuple]:
        t = _us(row["ts"])
        if not row["is_reply"]:
            self.id, self.at = int(row["id"]), t
            return []
        fresh = self.at is not None and t - self.at < self.keep
        return [(key[0], int(row["id"]), self.id if fresh else -1)]

    def save(self):
        if self.at is None:
            self.value.clear()
            return None
        self.value.update((self.id, self.at))
        return self.at + self.keep


class WaitingUses(_Folding):
    """Settles staged uses at the next reply of the client; a path waits no longer than the limit from its first use."""

    order = ("ts", "is_reply")
    out = ("client", "reply_ts", "path", "entry")

    def __init__(self, limit: int):
        self.keep = limit * 1_000_000

    def open(self, handle):
        self.map = handle.getMapState("waiting", "path string", "at bigint, entries array<string>")

    def begin(self, key):
        self.waiting = {k[0]: [v[0], list(v[1])] for k, v in self.map.iterator()} if self.map.exists() else {}
        self.before = set(self.waiting)

    def expire(self, key, now) -> list[tuple]:
        self.waiting = {p: w for p, w in self.waiting.items() if now - w[0] <= self.keep}
        return []

    def step(self, key, row) -> list[tuple]:
        t = _us(row["ts"])
        if not row["is_reply"]:
            entries = self.waiting.setdefault(row["path"], [t, []])[1]
            if row["entry"] not in entries:
                entries.append(row["entry"])
            return []
        done = [(key[0], t, p, e) for p, (at, entries) in self.waiting.items() if t - at <= self.keep for e in entries]
        self.waiting = {}
        return done

    def save(self):
        for path in self.before - set(self.waiting):
            self.map.removeKey((path,))
        for path, (at, entries) in self.waiting.items():
            self.map.updateValue((path,), (at, entries))
        return min((at for at, _ in self.waiting.values()), default=None) and min(at for at, _ in self.waiting.values()) + self.keep


def _run(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    on_disk_state(rows.sparkSession)
    return rows.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def session_ends(activity: DataFrame, ttl: int = fx.SESSION_IDLE_SECONDS, hard: int = fx.PIN_HARD_LIMIT_SECONDS) -> DataFrame:
    """``session, last_touch`` of each session that ended: idle beyond ``ttl`` and not pinned, or pinned beyond ``hard``.

    ``activity``: ``session, ts, kind`` with kind ``touch``, ``pin`` or ``unpin``, and a watermark on ``ts``.  Activity after an end begins
    a session anew; ``unpin`` of an unknown session does nothing.
    """
    return _run(activity, ["session"], SessionEnd(ttl, hard), "session string, last_touch double")


def latest_requests(marks: DataFrame, limit: int = fx.REQUEST_CONTEXT_SECONDS) -> DataFrame:
    """``client, resp_id, req_id``: each reply with the latest request of its client, -1 without one within ``limit`` seconds.

    ``marks``: ``client, ts, is_reply, id`` with a watermark on ``ts``.
    """
    return _run(marks, ["client"], LatestRequest(limit), "client string, resp_id bigint, req_id bigint")


def settled_uses(marks: DataFrame, limit: int = fx.REQUEST_CONTEXT_SECONDS) -> DataFrame:
    """``client, reply_ts, path, entry``: uses settled by a reply; ``marks``: ``client, ts, is_reply, path, entry`` with a watermark on ``ts``."""
    return _run(marks, ["client"], WaitingUses(limit), "client string, reply_ts bigint, path string, entry string")
