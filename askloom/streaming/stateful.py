"""Keyed state over request and question streams: rate limits, quotas, caches that expire.

State lives in a RocksDB store as lists, maps and single values, and a batch writes only what it
changes. Event-time timers drop what has expired, so an idle key leaves nothing behind once the
watermark has passed. Each micro-batch of a key is read frame by frame into two or three number
columns and put in time order; the source's ``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` bounds a
micro-batch. Rows behind the watermark never reach an operator: deal them off first with
``windows.deal``, which stores them in a side table, and read ``windows.in_time``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from askloom import constants as K

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SECOND = 1_000_000


def _in_order(frames: Iterator[pd.DataFrame], columns: list[str], by: list[str]) -> dict[str, np.ndarray]:
    """The named columns of a key's rows of one micro-batch, sorted by ``by``; frames are let go one by one."""
    parts = {c: [] for c in columns}
    for frame in frames:
        for c in columns:
            parts[c].append(frame[c].to_numpy())
    held = {c: np.concatenate(p) for c, p in parts.items()}
    order = np.lexsort([held[c] for c in reversed(by)])
    return {c: v[order] for c, v in held.items()}


def _keyed(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, delay: str) -> DataFrame:
    """``processor`` over (keys, us, …) in event time; the output's ``us`` becomes ``ts``."""
    timed = rows.withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))
    out = timed.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "eventTime")
    return out.withColumn("ts", F.timestamp_micros("us")).drop("us")


class _Timed(StatefulProcessor):
    """What the processors share: the handle, and a timer that is always ahead of the watermark."""

    def init(self, handle):
        self.handle = handle

    def wake(self, timer_values, us: int) -> None:
        """A timer once the watermark has passed ``us``."""
        self.handle.registerTimer(max(-(-us // 1000), timer_values.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.expire(key, expiredTimerInfo.getExpiryTimeInMs() * 1000, timerValues)
        return iter([])

    def expire(self, key, us: int, timer_values) -> None:
        raise NotImplementedError

    def close(self):
        pass


class _RateLimit(_Timed):
    def __init__(self, limit: int, window_us: int):
        self.limit, self.window_us = limit, window_us

    def init(self, handle):
        super().init(handle)
        self.times = handle.getListState("times", "us bigint")

    def handleInputRows(self, key, rows, timerValues):
        held = _in_order(rows, ["us", "request_id"], ["us", "request_id"])
        times = deque(sorted(t for (t,) in self.times.get()) if self.times.exists() else ())
        accepted, retry, new = [], [], []
        for now in held["us"].tolist():
            while times and now - times[0] >= self.window_us:
                times.popleft()
            if len(times) >= self.limit:
                accepted.append(False)
                retry.append((self.window_us - (now - times[0])) // SECOND)
            else:
                times.append(now)
                new.append((now,))
                accepted.append(True)
                retry.append(None)
        if new:
            self.times.appendList(new)  # what is older stays until a timer drops it
            self.wake(timerValues, new[-1][0] + self.window_us)
        yield pd.DataFrame(
            {"client": key[0], "request_id": held["request_id"], "us": held["us"], "accepted": accepted, "retry_after": pd.array(retry, dtype="Int64")}
        )

    def expire(self, key, us, timer_values):
        left = [(t,) for (t,) in self.times.get() if t > us - self.window_us]
        if left:
            self.times.put(left)
        else:
            self.times.clear()


def rate_limit(requests: DataFrame, limit: int = K.RATE_LIMIT, window_s: int = K.RATE_WINDOW_S, delay: str = "10 minutes") -> DataFrame:
    """(client, request_id, ts, accepted, retry_after) under a sliding log of accepted requests.

    Input (client, request_id, ts timestamp). Rejected requests do not count; an accepted one counts
    while now - then < window. A client's state is a list of accepted times, appended to by each
    batch and cut by a timer once the watermark has left them behind.
    """
    kind, rid = (requests.schema[c].dataType.simpleString() for c in ("client", "request_id"))
    return _keyed(
        requests, ["client"], _RateLimit(limit, window_s * SECOND),
        f"client {kind}, request_id {rid}, us bigint, accepted boolean, retry_after bigint", delay,
    )


QUOTA_SLOTS = 128  # keys that a day's users share


class _Quota(_Timed):
    def __init__(self, limit: int, kind: str):
        self.limit, self.kind = limit, kind

    def init(self, handle):
        super().init(handle)
        self.used = handle.getListState("used", f"user_id {self.kind}, n bigint")

    def handleInputRows(self, key, rows, timerValues):
        held = _in_order(rows, ["user_id", "us", "request_id"], ["us", "request_id"])
        old = list(self.used.get()) if self.used.exists() else []
        before = pd.Series([u for u, _ in old], dtype=held["user_id"].dtype)
        code, names = pd.factorize(pd.concat([before, pd.Series(held["user_id"])]))
        used = np.zeros(len(names), dtype=np.int64)
        used[code[: len(old)]] = [n for _, n in old]
        code = code[len(old):]
        by_user = np.argsort(code, kind="stable")  # rows of one user stay in time order
        count = np.bincount(code, minlength=len(names))
        number = np.empty(len(code), dtype=np.int64)
        number[by_user] = np.arange(len(code)) - np.repeat(np.cumsum(count) - count, count) + 1
        number += used[code]
        now = np.minimum(self.limit, used + count)
        if (now != used).any() or len(names) > len(old):
            self.used.put(list(zip(names.tolist(), now.tolist(), strict=True)))
        self.wake(timerValues, pd.Timestamp(key[0]).value // 1000 + 86_400 * SECOND)
        users = held["user_id"] if key[1] >= 0 else None
        yield pd.DataFrame({"user_id": users, "request_id": held["request_id"], "us": held["us"], "accepted": number <= self.limit})

    def expire(self, key, us, timer_values):
        self.used.clear()


def daily_quota(requests: DataFrame, limit: int, delay: str = "1 day") -> DataFrame:
    """(user_id, request_id, ts, accepted): the first ``limit`` requests of each user's day pass.

    The key is (day, slot of the user), so that a task meets a few thousand keys however many users there
    are, and decides all of a key's rows at once. A day's counters are lists of their own and are dropped when the
    watermark leaves the day; one busy user spreads over days. Users that are null count as one.
    """
    kind, rid = (requests.schema[c].dataType.simpleString() for c in ("user_id", "request_id"))
    slot = F.when(F.col("user_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(QUOTA_SLOTS)).cast("int"))
    known = F.coalesce("user_id", F.lit("0").cast(kind))  # a null would turn its batch's numbers into floats; it has a slot of its own
    rows = requests.withColumns({"day": F.to_date("ts"), "slot": slot, "user_id": known})
    return _keyed(rows, ["day", "slot"], _Quota(limit, kind), f"user_id {kind}, request_id {rid}, us bigint, accepted boolean", delay)


class _SemanticCache(_Timed):
    def __init__(self, threshold: float, cap: int | None, ttl_us: int | None):
        self.threshold, self.cap, self.ttl_us = threshold, cap, ttl_us

    def init(self, handle):
        super().init(handle)
        self.entries = handle.getMapState("entries", "id bigint", "us bigint, number bigint, unit array<double>")

    def _stored(self):
        rows = [(n, i, t, u) for (i,), (t, n, u) in self.entries.iterator()] if self.entries.exists() else []
        return sorted(rows, key=lambda r: r[:2])

    def handleInputRows(self, key, rows, timerValues):
        held = _in_order(rows, ["us", "question_id", "embedding"], ["us", "question_id"])
        old = self._stored()
        ids = [r[1] for r in old]
        at = np.array([r[2] for r in old], dtype=np.int64)
        mat = np.array([r[3] for r in old], dtype=np.float64).reshape(len(old), len(held["embedding"][0]))
        next_number = old[-1][0] + 1 if old else 0
        fresh, hit, sim = {}, [], []
        for qid, now, vec in zip(held["question_id"].tolist(), held["us"].tolist(), held["embedding"], strict=True):
            n = len(ids)  # rows of ``at`` and ``mat`` beyond are spare
            if self.ttl_us is not None and n:
                live = now < at[:n] + self.ttl_us
                if not live.all():
                    self._forget([i for i, keep in zip(ids, live.tolist(), strict=True) if not keep], fresh)
                    ids, at, mat = [i for i, keep in zip(ids, live.tolist(), strict=True) if keep], at[:n][live], mat[:n][live]
                    n = len(ids)
            v = np.asarray(vec, dtype=np.float64)
            length = np.sqrt((v * v).sum())
            unit = v / length if length > 0 else v
            s = np.round(mat[:n] @ unit, 6) if n else np.empty(0)
            if n and s.max() >= self.threshold:
                i = int(np.argmax(s))
                hit.append(ids[i])
                sim.append(float(s[i]))
                continue
            hit.append(None)
            sim.append(None)
            if self.cap is not None and n >= self.cap:
                self._forget(ids[:1], fresh)
                ids, at, mat = ids[1:], at[1:], mat[1:]
                n -= 1
            fresh[qid] = (now, next_number, unit.tolist())
            next_number += 1
            if n == len(at):
                at = np.concatenate([at, np.empty(n + 16, dtype=np.int64)])
                mat = np.concatenate([mat, np.empty((n + 16, len(unit)))])
            ids.append(qid)
            at[n], mat[n] = now, unit
        for qid, entry in fresh.items():
            self.entries.updateValue((qid,), entry)
        if fresh and self.ttl_us is not None:
            self.wake(timerValues, max(e[0] for e in fresh.values()) + self.ttl_us)
        yield pd.DataFrame(
            {
                "tenant": key[0], "question_id": held["question_id"], "us": held["us"], "hit_id": pd.array(hit, dtype="Int64"),
                "similarity": pd.array(sim, dtype="Float64").to_numpy(dtype=float, na_value=np.nan),
            }
        )

    def _forget(self, ids, fresh):
        for i in ids:
            if fresh.pop(i, None) is None:
                self.entries.removeKey((i,))

    def expire(self, key, us, timer_values):
        for _, i, t, _ in self._stored():
            if t + self.ttl_us <= us:
                self.entries.removeKey((i,))


def semantic_cache(
    questions: DataFrame, threshold: float = K.SEMANTIC_CACHE_THRESHOLD, cap: int | None = K.SEMANTIC_CACHE_SIZE,
    ttl_s: int | None = K.TTL_EMBEDDING_S, delay: str = "10 minutes",
) -> DataFrame:
    """(tenant, question_id, ts, hit_id, similarity): look up, and store what was not found.

    Input (tenant, question_id, ts, embedding). The best live entry at or above the threshold
    answers, the oldest on ties; a miss is stored and evicts the oldest entry at the cap. A tenant's
    entries are a map bounded by the cap; each expires by its own age, and a batch writes only the
    entries it adds or takes out. Without a cap nothing is evicted, and without a time to live
    nothing expires.
    """
    kind = questions.schema["tenant"].dataType.simpleString()
    out = _keyed(
        questions, ["tenant"], _SemanticCache(threshold, cap, None if ttl_s is None else ttl_s * SECOND),
        f"tenant {kind}, question_id bigint, us bigint, hit_id bigint, similarity double", delay,
    )
    return out.withColumn("similarity", F.nanvl("similarity", F.lit(None).cast("double")))


class _ExpiringValue(_Timed):
    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle):
        super().init(handle)
        self.value = handle.getValueState("value", "us bigint, value string")

    def handleInputRows(self, key, rows, timerValues):
        held = _in_order(rows, ["us", "command_id", "is_set", "value"], ["us", "command_id"])
        at, value = self.value.get() if self.value.exists() else (None, None)
        stored, out = at, []
        for now, is_set, new in zip(held["us"].tolist(), held["is_set"].tolist(), held["value"].tolist(), strict=True):
            if is_set:
                at, value = now, new
                out.append(None)
            else:
                out.append(value if at is not None and now < at + self.ttl_us else None)
        if at != stored:
            self.value.update((at, value))
            self.wake(timerValues, at + self.ttl_us)
        asked = ~held["is_set"].astype(bool)
        found = pd.array(np.array(out, dtype=object)[asked], dtype="string")
        yield pd.DataFrame({"key": key[0], "command_id": held["command_id"][asked], "us": held["us"][asked], "value": found})

    def expire(self, key, us, timer_values):
        if self.value.exists() and self.value.get()[0] + self.ttl_us <= us:
            self.value.clear()


def expiring_cache(commands: DataFrame, ttl_s: int, delay: str = "10 minutes") -> DataFrame:
    """(key, command_id, ts, value) of every look-up: the last value set under the key, while it is younger than the TTL.

    Input (key, command_id, is_set, value, ts). Commands take effect in event time, ties by id; a
    value read is null when none was set or it has expired. A key's value is dropped by a timer.
    """
    kind, cid = (commands.schema[c].dataType.simpleString() for c in ("key", "command_id"))
    return _keyed(commands, ["key"], _ExpiringValue(ttl_s * SECOND), f"key {kind}, command_id {cid}, us bigint, value string", delay)


class _LastSeen(StatefulProcessor):
    def __init__(self, ttl_s: int):
        self.ttl_ms = ttl_s * 1000

    def init(self, handle):
        self.seen = handle.getMapState("seen", "item string", "n bigint", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            out = []
            for item in frame["item"]:
                n = (self.seen.getValue((item,))[0] if self.seen.containsKey((item,)) else 0) + 1
                self.seen.updateValue((item,), (n,))
                out.append(n)
            yield pd.DataFrame({"key": key[0], "item": frame["item"], "seen": out})

    def close(self):
        pass


def recently_seen(rows: DataFrame, ttl_s: int) -> DataFrame:
    """(key, item, seen): how often an item has come under its key, counted anew after ``ttl_s`` without it.

    Input (key, item). The clock is the machine's: the store itself drops entries whose time to live
    is over, key by key and item by item.
    """
    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").transformWithStateInPandas(_LastSeen(ttl_s), f"key {kind}, item string, seen bigint", "append", "processingTime")
