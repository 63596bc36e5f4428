"""Keyed state in event time.

Results do not depend on the order in which rows arrive, as long as they are not later than the watermark; later rows are
dropped by Spark. State is kept in value and map states of the state store, and event-time timers end it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def use_state_store(spark: SparkSession) -> None:
    """Map states and timers need this state store."""
    if spark.conf.get(PROVIDER, None) != STORE:
        spark.conf.set(PROVIDER, STORE)


class DecayedWeight(StatefulProcessor):
    """Sum of exp(-rate * age) per key as a pair (weight, time) that merges in any order.

    Every batch reports the pair. A key that has been silent for ``keep_us`` of event time is reported as ended and forgotten.
    """

    def __init__(self, rate_per_second: float, keep_us: int):
        self.rate, self.keep_ms = rate_per_second, keep_us // 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pair = handle.getValueState("pair", "weight double, last_us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [part["ts_us"].to_numpy() for part in rows]
        weight, last = self.pair.get() if self.pair.exists() else (0.0, 0)
        newest = max(int(p.max()) for p in parts)
        newest = max(newest, last) if weight else newest
        weight *= math.exp(-self.rate * (newest - last) / 1e6)
        for p in parts:
            weight += float(sum(math.exp(-self.rate * (newest - int(t)) / 1e6) for t in p))
        self.pair.update((weight, newest))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(newest // 1000 + self.keep_ms)
        yield pd.DataFrame({"label": [key[0]], "weight": [weight], "last_us": [newest], "ended": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        weight, last = self.pair.get()
        self.pair.clear()
        yield pd.DataFrame({"label": [key[0]], "weight": [weight], "last_us": [last], "ended": [True]})


class OrderedCarry(StatefulProcessor):
    """h = alpha * z + (1 - alpha) * previous h, over the rows of a key in order of their snapshot.

    Rows wait in a list state until the watermark has passed the end of their snapshot, and are then released in order. A timer
    is set for the earliest of them only, so that the list is read once a batch and not once a row. What was carried is forgotten
    after ``keep_us`` without rows.
    """

    def __init__(self, alpha: float, span_us: int, keep_us: int):
        self.alpha, self.span_ms, self.keep_ms = alpha, span_us // 1000, keep_us // 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "snapshot_id bigint, vec array<double>")
        self.carried = handle.getValueState("carried", "h array<double>, snapshot_id bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            fresh = [(int(s), [float(x) for x in vec]) for s, vec in zip(part["snapshot_id"], part["vec"], strict=True)]
            self.waiting.appendList(fresh)
            self.handle.registerTimer((min(s for s, _ in fresh) + 1) * self.span_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() // self.span_ms  # snapshots below have ended
        waiting = {k: list(vec) for k, vec in self.waiting.get()} if self.waiting.exists() else {}  # the last row of a snapshot counts
        due = sorted((k, vec) for k, vec in waiting.items() if k < until)
        rest = [(k, vec) for k, vec in waiting.items() if k >= until]
        h, last = self.carried.get() if self.carried.exists() else (None, None)
        out = []
        for snapshot, vec in due:
            h = [self.alpha * z + (1 - self.alpha) * (p if h is not None else 0.0) for z, p in zip(vec, h if h is not None else vec, strict=True)]
            out.append((key[0], snapshot, h))
            last = snapshot
        if out:
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer((min(k for k, _ in rest) + 1) * self.span_ms)
            else:
                self.waiting.clear()
            self.carried.update((h, last))
            self.handle.registerTimer((last + 1) * self.span_ms + self.keep_ms)
        elif last is not None and expiredTimerInfo.getExpiryTimeInMs() >= (last + 1) * self.span_ms + self.keep_ms and not rest:
            self.carried.clear()
        if out:
            yield pd.DataFrame(out, columns=["name", "snapshot_id", "vec"])


class AnchoredWindows(StatefulProcessor):
    """Counts per window of ``length_us``, windows starting at the earliest event of the key.

    As long as an earlier event can still arrive, times wait in a list state, many to an entry, and all windows are reported anew, under the
    anchor that holds then, whenever it moves. Once the watermark has passed the anchor, windows are counted directly, and
    those that have ended are forgotten.
    """

    def __init__(self, length_us: int):
        self.length = length_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.anchor = handle.getValueState("anchor", "anchor_us bigint, fixed boolean")
        self.times = handle.getListState("times", "ts_us array<bigint>")
        self.counts = handle.getMapState("counts", "snapshot_id bigint", "n bigint")

    def _count(self, anchor: int, times: np.ndarray) -> dict[int, int]:
        found, n = np.unique((times - anchor) // self.length, return_counts=True)
        return dict(zip(found.tolist(), n.tolist(), strict=True))

    def _waiting(self) -> np.ndarray:
        return np.concatenate([np.asarray(t[0], dtype="int64") for t in self.times.get()])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [part["ts_us"].to_numpy(dtype="int64") for part in rows]
        fresh = np.concatenate(parts)
        first = int(fresh.min())
        anchor, fixed = self.anchor.get() if self.anchor.exists() else (first, False)
        if fixed:
            changed = self._count(anchor, fresh)
            for at, n in changed.items():
                if self.counts.containsKey((at,)):
                    changed[at] = n = n + self.counts.getValue((at,))[0]
                self.counts.updateValue((at,), (n,))
        else:
            self.times.appendList([(p.tolist(),) for p in parts])
            anchor = min(anchor, first)
            changed = self._count(anchor, self._waiting())
            self.anchor.update((anchor, False))
            self.handle.registerTimer(anchor // 1000 + 1)
        yield self._rows(key, anchor, changed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The watermark is past a former or the final anchor, or past the end of a window."""
        anchor, fixed = self.anchor.get()
        now = timerValues.getCurrentWatermarkInMs() * 1000
        if not fixed and now > anchor:
            for at, n in self._count(anchor, self._waiting()).items():
                self.counts.updateValue((at,), (n,))
            self.times.clear()
            self.anchor.update((anchor, True))
            fixed = True
        if fixed:
            for at in [k[0] for k in self.counts.keys()]:
                if anchor + (at + 1) * self.length <= now:
                    self.counts.removeKey((at,))
        yield from ()

    def _rows(self, key, anchor: int, changed: dict[int, int]) -> pd.DataFrame:
        n = len(changed)
        return pd.DataFrame({"name": [key[0]] * n, "anchor_us": [anchor] * n, "snapshot_id": list(changed), "n": list(changed.values())})


DECAY_SCHEMA = "label string, weight double, last_us bigint, ended boolean"
CARRY_SCHEMA = "name string, snapshot_id bigint, vec array<double>"
ANCHOR_SCHEMA = "name string, anchor_us bigint, snapshot_id bigint, n bigint"


def _timed(stream: DataFrame, time_us, delay: str) -> DataFrame:
    use_state_store(stream.sparkSession)
    return stream.withColumn("event_time", F.timestamp_micros(time_us)).withWatermark("event_time", delay)


def decayed_weights(stream: DataFrame, key: str, rate_per_second: float, delay: str, keep_us: int) -> DataFrame:
    """``label, weight, last_us, ended`` of every key in every batch that touches it; ``stream`` has ``ts_us``."""
    timed = _timed(stream, F.col("ts_us"), delay)
    return timed.groupBy(key).transformWithStateInPandas(DecayedWeight(rate_per_second, keep_us), DECAY_SCHEMA, "update", "eventTime")


def carried(stream: DataFrame, key: str, alpha: float, span_us: int, delay: str, keep_us: int) -> DataFrame:
    """``name, snapshot_id, vec``; ``stream`` has ``snapshot_id`` (numbers of spans) and ``vec``."""
    timed = _timed(stream, F.col("snapshot_id") * F.lit(span_us), delay)
    return timed.groupBy(key).transformWithStateInPandas(OrderedCarry(alpha, span_us, keep_us), CARRY_SCHEMA, "append", "eventTime")


def anchored_windows(stream: DataFrame, key: str, length_us: int, delay: str) -> DataFrame:
    """``name, anchor_us, snapshot_id, n``: windows as they change; those under the smallest anchor of a key count."""
    timed = _timed(stream, F.col("ts_us"), delay)
    return timed.groupBy(key).transformWithStateInPandas(AnchoredWindows(length_us), ANCHOR_SCHEMA, "update", "eventTime")
