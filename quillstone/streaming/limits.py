"""Expiring counters and rate limits with arbitrary state.

A counter begins with the first event of its key, counts the events up to so many
seconds after that one, and then begins anew.  Time is event time, so a replay gives
the same answers; a timer clears the counters of a group of keys once the watermark
passes their ends, so state holds live counters only.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

if TYPE_CHECKING:
    from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Seconds of a window, and of the life of its counter.
WINDOW, LIFE = 60, 90

#: Fixed value: groups that keys are dealt into; a group's counters are one state, so a call reads and writes all of them at once.
GROUPS = 1024

COUNTED = "key string, event_id long, ms long, n long"


class _Counters(StatefulProcessor):
    """The live counters of the keys of one group."""

    def __init__(self, life_ms: int) -> None:
        self.life_ms = life_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("counters", "keys array<string>, ends array<bigint>, n array<bigint>")

    def _live(self, watermark: int) -> dict[str | None, tuple[int, int]]:
        if not self.state.exists():
            return {}
        return {key: (ends, n) for key, ends, n in zip(*self.state.get(), strict=True) if ends > watermark}

    def _keep(self, held: dict[str | None, tuple[int, int]], timed: int | None) -> None:
        """The counters as the new state; timed is for when a timer is set already."""
        if not held:
            self.state.clear()
            return
        ends = [e for e, _ in held.values()]
        self.state.update((list(held), ends, [n for _, n in held.values()]))
        if min(ends) != timed:
            self.handle.registerTimer(min(ends))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat([f[["key", "ms", "event_id"]] for f in rows]).sort_values(["ms", "event_id"])
        held = self._live(timerValues.getCurrentWatermarkInMs())
        timed = min((ends for ends, _ in held.values()), default=None)
        keys, counts = [k if isinstance(k, str) else None for k in frame["key"]], []
        for one, ms in zip(keys, frame["ms"].tolist(), strict=True):
            ends, n = held.get(one, (ms, 0))
            held[one] = (ends, n + 1) if ends > ms else (ms + self.life_ms, 1)
            counts.append(held[one][1])
        self._keep(held, timed)
        yield pd.DataFrame({"key": pd.Series(keys, dtype=object), "event_id": frame["event_id"].to_numpy(), "ms": frame["ms"].to_numpy(), "n": counts})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._keep(self._live(expiredTimerInfo.getExpiryTimeInMs()), None)
        yield pd.DataFrame({"key": pd.Series([], dtype=str), "event_id": pd.Series([], dtype="int64"), "ms": pd.Series([], dtype="int64"), "n": pd.Series([], dtype="int64")})

    def close(self) -> None:
        pass


def counted(events: DataFrame, seconds: int, late: str = "1 hour", groups: int = GROUPS) -> DataFrame:
    """(key, event_id, ms, n) of a stream (key, event_id, ts): the place of every event in its counter of so many seconds.

    Events of one key and time stand by event_id; rows later than ``late`` are dropped.
    Keys are dealt into ``groups`` by their hash; a batch's rows of one group pass through
    Python together.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = events.select(F.col("key").cast("string").alias("key"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    dealt = timed.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int"))
    return dealt.groupBy("group").transformWithStateInPandas(_Counters(1000 * seconds), COUNTED, "append", "EventTime")


def limited(events: DataFrame, limit: int, window: int = WINDOW, life: int = LIFE, late: str = "1 hour") -> DataFrame:
    """(client, event_id, window, n, accepted) of a stream (client, event_id, ts): fixed windows of so many seconds take ``limit`` events of a client."""
    number = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / (1000 * window)).cast("long")
    keyed = events.select(F.concat_ws(":", F.col("client").cast("string"), number.cast("string")).alias("key"), "event_id", "ts")
    part = F.split("key", ":")
    return counted(keyed, life, late).select(part[0].cast("long").alias("client"), "event_id", part[1].cast("long").alias("window"), "n", (F.col("n") <= limit).alias("accepted"))


