"""Per-thread state over event streams, kept in the state store and dropped when a thread falls quiet.

State lies in RocksDB beside the checkpoint, so it is not held in memory and is never read whole: a batch meets the
keys it has events for. With ``quiet`` a timer drops what has not been touched for that long in event time.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT_SCHEMA = "thread_id long, actor_id long, event_pos long"


class _Quiet(StatefulProcessor):
    """Keeps the moment (in milliseconds) up to which the state is needed, and a timer for it."""

    def __init__(self, quiet: timedelta | None, moment: str | None):
        self.quiet = quiet and int(quiet.total_seconds() * 1000)
        self.moment = moment

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        if self.quiet:
            self.needed = handle.getValueState("needed", "until long")

    def wake(self, key, parts: list[pd.DataFrame]) -> None:
        """Forget what had ended before these rows, and keep the rest for as long as they ask for."""
        if not self.quiet:
            return
        moments = pd.concat([part[self.moment] for part in parts])
        first, last = (int(m.value // 1_000_000) for m in (moments.min(), moments.max()))
        until = last + self.quiet
        known = self.needed.get() if self.needed.exists() else None
        if known is not None and first > known[0]:  # its timer has not fired yet
            self.forget(key)
        if known is None or until > known[0]:
            if known is not None:
                self.handle.deleteTimer(known[0])
            self.needed.update((until,))
            self.handle.registerTimer(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.forget(key)
        self.needed.clear()
        return iter(())

    def close(self) -> None:
        pass


class _KnownUsers(_Quiet):
    """Per user of a slice of a thread: the first position seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.first = handle.getMapState("first", "actor_id long", "event_pos long")

    def forget(self, key) -> None:
        self.first.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        self.wake(key, parts)
        every = pd.concat(parts)
        firsts = every.groupby("actor_id")["event_pos"].min().to_dict()
        for actor, position in firsts.items():
            known = self.first.getValue((int(actor),))
            if known is None or position < known[0]:
                self.first.updateValue((int(actor),), (int(position),))
            firsts[actor] = position if known is None else min(position, known[0])
        found = every[every["event"] == "cross-referenced"]
        found = found[found["event_pos"] > found["actor_id"].map(firsts)]
        yield found.assign(thread_id=key[0])[["thread_id", "actor_id", "event_pos"]].astype("int64")


class _LastEvent(_Quiet):
    """Per thread: its last event."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "event_pos long, event string")

    def forget(self, key) -> None:
        self.last.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        self.wake(key, parts)
        every = pd.concat(parts).sort_values("event_pos", kind="stable")
        known = self.last.get() if self.last.exists() else None
        before = np.concatenate([[known[1] if known else None], every["event"].to_numpy()[:-1]])
        hits = every[(every["event"] == "closed").to_numpy() & (before == "merged")]
        self.last.update((int(every["event_pos"].iloc[-1]), every["event"].iloc[-1]))
        yield hits.assign(thread_id=key[0])[["thread_id", "actor_id", "event_pos"]].astype("int64")


def _kept(stream: DataFrame, keys: list[str], processor: type, quiet: timedelta | None, moment: str | None, late: str) -> DataFrame:
    if quiet:
        stream = stream.withWatermark(moment, late)
    return stream.groupBy(*keys).transformWithStateInPandas(
        processor(quiet, moment), EVENT_SCHEMA, "append", "EventTime" if quiet else "None"
    )


def known_users(
    stream: DataFrame, quiet: timedelta | None = None, moment: str | None = None, late: str = "0 seconds", slices: int = 16
) -> DataFrame:
    """References by users who had an earlier event in the thread.

    ``stream(thread_id, actor_id, event_pos, event)``. Positions grow from batch to batch
    and may come in any order inside one. A thread is dealt by user to ``slices`` keys, so a busy thread has many
    tasks; a key's state is a map of its users. With ``quiet`` users of a slice are forgotten once it had no event for that
    long, by the column ``moment``, and events that are ``late`` are dropped.
    """
    dealt = stream.withColumn("slice", F.pmod(F.xxhash64("actor_id"), F.lit(slices)))
    return _kept(dealt, ["thread_id", "slice"], _KnownUsers, quiet, moment, late)


def closes_after_merge(
    stream: DataFrame, quiet: timedelta | None = None, moment: str | None = None, late: str = "0 seconds"
) -> DataFrame:
    """``closed`` events whose thread's last event before them is ``merged``.

    ``stream(thread_id, actor_id, event_pos, event)``, positions growing from batch to batch, in any order inside one. A
    thread's state is its last event; ``quiet``, ``moment`` and ``late`` are as in :func:`known_users`. A task holds the rows
    that one batch has of a thread, so the files of a batch bound it.
    """
    return _kept(stream, ["thread_id"], _LastEvent, quiet, moment, late)
