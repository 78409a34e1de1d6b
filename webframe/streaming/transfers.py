"""States of running transfers, from the messages they send."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webframe.operators.transfers import next_average

OPEN, CLOSED = ("start", "status", "length", "file", "progress"), ("finished", "failed", "stalled", "abandoned")
_OUT = (
    "transfer_id bigint, started bigint, ended bigint, phase string, total bigint, downloaded bigint, "
    "n bigint, avg_rate bigint, batch_order bigint"
)


@dataclass
class Attempt:
    """One attempt of a transfer; times are microseconds. ``second`` and ``pending`` are the tick that is not over yet."""

    started: int
    ended: int
    phase: str = "start"
    total: int = -1
    downloaded: int = 0
    n: int = 0
    avg_rate: int = 0
    second: int = 0
    pending: int = 0

    def take(self, ts: int, kind: str, size: int) -> None:
        self.ended, self.phase = ts, kind
        if kind == "length":
            self.total = size
        elif kind == "progress":
            if ts // 1_000_000 != self.second:
                self.tick()
                self.second = ts // 1_000_000
            self.pending += size
            self.downloaded += size

    def tick(self) -> None:
        if self.pending > 0:
            self.avg_rate, self.n = next_average(self.avg_rate, self.pending, self.n), self.n + 1
        self.pending = 0

    def row(self, transfer: int, order: int, phase: str | None = None) -> tuple:
        """What is known; a finished transfer has a total, and its bytes as rate if it took less than a tick."""
        seen = Attempt(**asdict(self))
        seen.tick()
        if self.phase == "finished":
            seen.total = seen.downloaded if seen.total == -1 else seen.total
            seen.avg_rate = seen.avg_rate or seen.downloaded
        return transfer, seen.started, seen.ended, phase or seen.phase, seen.total, seen.downloaded, seen.n, seen.avg_rate, order


@dataclass
class Follower:
    """The attempt of a transfer that is open, if any, and messages the watermark has not reached yet."""

    attempt: Attempt | None = None
    waiting: list[tuple[int, int, str, int]] = field(default_factory=list)

    @classmethod
    def read(cls, text: str) -> Follower:
        kept = json.loads(text)
        return cls(kept["attempt"] and Attempt(**kept["attempt"]), [tuple(w) for w in kept["waiting"]])

    def text(self) -> str:
        return json.dumps({"attempt": self.attempt and asdict(self.attempt), "waiting": self.waiting})

    def advance(self, transfer: int, new: list[tuple[int, int, str, int]], now: int, stall: int) -> list[tuple]:
        """Takes messages up to ``now`` in order of time; returns rows of closed attempts and of the open one."""
        self.waiting = sorted(set(self.waiting) | set(new))
        ready = [m for m in self.waiting if m[0] <= now]
        self.waiting = self.waiting[len(ready) :]
        out: list[tuple] = []
        for ts, _, kind, size in ready:
            if self.attempt and ts - self.attempt.ended > stall:
                out.append(self.close(transfer, len(out), "stalled"))
            if self.attempt and kind == "start":
                out.append(self.close(transfer, len(out), "abandoned"))
            self.attempt = self.attempt or Attempt(ts, ts)
            self.attempt.take(ts, kind, size)
            if kind in CLOSED:
                out.append(self.close(transfer, len(out), kind))
        if self.attempt and now - self.attempt.ended > stall:
            out.append(self.close(transfer, len(out), "stalled"))
        elif self.attempt and ready:
            out.append(self.attempt.row(transfer, len(out)))
        return out

    def close(self, transfer: int, order: int, phase: str) -> tuple:
        row = self.attempt.row(transfer, order, phase)
        self.attempt = None
        return row

    def next_time(self, stall: int) -> int:
        """Milliseconds that the watermark must be past for something to happen."""
        times = [(self.waiting[0][0] - 1) // 1000] if self.waiting else []
        return min([*times, (self.attempt.ended + stall) // 1000] if self.attempt else times)


def transfer_states(messages: DataFrame, delay: str = "1 hour", stall_seconds: int = 86_400) -> DataFrame:
    """State of each attempt of each transfer, at every change.

    ``messages(transfer_id, ts, event_id, kind, bytes)`` of a stream. A ``start`` begins an attempt, as does any
    message where none is open; ``length`` tells its total, ``progress`` brings bytes, ``finished`` and ``failed``
    close it. An attempt with nothing for ``stall_seconds`` is closed as ``stalled``, by the next message or when the
    watermark has passed that time; one met by another ``start`` as ``abandoned``. State of closed attempts is dropped.

    Messages are taken in order of ``(ts, event_id)`` once the watermark has reached them, however they are dealt to batches;
    those up to ``delay`` late are in time, repeated ones count once, later ones are dropped and counted by the run.
    ``avg_rate`` is the mean over seconds with bytes, cut to a whole number at each. Rows are ``(transfer_id, started, ended, phase, total,
    downloaded, n, avg_rate, seconds, batch_order)``; of one attempt the last of the last batch holds.
    """
    stall = stall_seconds * 1_000_000

    def follow(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        follower = Follower.read(state.get[0]) if state.exists else Follower()
        new = [m for b in batches for m in zip(b["_us"].tolist(), b["event_id"].tolist(), b["kind"].tolist(), b["bytes"].tolist())]
        now = state.getCurrentWatermarkMs()
        out = follower.advance(int(key[0]), new, now * 1000, stall)
        if follower.attempt or follower.waiting:
            state.update((follower.text(),))
            state.setTimeoutTimestamp(max(follower.next_time(stall), now + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    states = (
        messages.withColumn("_us", F.unix_micros("ts"))
        .withWatermark("ts", delay)
        .groupBy("transfer_id")
        .applyInPandasWithState(follow, _OUT, "state string", "update", GroupStateTimeout.EventTimeTimeout)
    )
    seconds = F.floor((F.col("ended") - F.col("started")) / 1_000_000).cast("bigint")
    return states.select(
        "transfer_id", F.timestamp_micros("started").alias("started"), F.timestamp_micros("ended").alias("ended"),
        "phase", "total", "downloaded", "n", "avg_rate", seconds.alias("seconds"), "batch_order",
    )


def last_states(updates: DataFrame) -> DataFrame:
    """The last state of each attempt of a run in update mode."""
    key, order = ["transfer_id", "started"], F.struct("batch_id", "batch_order")
    rest = [c for c in updates.columns if c not in (*key, "batch_id", "batch_order")]
    return updates.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*key, "_last.*")
