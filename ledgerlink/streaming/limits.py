"""Sliding-window rate limits, failure counters, lockouts, device lists and activity spans, as keyed
streams, and rate limits as a batch.

A rejected request leaves no trace, so whether one is accepted depends on what was accepted
before: the exact answer needs state, not a count over a window. In the batch, keys are split at
quiet gaps of at least the window, where the state is empty by definition; each piece is then
independent and passes through one task in time order, with at most ``limit`` accepted times in
memory. A key without such gaps is one piece: bounded in memory, not in time.
"""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlink.operators.security import previous_time, running_since_reset
from ledgerlink.streaming.ordered import OrderedRule, apply_rule

cloudpickle.register_pickle_by_value(sys.modules[__name__])

c = F.col
LIMIT_COLUMNS = "event_id bigint, user_id bigint, at bigint, allowed boolean, remaining int, reset_at bigint, retry_after bigint"


def admit(accepted: deque, at: int, limit: int, window: int) -> tuple[bool, int]:
    """Decide one request at ``at`` (microseconds) and update the accepted times."""
    while accepted and accepted[0] <= at - window:
        accepted.popleft()
    seen = len(accepted)
    same = bool(accepted) and accepted[-1] == at
    if seen >= limit:
        if same:
            accepted.pop()
        return False, 0
    if not same:
        accepted.append(at)
    return True, max(0, limit - len(accepted))


def _answers(rows: pd.DataFrame, states: dict, limit: int, window: int) -> pd.DataFrame:
    allowed, remaining = [], []
    for key, at in zip(rows["piece"], rows["at"]):
        ok, left = admit(states.setdefault(key, deque()), at, limit, window)
        allowed.append(ok)
        remaining.append(left)
    out = rows[["event_id", "user_id", "at"]].copy()
    out["allowed"], out["remaining"] = allowed, remaining
    out["reset_at"] = out["at"] + window
    out["retry_after"] = [None if ok else window // 1000000 for ok in allowed]
    out["retry_after"] = out["retry_after"].astype("Int64")
    return out


def rate_limit(events: DataFrame, limit: int, window_seconds: int, day: Column) -> DataFrame:
    """Batch form over (event_id, user_id, ts): allowed, remaining, reset and retry times."""
    window = window_seconds * 1000000
    seen = previous_time(events, "user_id", "ts", "event_id", day, "previous")
    at, prev = F.unix_micros(c("ts").cast("timestamp")), F.unix_micros(c("previous").cast("timestamp"))
    opens = prev.isNull() | (at - prev >= window)
    pieces = running_since_reset(seen, "user_id", ["ts", "event_id"], day, F.lit(False), opens.cast("bigint"), "piece_no")
    rows = pieces.select("event_id", "user_id", at.alias("at"), F.xxhash64("user_id", "piece_no").alias("piece"))
    ordered = rows.repartition("piece").sortWithinPartitions("piece", "at", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}
        for batch in batches:
            if len(batch):
                yield _answers(batch, states, limit, window)
                last = batch["piece"].iloc[-1]
                states = {last: states[last]}

    return ordered.mapInPandas(run, LIMIT_COLUMNS)


class RateRule(OrderedRule):
    """Accepted times inside the window; they go after a quiet window."""

    row = "at long, event_id long"
    output = LIMIT_COLUMNS

    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window

    def start(self) -> None:
        self.accepted = self.handle.getListState("accepted", "at long")

    def answer(self, key: int, due: list[tuple]) -> list[tuple]:
        accepted, out = deque(r[0] for r in self.accepted.get()), []
        for at, event_id in due:
            ok, left = admit(accepted, at, self.limit, self.window)
            out.append((event_id, key, at, ok, left, at + self.window, None if ok else self.window // 1000000))
        self.accepted.put([(t,) for t in accepted])
        return out

    def ends_at(self) -> int | None:
        times = [r[0] for r in self.accepted.get()]
        return times[-1] + self.window if times else None

    def end(self, key: int) -> list[tuple]:
        self.accepted.clear()
        return []


class FailureRule(OrderedRule):
    """Failures without a quiet period between them, and the delay each brings."""

    row = "at long, attempt_id long"
    output = "attempt_id bigint, user_id bigint, failures bigint, delay_seconds double"

    def __init__(self, quiet: int):
        self.quiet = quiet

    def start(self) -> None:
        self.counter = self.handle.getValueState("counter", "n long, last long")

    def answer(self, key: int, due: list[tuple]) -> list[tuple]:
        count, last = self.counter.get() if self.counter.exists() else (0, None)
        out = []
        for at, attempt_id in due:
            count = count + 1 if last is not None and at - last < self.quiet else 1
            last = at
            out.append((attempt_id, key, count, min(30.0, 0.5 * 2.0 ** min(count - 1, 60))))
        self.counter.update((count, last))
        return out

    def ends_at(self) -> int | None:
        return self.counter.get()[1] + self.quiet if self.counter.exists() else None

    def end(self, key: int) -> list[tuple]:
        self.counter.clear()
        return []


class LockoutRule(OrderedRule):
    """Failures since the last success and the minutes of lockout they bring."""

    row = "at long, attempt_id long, success boolean"
    output = "attempt_id bigint, user_id bigint, failures bigint, lock_minutes double"

    def __init__(self, limit: int = 5, base: int = 30, cap: int = 1440):
        self.limit, self.base, self.cap = limit, base, cap

    def start(self) -> None:
        self.failures = self.handle.getValueState("failures", "n long")

    def answer(self, key: int, due: list[tuple]) -> list[tuple]:
        count = self.failures.get()[0] if self.failures.exists() else 0
        out = []
        for _, attempt_id, success in due:
            count = 0 if success else count + 1
            over = count - self.limit
            out.append((attempt_id, key, count, float(min(self.cap, self.base * 2 ** min(over, 40))) if over >= 0 and not success else None))
        if count:
            self.failures.update((count,))
        else:
            self.failures.clear()
        return out


class DeviceRule(OrderedRule):
    """The last attempts of a device, forgotten after a day without any. Each change gives the list
    anew, under the time of its newest attempt."""

    row = "at long, attempt_id long, success boolean"
    output = "ip_address string, version bigint, attempt_id bigint, at bigint, success boolean"

    def __init__(self, keep: int = 10, forget: int = 86400000000):
        self.keep, self.forget = keep, forget

    def start(self) -> None:
        self.attempts = self.handle.getListState("attempts", "at long, attempt_id long, success boolean")

    def answer(self, key: str, due: list[tuple]) -> list[tuple]:
        kept = [tuple(r) for r in self.attempts.get()]
        for row in due:
            kept = ([] if kept and row[0] - kept[-1][0] >= self.forget else kept[1 - self.keep:] if len(kept) >= self.keep else kept) + [row]
        self.attempts.put(kept)
        return [(key, kept[-1][0], attempt_id, at, success) for at, attempt_id, success in kept]

    def ends_at(self) -> int | None:
        times = [r[0] for r in self.attempts.get()]
        return times[-1] + self.forget if times else None

    def end(self, key: str) -> list[tuple]:
        self.attempts.clear()
        return []


class SessionRule(OrderedRule):
    """Activity until a quiet gap; a span is given out when it has ended."""

    row = "at long, event_id long"
    output = "user_id bigint, started bigint, expires bigint, events bigint"

    def __init__(self, gap: int):
        self.gap = gap

    def start(self) -> None:
        self.span = self.handle.getValueState("span", "first long, last long, n long")

    def answer(self, key: int, due: list[tuple]) -> list[tuple]:
        first, last, n = self.span.get() if self.span.exists() else (None, None, 0)
        out = []
        for at, _ in due:
            if last is not None and at - last > self.gap:
                out.append((key, first, last + self.gap, n))
                last, n = None, 0
            first, last, n = (at if last is None else first), at, n + 1
        self.span.update((first, last, n))
        return out

    def ends_at(self) -> int | None:
        return self.span.get()[1] + self.gap + 1 if self.span.exists() else None

    def end(self, key: int) -> list[tuple]:
        first, last, n = self.span.get()
        self.span.clear()
        return [(key, first, last + self.gap, n)]


def rate_limit_stream(events: DataFrame, limit: int, window_seconds: int, delay: str) -> DataFrame:
    """Streaming form over (event_id, user_id, ts)."""
    return apply_rule(events, "user_id", "ts", RateRule(limit, window_seconds * 1000000), delay)


def failure_counter_stream(attempts: DataFrame, quiet_seconds: int, delay: str) -> DataFrame:
    """Streaming failure counter per user over (attempt_id, user_id, attempted_at, success); a quiet
    period of ``quiet_seconds`` resets it."""
    return apply_rule(attempts, "user_id", "attempted_at", FailureRule(quiet_seconds * 1000000), delay, ~c("success"))


def lockout_stream(attempts: DataFrame, delay: str) -> DataFrame:
    """Streaming lockouts per user over (attempt_id, user_id, attempted_at, success)."""
    return apply_rule(attempts, "user_id", "attempted_at", LockoutRule(), delay)


def device_stream(attempts: DataFrame, delay: str) -> DataFrame:
    """Streaming device lists over (attempt_id, ip_address, attempted_at, success)."""
    return apply_rule(attempts, "ip_address", "attempted_at", DeviceRule(), delay)


def session_stream(events: DataFrame, gap_seconds: int, delay: str) -> DataFrame:
    """Streaming activity spans per user over (event_id, user_id, ts)."""
    return apply_rule(events, "user_id", "ts", SessionRule(gap_seconds * 1000000), delay)
