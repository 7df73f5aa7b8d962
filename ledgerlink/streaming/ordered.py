"""Keyed streams that answer rows in event-time order.

A key's new rows wait in list state until the watermark has passed them; one timer per key, set to
its first waiting row or to the end of its state, then answers all rows that are due. So rows out
of order by less than the watermark's delay give the answers of the same rows in order, however
they fall into micro-batches, and the engine drops later ones. A key keeps the rows of one delay
and the figures its rule needs; when the rule says so, these go by event time as well.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

c = F.col
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """State variables and timers need the RocksDB store; the setting counts when a stream starts."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class OrderedRule(StatefulProcessor):
    """A rule over one key's rows in order of (``at``, id).

    ``row`` is the schema of a waiting row; its first two fields are the event time in microseconds
    and the id. ``output`` is the schema of an answer.
    """

    row = "at long, id long"
    output = ""

    def start(self) -> None:
        """Make the rule's state variables."""

    def answer(self, key: Any, due: list[tuple]) -> list[tuple]:
        """Answers to rows in order, all later than those before; updates the state."""
        raise NotImplementedError

    def ends_at(self) -> int | None:
        """Event time from which the state says no more than an empty one; None to keep it."""
        return None

    def end(self, key: Any) -> list[tuple]:
        """Clear the state, with answers that wait for its end."""
        return []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.names = [f.split()[0] for f in self.row.split(", ")]
        self.start()

    def _wake(self, at: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if at is not None:
            self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = [r[0] for r in self.waiting.get()]
        for batch in rows:
            columns = [batch[n].tolist() for n in self.names]
            self.waiting.appendList(list(zip(*columns)))
            times.append(min(columns[0]))
        ends = self.ends_at()
        self._wake(min(times + ([ends] if ends is not None else [])))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(r) for r in self.waiting.get()]
        rest = [r for r in waiting if r[0] > passed]
        out = self.answer(key[0], sorted((r for r in waiting if r[0] <= passed), key=lambda r: r[:2])) if len(rest) < len(waiting) else []
        ends = self.ends_at()
        if ends is not None and ends <= passed:
            out += self.end(key[0])
            ends = None
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
        times = [r[0] for r in rest] + ([ends] if ends is not None else [])
        self._wake(min(times) if times else None)
        if out:
            yield pd.DataFrame(out, columns=[f.split()[0] for f in self.output.split(", ")])

    def close(self) -> None:
        pass


def apply_rule(rows: DataFrame, key: str, time: str, rule: OrderedRule, delay: str, where: Column | None = None) -> DataFrame:
    """``rule`` over a stream: ``rows`` has the key, a timestamp column ``time`` and the fields of
    the rule's rows but ``at``, which is made of the time. All rows move the watermark, those that
    ``where`` holds for are answered."""
    timed = rows.withColumn("_seen", c(time).cast("timestamp")).withWatermark("_seen", delay)
    # A condition that does not name the event time would be moved below the watermark.
    timed = timed if where is None else timed.filter(F.when(c("_seen").isNotNull(), where))
    fields = [f.split()[0] for f in rule.row.split(", ")][1:]
    shaped = timed.select(key, F.unix_micros("_seen").alias("at"), *fields, "_seen")
    return shaped.groupBy(key).transformWithStateInPandas(rule, rule.output, "Append", "EventTime")
