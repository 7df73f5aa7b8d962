"""Anomaly flags on an event stream: each value against the earlier values of its key.

State of a key is the number, sum and sum of squares of its values, in whole cents, so memory does
not grow with its history. The score is ``min(1, |z| / 5)`` with z from the values before the row;
0 while these are fewer than ``MIN_SEEN`` or all equal. A row with a score above 0.8 is flagged.
"""

from __future__ import annotations

import math
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerlink.streaming.ordered import OrderedRule, apply_rule

cloudpickle.register_pickle_by_value(sys.modules[__name__])

c = F.col
MIN_SEEN = 10
FULL_SCORE_AT = 5.0
FLAG_ABOVE = 0.8


def score_of(cents: int, seen: int, total: int, squares: int) -> float:
    spread = seen * squares - total * total
    if seen < MIN_SEEN or spread <= 0:
        return 0.0
    z = float(abs(seen * cents - total)) / math.sqrt(float(spread))
    return math.floor(min(1.0, z / FULL_SCORE_AT) * 1e6 + 0.5) / 1e6


class AnomalyRule(OrderedRule):
    row = "at long, event_id long, cents long"
    output = "event_id bigint, event_type string, event_us bigint, cents bigint, seen bigint, score double, flagged boolean"

    def start(self) -> None:
        self.figures = self.handle.getValueState("figures", "seen long, total long, squares long")

    def answer(self, key: str, due: list[tuple]) -> list[tuple]:
        seen, total, squares = self.figures.get() if self.figures.exists() else (0, 0, 0)
        out = []
        for at, event_id, cents in due:
            score = score_of(cents, seen, total, squares)
            out.append((event_id, key, at, cents, seen, score, score > FLAG_ABOVE))
            seen, total, squares = seen + 1, total + cents, squares + cents * cents
        self.figures.update((seen, total, squares))
        return out


def _cents(value: Column) -> Column:
    return F.floor(value * 100.0 + 0.5).cast("long")


def event_anomalies_stream(events: DataFrame, delay: str) -> DataFrame:
    """Streaming form over (event_id, event_type, ts, value)."""
    rows = events.select("event_id", "event_type", "ts", _cents(c("value")).alias("cents"))
    return apply_rule(rows, "event_type", "ts", AnomalyRule(), delay)


def event_anomalies(events: DataFrame, block: Column) -> DataFrame:
    """Batch form. Sums run within a (key, block) and carry what earlier blocks sum to, so a hot key
    is dealt over its blocks; they are decimals, which do not round."""
    rows = events.select("event_id", "event_type", F.unix_micros(c("ts").cast("timestamp")).alias("event_us"), _cents(c("value")).alias("cents"), block.alias("_b"))
    rows = rows.withColumn("_v", c("cents").cast("decimal(19,0)")).withColumn("_q", c("_v") * c("_v"))
    ahead = W.partitionBy("event_type", "_b").orderBy("event_us", "event_id").rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0)
    inside = rows.select("*", F.count("*").over(ahead).alias("_n"), F.coalesce(F.sum("_v").over(ahead), none).alias("_s"), F.coalesce(F.sum("_q").over(ahead), none).alias("_ss"))
    blocks = rows.groupBy("event_type", "_b").agg(F.count("*").alias("n"), F.sum("_v").alias("s"), F.sum("_q").alias("ss"))
    earlier = W.partitionBy("event_type").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.select("event_type", "_b", *(F.coalesce(F.sum(x).over(earlier), none).alias(f"_{x}0") for x in ("n", "s", "ss")))
    joined = inside.join(carried, ["event_type", "_b"])
    wide = "decimal(18,0)"
    sums = joined.select("event_id", "event_type", "event_us", "cents", (c("_n") + c("_n0")).cast("long").alias("seen"),
                         (c("_s") + c("_s0")).cast(wide).alias("total"), (c("_ss") + c("_ss0")).cast(wide).alias("squares"))
    n, x = c("seen").cast(wide), c("cents").cast(wide)
    spread = n * c("squares") - c("total") * c("total")
    z = F.abs(n * x - c("total")).cast("double") / F.sqrt(spread.cast("double"))
    score = F.when((c("seen") < MIN_SEEN) | (spread <= 0), 0.0).otherwise(F.floor(F.least(F.lit(1.0), z / FULL_SCORE_AT) * 1e6 + 0.5).cast("double") / 1e6)
    return sums.withColumn("score", score).select("event_id", "event_type", "event_us", "cents", "seen", "score", (c("score") > FLAG_ABOVE).alias("flagged"))
