"""Incremental upsert from external systems since a stored cursor.

A synced table is a folder of the shared file system with three Parquet tables, all by run:
``changes`` (the rows a run found new or newer), ``commits`` (its cursor and counts per source) and
``snapshots`` (the whole table as of a run). A run writes its changes first and its commit, one
file, last. Readers and the next run look at committed runs only, so a run that dies leaves nothing
behind that counts, its cursor does not move, and its repetition writes the same folder again.

A run reads a source from its cursor less the lookback, as updates may arrive late by that much;
what it has seen before is dropped by comparing with the table, so replays change nothing and a
run without news commits nothing. Updates that arrive later than the lookback are not found.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlink.operators.match import latest

c = F.col


@dataclass(frozen=True)
class SyncedTable:
    """A synced table: its folder, the columns that name a row, the source and update time columns,
    and the columns that order versions of a row (the update time first)."""

    spark: SparkSession
    folder: str
    keys: Sequence[str]
    source: str
    order: Sequence[str]
    lookback: str

    def _exists(self, part: str) -> bool:
        """Whether the table has a finished file; the folder of a run that died may hold none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}/run=*/part-*")
        return bool(path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path))

    def runs(self) -> DataFrame | None:
        """Committed (run, source, cursor, inserted, updated); None before the first."""
        if not self._exists("commits"):
            return None
        return self.spark.read.parquet(f"{self.folder}/commits")

    def last_run(self) -> int:
        runs = self.runs()
        return (runs.agg(F.max("run")).first()[0] or 0) if runs is not None else 0

    def rows(self) -> DataFrame | None:
        """The table as of the last committed run: the newest snapshot and the changes after it."""
        last = self.last_run()
        if not last:
            return None
        base, parts = 0, []
        if self._exists("snapshots"):
            snapshots = self.spark.read.parquet(f"{self.folder}/snapshots")
            base = snapshots.agg(F.max("run")).first()[0] or 0
            parts = [snapshots.filter(c("run") == base)]
        if base < last:
            parts.append(self.spark.read.parquet(f"{self.folder}/changes").filter((c("run") > base) & (c("run") <= last)))
        found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
        return latest(found.drop("run", "_known"), list(self.keys), [c(o) for o in self.order])

    def sync(self, feed: DataFrame, fail_before_commit: bool = False) -> bool:
        """Bring the table up to date with ``feed``; False if there was nothing new."""
        run = self.last_run() + 1
        at = self.order[0]
        committed = self.runs()
        rows = feed
        if committed is not None:
            cursors = committed.groupBy(self.source).agg(F.max("cursor").alias("_cursor"))  # one row per source
            rows = feed.join(cursors, self.source, "left").filter(c("_cursor").isNull() | (c(at) > c("_cursor") - F.expr(f"interval {self.lookback}"))).drop("_cursor")
        newest = latest(rows, list(self.keys), [c(o) for o in self.order])
        current = self.rows()
        if current is None:
            fresh = newest.withColumn("_known", F.lit(False))
        else:
            old = current.select(*self.keys, F.struct(*self.order).alias("_old"))
            met = newest.join(old, list(self.keys), "left").withColumn("_known", c("_old").isNotNull())
            fresh = met.filter(~c("_known") | (F.struct(*self.order) > c("_old"))).drop("_old")
        path = f"{self.folder}/changes/run={run}"
        fresh.write.mode("overwrite").parquet(path)
        written = self.spark.read.schema(fresh.schema).parquet(path)
        moved = written.groupBy(self.source).agg(
            F.max(at).alias("cursor"), F.count_if(~c("_known")).alias("inserted"), F.count_if("_known").alias("updated"))
        if not moved.head(1):
            return False
        if fail_before_commit:
            raise RuntimeError("stopped before the commit")
        moved.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/run={run}")
        return True

    def compact(self) -> None:
        """Write the table as of the last run as a snapshot; later reads start there."""
        rows, run = self.rows(), self.last_run()
        if rows is not None:
            rows.write.mode("overwrite").parquet(f"{self.folder}/snapshots/run={run}")
