"""Registry of named queries with their output schema and DuckDB check statement."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlink.plans.oracle_ctes import with_entities
from ledgerlink.sources.entities import Entities, StoredEntities


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Entities], DataFrame]
    columns: tuple[tuple[str, str], ...]
    sql: str | None
    stored: bool

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build((StoredEntities if self.stored else Entities)(spark, sf_dir))
        return df.select([F.col(n).cast(t).alias(n) for n, t in self.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        names = {"string": "varchar", "timestamp_ntz": "timestamp"}
        cols = ", ".join(f"CAST({n} AS {names.get(t, t)}) AS {n}" for n, t in self.columns)
        return with_entities(f"SELECT {cols} FROM (\n{self.sql}\n) AS answer")


QUERIES: dict[str, Query] = {}


def _parse(schema: str) -> tuple[tuple[str, str], ...]:
    out, depth, item = [], 0, ""
    for ch in schema + ",":
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            name, kind = item.split()
            out.append((name, kind))
            item = ""
        else:
            item += ch
    return tuple(out)


def query(name: str, schema: str, sql: str | None = None, stored: bool = False):
    """Register a builder under ``name``; ``schema`` fixes names and types on both sides.

    ``stored`` lets the builder read the document tables written once per session.
    """

    def wrap(build: Callable[[Entities], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, build, _parse(schema), sql, stored)
        return build

    return wrap


def stored_query(name: str, schema: str, sql: str | None = None):
    """Like ``query`` for builders that read the stored document tables."""
    return query(name, schema, sql, stored=True)
