"""Registry of queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from paywarden.functions.present import present
from paywarden.operators.desk import Desk
from paywarden.operators.scoring import Scored
from paywarden.plans import twin
from paywarden.sources.tables import Tables


class Context:
    """What a query starts from: a session and one data folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.t = spark, Tables(spark, path)

    @cached_property
    def s(self) -> Scored:
        return Scored(self.t)

    @cached_property
    def desk(self) -> Desk:
        return Desk(self.t, self.s)

    def with_stored_queue(self) -> Context:
        """For queries that use the queue more than once."""
        other = Context(self.spark, self.t.path)
        other.__dict__["s"] = self.s.stored()
        return other


@dataclass(frozen=True)
class Entry:
    key: str
    build: Callable[[Context], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, path: str) -> DataFrame:
        return present(self.build(Context(spark, path)))


ENTRIES: dict[str, Entry] = {}


def query(key: str, sql: str | None = None):
    def add(build):
        if key in ENTRIES:
            raise ValueError(f"query {key} is registered twice")
        ENTRIES[key] = Entry(key, build, twin.statement(sql) if sql else None)
        return build
    return add
