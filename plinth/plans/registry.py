"""Decorator that registers a query over the stand-in tables with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from plinth.plans.standins import StandIns, with_views


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register `build(standins) -> DataFrame` under `name`; `sql` may use the stand-in view names."""

    def register(build: Callable[[StandIns], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(StandIns(spark, sf_dir))

        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        ENTRIES[name] = Entry(run, with_views(sql) if sql else None)
        return build

    return register
