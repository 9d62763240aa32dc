"""Named ingest jobs: each runs on its own, and a failure of one is a row, not the end of the run."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

RESULT = "name string, entity_count long, duration_s double, error string"


def unknown_jobs(registry: dict[str, Callable], names: list[str]) -> list[str]:
    return [name for name in names if name not in registry]


def run_jobs(spark: SparkSession, registry: dict[str, Callable[[SparkSession], int]], names: list[str] | None = None) -> DataFrame:
    """Results of the chosen jobs (all by default), each a callable that returns its entity count."""
    chosen = names or list(registry)
    missing = unknown_jobs(registry, chosen)
    if missing:
        raise KeyError(f"unknown sources: {', '.join(missing)}; available: {', '.join(registry)}")
    results = []
    for name in chosen:
        start, count, error = time.time(), 0, None
        try:
            count = int(registry[name](spark))
        except Exception as failure:  # the report carries it; the other jobs still run
            logging.exception("job %s failed", name)
            error = f"{type(failure).__name__}: {failure}"
        results.append((name, count, time.time() - start, error))
    return spark.createDataFrame(results, RESULT)
