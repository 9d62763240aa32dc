"""Table snapshots, reports and the run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions.text import has
from plinth.sources.segments import Segments


def write_snapshot(df: DataFrame, base: str) -> str:
    """Write the table as a new version and return its name; readers keep the version before until this one is whole.

    Of writers that end at the same time one name is the greater, for all readers alike.
    """
    parts = Segments(df.sparkSession, base)
    number = 1 + max((int(v.split("-")[0]) for v in parts.segments()), default=0)
    version = f"{number}-{Segments.new()}"
    parts.put(version, "rows", df)
    parts.commit(version)
    return version


def read_snapshot(spark: SparkSession, base: str) -> DataFrame:
    parts = Segments(spark, base)
    versions = sorted(parts.segments(), key=lambda v: (int(v.split("-")[0]), v))
    if not versions:
        raise FileNotFoundError(f"no complete version under {base}")
    return parts.read(versions[-1], "rows")


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Report rows as JSON lines or as CSV with a header, in the order of `df`."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.json(path)


def run_log_row(results: DataFrame, started_at: Column, finished_at: Column, by: list[str] | None = None) -> DataFrame:
    """One row per run (per `by`, for a table of runs) from per-source results; a run has as many sources as there are registered jobs."""
    summary = F.sort_array(F.collect_list(F.struct(
        "name", F.col("entity_count").alias("entities"), F.round("duration_s", 1).alias("duration_s"), "error")))
    return results.groupBy(*(by or [])).agg(
        summary.alias("summary"), F.sum("entity_count").cast("long").alias("total_entities"),
        F.count_if(has("error")).alias("failures"),
    ).select(
        *(by or []), started_at.alias("started_at"), finished_at.alias("finished_at"),
        F.transform("summary", lambda r: r["name"]).alias("sources_run"), "total_entities", "failures", "summary")


def append_run_log(results: DataFrame, started_at: Column, finished_at: Column, path: str) -> None:
    run_log_row(results, started_at, finished_at).write.mode("append").parquet(path)
