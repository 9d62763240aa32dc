"""Ingest cursors: the visible report of how far each source has been read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.operators.merge import upsert

def cursor_of(cursors: DataFrame, source_name: str) -> DataFrame:
    """The last cursor of a source: no row before its first run."""
    return cursors.where(F.col("source_name") == source_name).select("last_cursor")


def write_cursors(cursors: DataFrame, runs: DataFrame) -> DataFrame:
    """Cursors after the runs (one row per source_name)."""
    return upsert(cursors, runs, ["source_name"])


def run_status(failed: str = "failed", done: str = "done") -> Column:
    """ok without failures, partial with some, error when nothing was done."""
    return F.when(F.col(failed) == 0, F.lit("ok")).when(F.col(done) > 0, F.lit("partial")).otherwise(F.lit("error"))


def after_cursor(items: DataFrame, cursors: DataFrame, source_name: str, key: str = "entry_id") -> DataFrame:
    """Items whose id sorts after the source's last cursor, as text: the rule of the polled job."""
    last = cursor_of(cursors, source_name).agg(F.max("last_cursor")).scalar()
    return items.where(last.isNull() | (F.col(key) > last))


def resume_after(pages: DataFrame, cursors: DataFrame, source_name: str, max_pages: int, page: str = "page") -> DataFrame:
    """Rows of the next `max_pages` pages after the numeric cursor of the source."""
    last = cursor_of(cursors, source_name).agg(F.max(F.col("last_cursor").try_cast("long"))).scalar()
    done = F.coalesce(last, F.lit(0))
    return pages.where((F.col(page) > done) & (F.col(page) <= done + max_pages))
