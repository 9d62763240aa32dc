"""First-of-group, top-n per group and global row numbers that never sit in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.session import cut_lineage


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of every group.

    Spark turns `row_number <= n` into a group limit that runs before the shuffle, so each task
    sends at most n rows of a hot group. `order` must break ties.
    """
    name = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by `order`; NULL keys count as equal."""
    return top_n(df, keys, order, 1)


def range_parts(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows split by range of `order` into `_part` numbers that rise with it.

    The split is written to the checkpoint folder once, so the part numbers stay the same
    however often the result is read.
    """
    spread = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    return cut_lineage(spread)


def number_rows(df: DataFrame, order: list[Column], name: str = "row_no") -> DataFrame:
    """Global 1-based row numbers without a single-task sort.

    Each range part is numbered on its own and shifted by the rows of the parts before it. The
    table of part sizes has one row per part.
    """
    parts = range_parts(df, order)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))
    # One row per part: a running total over a table as long as the number of partitions.
    running = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(running), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        parts.withColumn("_within", within)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, (F.col("_start") + F.col("_within")).cast("long"))
        .drop("_part", "_within", "_start")
    )


def page_of_all(df: DataFrame, order: list[Column], per_page: int) -> DataFrame:
    """Every row with its page number, for jobs that render all pages."""
    numbered = number_rows(df, order)
    return numbered.withColumn("page", F.floor((F.col("row_no") - 1) / per_page).cast("long") + 1)


def page(df: DataFrame, order: list[Column], page_no: int, per_page: int) -> DataFrame:
    """One page of rows by top-k; `page_totals` gives the exact count."""
    return df.orderBy(*order).offset((page_no - 1) * per_page).limit(per_page)


def page_totals(df: DataFrame, per_page: int) -> DataFrame:
    counted = df.agg(F.count("*").alias("total"))
    return counted.withColumn("pages", F.ceil(F.col("total") / per_page).cast("long"))


def with_next(df: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """Each row with `next_<column>` of the row after it in the global order.

    `lead` runs inside each range part; the last row of a part takes the first row of the next
    part that is not empty. The stitch table has one row per part.
    """
    parts = range_parts(df, order)
    window = Window.partitionBy("_part").orderBy(*order)
    firsts = keep_first(parts, ["_part"], order).select("_part", F.struct(*columns).alias("_first"))
    after = firsts.select(
        "_part", F.lead("_first").over(Window.orderBy("_part")).alias("_first_after")
    )
    led = parts.withColumn("_next", F.lead(F.struct(*columns)).over(window))
    stitched = led.join(F.broadcast(after), "_part", "left").withColumn(
        "_next", F.coalesce("_next", "_first_after"))
    fields = [F.col("_next")[c].alias(f"next_{c}") for c in columns]
    return stitched.select(*df.columns, *fields)
