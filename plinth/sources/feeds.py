"""Feed items from RSS files, as a batch or a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions.text import blank_to_null, has

ITEM = "guid string, link string, title string, pubDate string, updated string, author string"

# Date forms tried in order.
DATE_FORMS = ["EEE, d MMM yyyy HH:mm:ss Z", "EEE, d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd"]


def parse_date(column: Column | str) -> Column:
    """First date form that fits. The weekday is dropped first, as the parser does not read it."""
    value = F.regexp_replace(F.col(column) if isinstance(column, str) else column, "^[A-Za-z]{3}, ", "")
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(form.replace("EEE, ", ""))) for form in DATE_FORMS])


def feed_items(raw: DataFrame, source_name: str, sector: str) -> DataFrame:
    """(entry_id, url, title, published_at, author, source_name, source_type, sector) of complete items."""
    rows = raw.select(
        F.coalesce(blank_to_null("guid"), F.col("link")).alias("entry_id"), F.col("link").alias("url"),
        F.trim("title").alias("title"), F.coalesce(parse_date("pubDate"), parse_date("updated")).alias("published_at"),
        blank_to_null(F.trim("author")).alias("author"))
    return rows.where(has("url") & has("title")).withColumns({
        "source_name": F.lit(source_name), "source_type": F.lit("rss"),
        "sector": F.lit(sector)})


def read_feed_items(spark: SparkSession, path: str, source_name: str, sector: str) -> DataFrame:
    raw = spark.read.schema(ITEM).option("rowTag", "item").xml(path)
    return feed_items(raw, source_name, sector)


def stream_feed_items(spark: SparkSession, folder: str, source_name: str, sector: str, files_per_batch: int = 100) -> DataFrame:
    """New feed files as they land; the stream's checkpoint is the cursor."""
    raw = (
        spark.readStream.schema(ITEM).format("xml").option("rowTag", "item")
        .option("maxFilesPerTrigger", files_per_batch).load(folder)
    )
    return feed_items(raw, source_name, sector)
