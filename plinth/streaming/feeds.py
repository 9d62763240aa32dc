"""The feed job as a stream: each item once, upserted, with firms mentioned in its title queued."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plinth.operators.merge import enqueue, upsert
from plinth.operators.ranking import keep_first
from plinth.operators.simjoin import match_mentions
from plinth.schema import entity_id
from plinth.session import write_once
from plinth.streaming.ledger import Ledger

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new_items(items: DataFrame, stored: DataFrame | None, key: str = "url", order: str = "entry_id") -> DataFrame:
    """Items of one batch whose key is not stored yet, the first of each key.

    The stored keys are the state, not a watermark: an item is new however old its date is.
    """
    once = keep_first(items, [key], [F.asc(order)])
    return once if stored is None else once.join(stored.select(key).distinct(), key, "left_anti")


def ingest_batch(
    items: DataFrame, sources: DataFrame, firms: DataFrame, links: DataFrame, queue: DataFrame,
) -> dict[str, DataFrame]:
    """One batch of items (url, title, ...) merged in: sources, subject links and queue rows.

    A new source gets an id from its address, a known one keeps its own, and links carry that id.
    Running the same batch again gives the same tables.
    """
    live = firms.where(F.col("merged_into").isNull())
    minted = items.withColumn("id", entity_id("source", "url"))
    changing = [c for c in items.columns if c != "url"]
    merged = upsert(sources, minted, ["url"], changing, order=[F.asc("entry_id")])
    mentions = match_mentions(items.select("url", "title").distinct(), live, "url", "title")
    subjects = mentions.select("url", F.col("id").alias("entity_id")).hint("merge").join(merged.select("url", F.col("id").alias("source_id")), "url").select(
        "entity_id", F.lit("firm").alias("entity_type"), "source_id", F.lit("subject").alias("mention_type"))
    edges = upsert(links, subjects, ["entity_id", "entity_type", "source_id"], policy="keep_first")
    waiting = enqueue(queue, subjects)
    return {"sources": merged, "links": edges, "queue": waiting}


def first_seen(stream: DataFrame, key: str = "url", order: str = "entry_id") -> DataFrame:
    """A stream of all keys met in each batch: the first row of each key, as `first`, and whether it is `fresh`.

    The state of the stream holds one row a key, with the time of the batch that brought it: a key is fresh
    while that is the time of the batch at hand. There is no watermark, so an item is new however old its date
    is; rows of a batch are summed before they are shuffled, so a key in a third of them is one row a task.
    """
    stamped = stream.withColumn("_batch_time", F.current_timestamp())
    row = F.struct("_batch_time", order, *[c for c in stream.columns if c not in (key, order)])
    return stamped.groupBy(key).agg(F.min(row).alias("first"), F.max("_batch_time").alias("_last")).withColumn(
        "fresh", F.col("first._batch_time") == F.col("_last")).drop("_last")


def run_new_items(
    stream: DataFrame, checkpoint: str, then: Callable[[DataFrame, int], None], key: str = "url", order: str = "entry_id",
) -> StreamingQuery:
    """Give the new items of all files that have landed to `then`, batch by batch, then stop.

    The keys met so far are the state of the stream, kept on the disks of the executors and in the
    checkpoint; a restarted stream goes on from there.
    """
    columns = [key, *[F.col(f"first.{c}").alias(c) for c in stream.columns if c != key]]

    def fresh(batch: DataFrame, batch_id: int) -> None:
        then(batch.where("fresh").select(*columns), batch_id)

    provider = "spark.sql.streaming.stateStore.providerClass"
    conf = stream.sparkSession.conf
    before = conf.get(provider)
    conf.set(provider, ROCKS)
    try:
        # A stream keeps the settings it was started with.
        return (
            first_seen(stream, key, order).writeStream.foreachBatch(fresh).outputMode("update")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        conf.set(provider, before)


def ingest_changes(items: DataFrame, sources: DataFrame, firms: DataFrame, links: DataFrame, queue: DataFrame) -> dict[str, DataFrame]:
    """The rows that `items` (entry_id, url, title, source_name, one row a url) add or change: sources, links, queue and cursor.

    A known source keeps its id and what the items lack. A firm that a title names gets a link and, if none is
    pending, a place in the queue. The cursor of each source is its newest entry.
    """
    # Merges, for all of these tables grow; by their small files the driver would gather them.
    known = sources.hint("merge").join(items.select("url"), "url", "left_semi")
    merged = upsert(known, items.drop("source_name", "entry_id").withColumn("id", entity_id("source", "url")), ["url"], ["title"])
    live = firms.where(F.col("merged_into").isNull())
    named = match_mentions(items.select("url", "title"), live, "url", "title").select("url", F.col("id").alias("entity_id"))
    subjects = named.hint("merge").join(merged.select("url", F.col("id").alias("source_id")), "url").select(
        "entity_id", F.lit("firm").alias("entity_type"), "source_id", F.lit("subject").alias("mention_type"))
    edges = subjects.hint("merge").join(links, ["entity_id", "entity_type", "source_id"], "left_anti")
    runs = items.groupBy("source_name").agg(
        F.max("entry_id").alias("last_cursor"), F.count("*").alias("entity_count"), F.lit("ok").alias("status"))
    return {"sources": merged, "links": edges, "queue": enqueue(queue, subjects), "cursors": runs}


#: The tables of the feed job and their keys.
FEED_KEYS = {
    "sources": ["url"], "links": ["entity_id", "entity_type", "source_id"], "queue": ["entity_id", "entity_type"], "cursors": ["source_name"],
}


def ingest_stream(stream: DataFrame, ledger: Ledger, firms: DataFrame, checkpoint: str, after: Callable[[str], None] | None = None) -> StreamingQuery:
    """The whole feed job: new items to sources, links, queue and cursors, each batch in all of them or in none.

    The state of the stream tells what is new, the ledger under the same batch number what was applied.
    """
    def apply(items: DataFrame, batch_id: int) -> None:
        def changes() -> dict[str, DataFrame]:
            once = write_once(items)
            return ingest_changes(once, ledger.state("sources"), firms, ledger.state("links"), ledger.state("queue"))

        ledger.commit(batch_id, changes, after)

    return run_new_items(stream, checkpoint, apply)


def run_feed_stream(
    stream: DataFrame, out: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Write new items of all files that have landed, then stop. The checkpoint is the cursor.

    A batch is written under its number, so a batch repeated after a failure replaces itself; it
    is compared with the batches before it only. `then` gets the written items of each batch, for
    example to merge them by `ingest_batch` and to write the cursor.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(out).where(F.col("batch") < batch_id) if batch_id else None
        path = f"{out}/batch={batch_id}"
        new_items(batch, before).write.mode("overwrite").parquet(path)
        if then:
            then(spark.read.schema(batch.schema).parquet(path), batch_id)

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
