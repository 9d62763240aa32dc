"""Streaming jobs run to completion over the driver tables, and their batch parts."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.plans.registry import query
from plinth.session import checkpoint_root
from plinth.sources.segments import Segments
from plinth.streaming import cursors, feeds
from plinth.streaming.ledger import BEFORE, Ledger

EVENT_ITEMS = """select 'e' || cast(event_id as string) as entry_id, 'https://n.example/' || cast(user_id as string) || '/' || event_type as url,
    event_type || ' by works ' || cast(user_id as string) as title, ts as published_at from {0}"""


@query("stream_new_items", """
    select 'https://n.example/' || user_id || '/' || event_type as url, min('e' || event_id) as entry_id,
           arg_min(strftime(ts, '%Y-%m-%d %H:%M:%S'), 'e' || event_id) as published_at from events group by 1""")
def _(s):
    events = s.base("events")
    stream = s.spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(s.sf_dir)
    items = stream.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("entry_id"),
        F.concat(F.lit("https://n.example/"), F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("url"),
        F.col("ts").cast("timestamp").alias("published_at"))
    root = f"{checkpoint_root(s.spark)}/feed-{uuid.uuid4().hex}"
    running = feeds.run_feed_stream(items, f"{root}/items", f"{root}/state")
    running.awaitTermination()
    return s.spark.read.parquet(f"{root}/items").select("url", "entry_id", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


ITEMS = EVENT_ITEMS.format("events")
FIRM_NAMES = "select c_custkey as id, 'works ' || cast(c_custkey as string) as canonical_name, cast(null as bigint) as merged_into from customer"
STORED = "select 's' || cast(c_custkey as string) as id, 'https://n.example/' || cast(c_custkey as string) || '/view' as url, 'old' as title, cast(c_custkey as string) as author from customer"
# Users whose largest value is high wait for enrichment already, the others are done.
WAITING = """select user_id as entity_id, 'firm' as entity_type, case when max(value) > 200 then 'pending' else 'done' end as status
    from events group by user_id"""
ID = "coalesce(s.id, sha256('source|' || i.url))"


def _ingested(s):
    items = s.sql(ITEMS).select("entry_id", "url", "title")
    sources = s.sql(STORED)
    links = s.sql("select c_custkey as entity_id, 'firm' as entity_type, 'old' as source_id, 'subject' as mention_type from customer")
    return feeds.ingest_batch(items, sources, s.sql(FIRM_NAMES), links, s.sql(WAITING))


@query("ingest_batch_sources", f"""
    with i as (select url, arg_min(title, entry_id) as title from ({ITEMS}) group by url)
    select {ID} as id, coalesce(s.url, i.url) as url, coalesce(i.title, s.title) as title, s.author from ({STORED}) s full join i on i.url = s.url""")
def _(s):
    return _ingested(s)["sources"]


MENTIONED = f"""(select distinct t.url, f.id from ({ITEMS}) t join ({FIRM_NAMES}) f on contains(lower(t.title), f.canonical_name)
    where length(f.canonical_name) >= 5)"""


@query("ingest_batch_links", f"""
    select c_custkey as entity_id, 'old' as source_id from customer
    union all select m.id, {ID} from {MENTIONED} i join (select url as u, id from {MENTIONED}) m on m.u = i.url and m.id = i.id left join ({STORED}) s on s.url = i.url""")
def _(s):
    return _ingested(s)["links"].select("entity_id", "source_id")


@query("ingest_batch_queue", f"""
    select distinct id as entity_id, 'firm' as entity_type, 'pending' as status from {MENTIONED}
    where id not in (select entity_id from ({WAITING}) where status = 'pending')""")
def _(s):
    return _ingested(s)["queue"]


# The feed lands in three parts, in no order of dates; a url may come in several.
FEED = """select 'e' || cast(event_id as string) as entry_id, 'https://n.example/' || cast(user_id as string) || '/' || event_type as url,
    event_type || ' by works ' || cast(user_id as string) as title, event_type as source_name,
    case when value < 20 then 0 when value < 60 then 1 else 2 end as part from events"""
LANDED = f"""
    parts as (select url, title, source_name, part, min(entry_id) as entry_id from ({FEED}) group by all),
    items as (select * from parts p where part = (select min(part) from parts q where q.url = p.url))"""


def _landing(s):
    """The folder of the feed, and a call for each part that lands it."""
    folder = f"{checkpoint_root(s.spark)}/landing-{uuid.uuid4().hex}"
    feed = s.sql(FEED)
    return folder, [lambda k=k: feed.where(F.col("part") == k).write.mode("append").parquet(folder) for k in range(3)]


def _stream(s, folder):
    return s.spark.readStream.schema(s.sql(FEED).schema).parquet(folder)


@query("stream_first_seen", f"with {LANDED} select url, entry_id, part from items")
def _(s):
    folder, parts = _landing(s)
    out, state = f"{folder}-out", f"{folder}-state"
    for land in parts:
        land()
        stream = _stream(s, folder)
        feeds.run_new_items(stream, state, lambda items, n: items.write.mode("overwrite").parquet(f"{out}/batch={n}")).awaitTermination()
    return s.spark.read.parquet(out).select("url", "entry_id", "part")


class Broken(Exception):
    pass


def _fed(s):
    """The feed job over three parts; the second batch fails between two tables and is taken up again."""
    folder, parts = _landing(s)
    ledger = Ledger(Segments(s.spark, f"{folder}-tables"), feeds.FEED_KEYS)
    ledger.commit(BEFORE, {
        "sources": s.sql(STORED), "links": s.sql("select c_custkey as entity_id, 'firm' as entity_type, 'old' as source_id, 'subject' as mention_type from customer"),
        "queue": s.sql(WAITING), "cursors": s.sql("select 'click' as source_name, 'before' as last_cursor, cast(0 as bigint) as entity_count, 'ok' as status"),
    })
    firms, state = s.sql(FIRM_NAMES), f"{folder}-state"

    def breaks(written):
        if written == "links":
            raise Broken(written)

    for number, land in enumerate(parts):
        land()
        for after in [breaks, None] if number == 1 else [None]:
            running = feeds.ingest_stream(_stream(s, folder).drop("part"), ledger, firms, state, after)
            try:
                running.awaitTermination()
            except StreamingQueryException:
                if after is None:
                    raise
    return ledger


NAMED = f"(select distinct i.url, f.id as firm_id from items i join ({FIRM_NAMES}) f on contains(lower(i.title), f.canonical_name) where length(f.canonical_name) >= 5)"
# Every row of the four tables, as text in columns of one shape.
SHAPES = {
    "sources": "select 'sources' as kind, url as name, id as held, title as first, author as second from {0}",
    "links": "select 'links' as kind, cast(entity_id as string) as name, source_id as held, entity_type as first, mention_type as second from {0}",
    "queue": "select 'queue' as kind, cast(entity_id as string) as name, status as held, entity_type as first, cast(null as string) as second from {0}",
    "cursors": "select 'cursors' as kind, source_name as name, last_cursor as held, cast(entity_count as string) as first, status as second from {0}",
}


@query("feed_job_tables", f"""
    with {LANDED},
    sources as (select {ID} as id, coalesce(s.url, i.url) as url, coalesce(i.title, s.title) as title, s.author from ({STORED}) s full join items i on i.url = s.url),
    links as (select c_custkey as entity_id, 'firm' as entity_type, 'old' as source_id, 'subject' as mention_type from customer
        union all select i.firm_id, 'firm', {ID}, 'subject' from {NAMED} i left join ({STORED}) s on s.url = i.url),
    queue as (select coalesce(w.entity_id, n.firm_id) as entity_id, 'firm' as entity_type, case when n.firm_id is not null then 'pending' else w.status end as status
        from ({WAITING}) w full join (select distinct firm_id from {NAMED}) n on n.firm_id = w.entity_id),
    runs as (select source_name, part, max(entry_id) as last_cursor, count(*) as entity_count from items group by source_name, part),
    cursors as (select source_name, arg_max(last_cursor, part) as last_cursor, arg_max(entity_count, part) as entity_count, 'ok' as status from runs group by source_name
        union all select 'click', 'before', 0, 'ok' where 'click' not in (select source_name from runs))
    {' union all '.join(shape.format(table) for table, shape in SHAPES.items())}""")
def _(s):
    ledger = _fed(s)
    shown = [s.spark.sql(shape.format("{rows}"), rows=ledger.state(table)) for table, shape in SHAPES.items()]
    return reduce(DataFrame.unionByName, shown)


@query("after_cursor", """
    select cast(doc_id as varchar) as entry_id from documents where cast(doc_id as varchar) > (select max(last_cursor) from v_cursors where source_name = 'src3_en')""")
def _(s):
    items = s.base("documents").select(F.col("doc_id").cast("string").alias("entry_id"))
    return cursors.after_cursor(items, s.cursors, "src3_en")


@query("page_resume", """
    with c as (select max(try_cast(last_cursor as bigint)) as last from v_cursors where source_name = 'src2_de')
    select doc_id as page from documents, c where doc_id > coalesce(last, 0) and doc_id <= coalesce(last, 0) + 8""")
def _(s):
    pages = s.base("documents").select(F.col("doc_id").alias("page"))
    return cursors.resume_after(pages, s.cursors, "src2_de", 8)
