"""Keyed merges, edges, queues and review decisions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plinth.operators import ingest, merge
from plinth.plans import sqlparts as sp
from plinth.plans.registry import query
from plinth.session import checkpoint_root, write_once
from plinth.sources.keyed import BucketedTable, KeyedTable

# A firm update feed: known firms and new ones, with many keys more than once.
UPDATES = """
    select case when o_orderstatus = 'F' then 1000000000 + o_custkey else o_custkey end as id, 'Renamed ' || o_orderpriority as display_name,
           case when o_orderkey % 4 = 0 then cast(null as string) else 'Town ' || o_orderstatus end as city, o_orderkey as pos
    from orders"""
FIRST = f"(select * from (select *, row_number() over (partition by id order by pos) as rn from ({UPDATES})) where rn = 1)"
CORE = ["id", "slug", "display_name", "city", "quality_score"]


def _core(s):
    return s.firms.select(*CORE)


def _updates(s):
    return s.sql(UPDATES)


@query("upsert_overwrite", f"""
    select coalesce(f.id, u.id) as id, f.slug, case when u.id is not null then u.display_name else f.display_name end as display_name,
           case when u.id is not null then u.city else f.city end as city, f.quality_score
    from v_firms f full join {FIRST} u on u.id = f.id""")
def _(s):
    return merge.upsert(_core(s), _updates(s), ["id"], order=[F.asc("pos")])


# A hundredth of the firms, those of three numbers that follow each other in the MD5 order of parts.
RENAMED = "select id, 'Touched ' || display_name as display_name from v_firms where substr(md5(cast(id as string)), 6, 2) < '03'"
PARTS = 64
PART_SQL = f"(('0x' || substr(md5(cast(id as varchar)), 1, 7))::int % {PARTS})"


@query("merge_touched_parts", f"""
    with r as (select *, {PART_SQL} as part from ({RENAMED}))
    select f.id, coalesce(r.display_name, f.display_name) as display_name, f.city, {PART_SQL.replace('id as', 'f.id as')} as part,
           {PART_SQL.replace('id as', 'f.id as')} not in (select part from r) as kept_file
    from v_firms f left join r on r.id = f.id""")
def _(s):
    path = f"{checkpoint_root(s.spark)}/keyed-{uuid.uuid4().hex}"
    table = KeyedTable(s.spark, path, ["id"], PARTS).create(s.firms.select("id", "display_name", "city"))
    before = write_once(table.stored().select(F.col("_metadata.file_name").alias("_file")).distinct()).withColumn("_was", F.lit(True))
    table.merge(s.sql(RENAMED))
    after = table.stored().withColumn("_file", F.col("_metadata.file_name"))
    return after.join(before, "_file", "left").select(
        "id", "display_name", "city", F.col("_part").alias("part"), F.coalesce("_was", F.lit(False)).alias("kept_file"))


@query("merge_buckets_twice", f"""
    select coalesce(f.id, u.id) as id, f.slug, case when u.id is not null then u.display_name else 'before' end as display_name,
           case when u.id is not null then u.city else f.city end as city, f.quality_score
    from v_firms f full join {FIRST} u on u.id = f.id""")
def _(s):
    table = BucketedTable(s.spark, f"firms_{uuid.uuid4().hex[:12]}", ["id"], 16)
    folder = checkpoint_root(s.spark)
    first = table.create(_core(s), folder)
    renamed = first.merge(_core(s).select("id", F.lit("before").alias("display_name")), folder)
    merged = write_once(renamed.merged(_updates(s), order=[F.asc("pos")]))
    first.drop(), renamed.drop()
    return merged


@query("upsert_keep_first", f"""
    select coalesce(f.id, u.id) as id, f.slug, case when f.id is not null then f.display_name else u.display_name end as display_name,
           case when f.id is not null then f.city else u.city end as city, f.quality_score
    from v_firms f full join {FIRST} u on u.id = f.id""")
def _(s):
    return merge.upsert(_core(s), _updates(s), ["id"], policy="keep_first", order=[F.asc("pos")])


@query("upsert_coalesce", f"""
    select coalesce(f.id, u.id) as id, f.slug, coalesce(f.display_name, u.display_name) as display_name,
           coalesce(f.city, u.city) as city, f.quality_score
    from v_firms f full join {FIRST} u on u.id = f.id""")
def _(s):
    return merge.upsert(_core(s), _updates(s), ["id"], policy="coalesce", order=[F.asc("pos")])


@query("seed_upsert", f"""
    select coalesce(f.id, u.id) as id, f.slug, case when u.id is not null then u.display_name else f.display_name end as display_name,
           case when f.id is null then u.city else f.city end as city, f.quality_score
    from v_firms f full join {FIRST} u on u.id = f.id""")
def _(s):
    return merge.upsert(_core(s), _updates(s), ["id"], update_cols=["display_name"], order=[F.asc("pos")])


@query("upsert_stamps_changes", f"""
    select coalesce(f.id, u.id) as id, case when u.id is not null and (f.id is null or u.display_name <> f.display_name) then 'now' else 'before' end as stamp
    from v_firms f full join {FIRST} u on u.id = f.id""")
def _(s):
    target = _core(s).select("id", "display_name").withColumn("stamp", F.lit("before"))
    return merge.upsert(target, _updates(s).select("id", "display_name", "pos"), ["id"], order=[F.asc("pos")], stamp="stamp",
                        now=F.lit("now")).select("id", "stamp")


@query("upsert_actions", f"""
    with k as (select id, count(*) as n from ({UPDATES}) group by id)
    select count(*) filter (where id not in (select id from v_firms)) as created,
           count(*) filter (where id in (select id from v_firms)) as linked, cast(sum(n - 1) as bigint) as skipped from k""")
def _(s):
    return merge.upsert_actions(s.firms, _updates(s), ["id"])


GEO = """select o_custkey as id, cast(o_orderkey % 180 - 90 as double) as latitude, cast(o_orderkey % 360 - 180 as double) as longitude,
         'Filled ' || o_orderstatus as city, o_orderkey as pos from orders"""


@query("fill_missing", f"""
    with u as (select * from (select *, row_number() over (partition by id order by pos) as rn from ({GEO})) where rn = 1)
    select f.id, case when f.latitude is not null then f.latitude else u.latitude end as latitude,
           case when f.latitude is not null then f.longitude else coalesce(u.longitude, f.longitude) end as longitude,
           coalesce(nullif(f.city, ''), u.city) as city from v_firms f left join u on u.id = f.id""")
def _(s):
    target = s.firms.select("id", "latitude", "longitude", "city")
    return merge.fill_missing(target, s.sql(GEO), "id", ["latitude", "longitude", "city"],
                              together=[("latitude", "longitude")], order=[F.asc("pos")])


LINKS = "select o_custkey as entity_id, 'firm' as entity_type, o_orderkey % 700 as source_id, 'api' as mention_type, o_orderkey as pos from orders"


@query("link_edges", f"""
    with n as (select *, row_number() over (partition by entity_id, entity_type, source_id order by pos) as rn from ({LINKS}))
    select entity_id, entity_type, source_id, mention_type from v_entity_sources
    union all
    select entity_id, entity_type, source_id, mention_type from n where rn = 1 and not exists (
        select 1 from v_entity_sources e where e.entity_id = n.entity_id and e.entity_type = n.entity_type and e.source_id = n.source_id)""")
def _(s):
    old = s.entity_sources.select("entity_id", "entity_type", "source_id", "mention_type")
    return merge.link_edges(old, s.sql(LINKS), ["entity_id", "entity_type", "source_id"], [F.asc("pos")])


WON = "select award_id, firm_id, person_id, year, project_name, award_id * 7 as pos from v_recipients"


@query("link_recipients_null_safe", f"""
    select distinct award_id, firm_id, person_id, year from (
        select award_id, firm_id, person_id, year from v_recipients
        union all select award_id, firm_id, cast(null as bigint), year from v_recipients)""")
def _(s):
    keys = ["award_id", "firm_id", "person_id", "year"]
    old = s.recipients.select(*keys).distinct()
    new = s.sql(WON).withColumn("person_id", F.lit(None).cast("long")).select(*keys)
    once = merge.link_edges(old, new, keys, [F.asc("award_id")])
    return merge.link_edges(once, new, keys, [F.asc("award_id")])


@query("set_current_firm", """
    select p.id, coalesce(p.current_firm_id, m.firm_id) as current_firm_id from v_people p
    left join (select person_id, min(firm_id) as firm_id from v_firm_people group by 1) m on m.person_id = p.id""")
def _(s):
    return merge.set_current_firm(s.people, s.firm_people, [F.asc("firm_id")]).select("id", "current_firm_id")


NEW_ALIASES = """select c_custkey + 1 as entity_id, 'firm' as entity_type, 'W' || cast(c_custkey as string) as alias,
    'w' || cast(c_custkey as string) as alias_normalized from customer"""
OLD_ALIASES = "select entity_type, alias_normalized, min(entity_id) as entity_id from v_aliases group by 1, 2"


@query("aliases_keep_first", f"""
    select coalesce(o.entity_type, n.entity_type) as entity_type, coalesce(o.alias_normalized, n.alias_normalized) as alias_normalized,
           coalesce(o.entity_id, n.entity_id) as entity_id
    from ({OLD_ALIASES}) o full join ({NEW_ALIASES}) n using (entity_type, alias_normalized)""")
def _(s):
    return merge.add_aliases(s.sql(OLD_ALIASES), s.sql(NEW_ALIASES).drop("alias"), [F.asc("entity_id")])


@query("aliases_overwrite", f"""
    select coalesce(o.entity_type, n.entity_type) as entity_type, coalesce(o.alias_normalized, n.alias_normalized) as alias_normalized,
           coalesce(n.entity_id, o.entity_id) as entity_id
    from ({OLD_ALIASES}) o full join ({NEW_ALIASES}) n using (entity_type, alias_normalized)""")
def _(s):
    return merge.add_aliases(s.sql(OLD_ALIASES), s.sql(NEW_ALIASES).drop("alias"), [F.asc("entity_id")], "overwrite")


WANTED = "select c_custkey as entity_id, 'firm' as entity_type from customer union all select o_custkey, 'firm' from orders"


@query("enqueue", f"""
    select distinct entity_id, entity_type, 'pending' as status from ({WANTED}) w where not exists (
        select 1 from v_queue q where q.entity_id = w.entity_id and q.entity_type = w.entity_type and q.status in ('pending', 'processing'))""")
def _(s):
    return merge.enqueue(s.queue, s.sql(WANTED))


OUTCOMES = "select event_id as id, value > 50 as ok, 'too low' as error from events"


@query("queue_transition", f"""
    select q.id, case when q.status = 'pending' and o.ok then 'done' when q.status = 'pending' and not o.ok then 'failed' else q.status end as status,
           case when q.status = 'pending' and not o.ok then q.attempts + 1 else q.attempts end as attempts,
           case when q.status = 'pending' and not o.ok then o.error end as last_error,
           case when q.status = 'pending' and o.ok then 'now' end as enriched_at
    from v_queue q left join ({OUTCOMES}) o on o.id = q.id""")
def _(s):
    queue = s.queue.select("id", "status", "attempts").withColumns({
        "last_error": F.lit(None).cast("string"), "enriched_at": F.lit(None).cast("string")})
    return merge.queue_transition(queue, s.sql(OUTCOMES), now=F.lit("now"))


NEW_REVIEWS = """select event_type || ' ' || cast(user_id as string) as candidate_name, 'firm' as entity_type,
    case when event_id % 5 = 0 then cast(null as bigint) else user_id end as suggested_entity_id, 0.7 as confidence, event_id as pos from events"""


@query("review_candidates", f"""
    with n as (select *, row_number() over (partition by candidate_name, entity_type, suggested_entity_id order by pos) as rn from ({NEW_REVIEWS}))
    select candidate_name, entity_type, suggested_entity_id, pos from n
    where suggested_entity_id is null or (rn = 1 and not exists (select 1 from v_review r where r.status = 'pending'
        and r.candidate_name = n.candidate_name and r.entity_type = n.entity_type and r.suggested_entity_id = n.suggested_entity_id))""")
def _(s):
    return merge.review_candidates(s.review, s.sql(NEW_REVIEWS), [F.asc("pos")]).select(
        "candidate_name", "entity_type", "suggested_entity_id", "pos")


DECISIONS = """select event_id as id, case event_id % 3 when 0 then 'accept' when 1 then 'reject' else 'skip' end as decision,
    'at ' || cast(event_id as string) as at from events"""


@query("apply_review", f"""
    select r.id, case when r.status <> 'pending' or d.id is null then r.status when d.decision = 'accept' then 'accepted'
                      when d.decision = 'reject' then 'rejected' else 'skipped' end as status,
           case when r.status = 'pending' and d.decision in ('accept', 'reject') then d.at end as resolved_at
    from v_review r left join ({DECISIONS}) d on d.id = r.id""")
def _(s):
    queue = s.review.select("id", "status").withColumn("resolved_at", F.lit(None).cast("string"))
    return merge.apply_review(queue, s.sql(DECISIONS))


INCOMING = """select o_orderkey as pos, case o_orderkey % 3 when 0 then 'Firm ' || cast(o_custkey as string) else 'New Firm ' || cast(o_custkey as string) end as display_name,
    'design' as sector, case when o_orderkey % 2 = 0 then 'Q' || cast(o_orderkey as string) end as wikidata_id, o_orderstatus as city from orders"""


GROUPED = f"""
    i as (select *, case when display_name like 'New%' then 'new-' else '' end || 'firm-' || split_part(display_name, ' ', -1) as slug from ({INCOMING})),
    g as (select slug, arg_max(display_name, pos) as display_name, arg_min(city, pos) as city,
                 arg_min(wikidata_id, pos) filter (where wikidata_id is not null) as wikidata_id from i group by slug),
    ids as (select g.slug, g.display_name, coalesce(cast(f.id as varchar), sha256('firm|' || g.slug)) as id from g left join v_firms f on f.slug = g.slug)"""


def _upserted(s):
    entities = s.firms.withColumn("id", F.col("id").cast("string"))
    aliases = s.aliases.withColumn("entity_id", F.col("entity_id").cast("string"))
    queue = s.queue.withColumn("entity_id", F.col("entity_id").cast("string"))
    return merge.upsert_entities(entities, aliases, queue, s.sql(INCOMING), "firm")


@query("upsert_entities_with_aliases", f"""
    with {GROUPED}
    select coalesce(cast(f.id as varchar), ids.id) as id, coalesce(f.slug, g.slug) as slug, coalesce(g.display_name, f.display_name) as display_name,
           coalesce(lower(g.display_name), f.canonical_name) as canonical_name,
           case when f.slug is null then 'design' else f.sector end as sector, case when f.slug is null then g.city else f.city end as city,
           coalesce(f.wikidata_id, g.wikidata_id) as wikidata_id
    from v_firms f full join g on g.slug = f.slug left join ids on ids.slug = g.slug""")
def _(s):
    return _upserted(s)["entities"].select("id", "slug", "display_name", "canonical_name", "sector", "city", "wikidata_id")


@query("upsert_entities_ids", f"with {GROUPED} select slug, id from ids")
def _(s):
    return _upserted(s)["ids"]


@query("upsert_entities_queue", f"""
    with {GROUPED} select cast(entity_id as varchar) as entity_id, entity_type, status from v_queue
    union all select id, 'firm', 'pending' from ids where not exists (
        select 1 from v_queue q where cast(q.entity_id as varchar) = ids.id and q.entity_type = 'firm' and q.status in ('pending', 'processing'))""")
def _(s):
    return _upserted(s)["queue"].select("entity_id", "entity_type", "status")


@query("upsert_entities_aliases", f"""
    with {GROUPED},
    forms as (select id as entity_id, unnest({sp.aliases(sp.normalize('display_name'))}) as alias from ids),
    named as (select entity_id, alias, {sp.normalize('alias')} as alias_normalized from forms),
    firsts as (select *, row_number() over (partition by alias_normalized order by entity_id, alias) as rn from named where length(alias_normalized) > 0)
    select cast(entity_id as varchar) as entity_id, entity_type, alias, alias_normalized from v_aliases
    union all select entity_id, 'firm', alias, alias_normalized from firsts where rn = 1 and not exists (
        select 1 from v_aliases a where a.entity_type = 'firm' and a.alias_normalized = firsts.alias_normalized)""")
def _(s):
    return _upserted(s)["aliases"].select("entity_id", "entity_type", "alias", "alias_normalized")


@query("upsert_awards", """
    with n as (select distinct 'award-' || o_orderpriority as award_name, year(o_orderdate) as year from orders)
    select regexp_replace(lower(award_name), '[^a-z0-9-]+', '-', 'g') || '-' || year as slug, award_name, cast(year as int) as year from n
    union all select slug, award_name, year from v_awards""")
def _(s):
    facts = s.sql("""select 'award-' || o_orderpriority as award_name, cast(year(o_orderdate) as int) as year,
                     o_orderpriority as organization, '1' as prestige from orders""")
    awards = s.awards.withColumn("id", F.col("id").cast("string"))
    return ingest.upsert_awards(awards, facts).select("slug", "award_name", "year")


@query("upsert_projects", """
    select coalesce(p.slug, n.slug) as slug, coalesce(n.display_name, p.display_name) as display_name, p.location, coalesce(n.year, p.year) as year
    from (select 'p-' || s_suppkey as slug, s_name as display_name, 'L' || s_nationkey as location, cast(null as int) as year from supplier) p
    full join (select 'p-' || l_suppkey as slug, min('Project ' || l_suppkey) as display_name, cast(min(year(l_shipdate)) as int) as year
               from lineitem group by l_suppkey) n on n.slug = p.slug""")
def _(s):
    projects = s.sql("""select 'p-' || cast(s_suppkey as string) as slug, s_name as display_name,
                        'L' || cast(s_nationkey as string) as location, cast(null as int) as year from supplier""")
    rows = s.sql("""select 'p-' || cast(l_suppkey as string) as slug, 'Project ' || cast(l_suppkey as string) as display_name,
                    cast(year(l_shipdate) as int) as year from lineitem""")
    return ingest.upsert_projects(projects, rows, [F.asc("year")])


CURSOR_RUNS = "select source || '_' || lang as source_name, 'c' || cast(max(doc_id) as string) as last_cursor, count(*) as entity_count, case when max(n_chars) > 5000 then 'partial' else 'ok' end as status from documents group by 1"


@query("cursor_write", f"""
    select coalesce(c.source_name, n.source_name) as source_name, coalesce(n.last_cursor, c.last_cursor) as last_cursor,
           coalesce(n.entity_count, c.entity_count) as entity_count, coalesce(n.status, c.status) as status
    from v_cursors c full join ({CURSOR_RUNS}) n on n.source_name = c.source_name""")
def _(s):
    from plinth.streaming.cursors import write_cursors
    cursors = s.cursors.select("source_name", "last_cursor", "entity_count", "status")
    return write_cursors(cursors, s.sql(CURSOR_RUNS))
