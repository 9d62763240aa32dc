"""Results of an enrichment run applied to the directory, all tables in one shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators import enrichment
from plinth.plans import sqlparts as sp
from plinth.plans.registry import query

# A result for each order: of its customer, some blank, some failed; names stand between semicolons.
RESULTS = """select o_orderkey as pos, cast(o_custkey as string) as entity_id,
    case when o_orderstatus = 'O' then '' else 'Found by order ' || cast(o_orderkey as string) end as summary,
    'House ' || cast(o_custkey as string) || ';x;W' || cast(o_custkey + 1 as string) as aliases,
    'Tag ' || o_orderpriority || ';unused-germany;' || lower(o_orderstatus) as tags,
    case when o_totalprice < 100000 then 'timeout' end as error from orders"""
ROUNDED = {
    "entities": "select 'entities' as kind, id as name, short_description as first, cast(null as string) as second from {0}",
    "aliases": "select 'aliases' as kind, alias_normalized as name, entity_id as first, alias as second from {0}",
    "tags": "select 'tags' as kind, slug as name, name as first, id as second from {0}",
    "entity_tags": "select 'links' as kind, entity_id as name, entity_type as first, tag_id as second from {0}",
    "queue": "select 'queue' as kind, cast(id as string) as name, status as first, last_error as second from {0}",
}


@query("enrichment_tables", f"""
    with r as ({RESULTS}), ok as (select * from r where error is null),
    told as (select entity_id, arg_min(summary, pos) as summary from ok where summary <> '' group by 1),
    entities as (select cast(f.id as varchar) as id, case when coalesce(f.short_description, '') <> '' then f.short_description else coalesce(summary, f.short_description) end as short_description
        from v_firms f left join told on told.entity_id = cast(f.id as varchar)),
    claimed as (select entity_id, pos, alias, {sp.normalize('alias')} as n from (select entity_id, pos, unnest(string_split(aliases, ';')) as alias from ok)),
    owners as (select n, arg_max(entity_id, pos) as entity_id, arg_max(alias, pos) as alias from claimed where length(n) >= 2 group by n),
    old as (select cast(min(entity_id) as varchar) as entity_id, alias_normalized, min(alias) as alias from v_aliases where entity_type = 'firm' group by alias_normalized),
    aliases as (select coalesce(owners.n, old.alias_normalized) as alias_normalized, coalesce(owners.entity_id, old.entity_id) as entity_id, coalesce(owners.alias, old.alias) as alias
        from old full join owners on owners.n = old.alias_normalized),
    meant as (select *, {sp.normalize('name')} as n from (select entity_id, pos, unnest(string_split(tags, ';')) as name from ok)),
    spelled as (select n, arg_max(name, pos) as name from meant where length(n) >= 2 group by n),
    known as (select slug, min(cast(id as varchar)) as id from v_tags group by slug),
    minted as (select n as slug, name, coalesce(known.id, sha256('tag|' || n)) as id from spelled left join known on known.slug = n),
    tags as (select coalesce(t.slug, m.slug) as slug, coalesce(m.name, t.name) as name, coalesce(cast(t.id as varchar), m.id) as id from v_tags t full join minted m on m.slug = t.slug),
    entity_tags as (select cast(entity_id as varchar) as entity_id, entity_type, cast(tag_id as varchar) as tag_id from v_entity_tags
        union select entity_id, 'firm', minted.id from meant join minted on minted.slug = meant.n),
    outcomes as (select entity_id, bool_or(error is null) as ok, arg_max(error, pos) as error from r group by 1),
    queue as (select q.id, case when q.status = 'pending' and q.entity_type = 'firm' and o.ok then 'done' when q.status = 'pending' and q.entity_type = 'firm' and not o.ok then 'failed' else q.status end as status,
        case when q.status = 'pending' and q.entity_type = 'firm' and not o.ok then o.error end as last_error
        from v_queue q left join outcomes o on o.entity_id = cast(q.entity_id as varchar))
    {' union all '.join(shape.format(table) for table, shape in ROUNDED.items())}""")
def _(s):
    text = lambda df, *names: df.withColumns({n: F.col(n).cast("string") for n in names})
    results = s.sql(RESULTS).withColumns({"aliases": F.split("aliases", ";"), "tags": F.split("tags", ";")})
    aliases = s.sql("select min(entity_id) as entity_id, entity_type, min(alias) as alias, alias_normalized from v_aliases where entity_type = 'firm' group by entity_type, alias_normalized")
    queue = text(s.queue, "entity_id").withColumns({"last_error": F.lit(None).cast("string"), "enriched_at": F.lit(None).cast("string")})
    out = enrichment.apply_enrichment(
        text(s.firms, "id"), text(aliases, "entity_id"), text(s.tags, "id"), text(s.entity_tags, "entity_id", "tag_id"), queue, results, "firm", F.lit("now"))
    return reduce(DataFrame.unionByName, [s.spark.sql(shape.format("{rows}"), rows=out[t]) for t, shape in ROUNDED.items()])
