"""Search queries with brute-force oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plinth.functions.fulltext import STOP_WORDS
from plinth.operators import search, searchindex
from plinth.plans import sqlparts as sp
from plinth.plans.registry import query
from plinth.session import checkpoint_root, write_once

SEARCHES = """
    select min(p_partkey) as query_id, ' ' || upper(p_name) || ' ' as query, cast(null as string) as sector, cast(null as string) as country
    from part group by p_name
    union all
    select 1000000 + min(c_custkey), lower(c_mktsegment) || ' works', cast(null as string),
           case when c_mktsegment < 'F' then 'NATION_9' when c_mktsegment < 'I' then 'de' end from customer group by c_mktsegment
    union all
    select 2000000 + min(p_partkey), lower(p_type) || ' award', 'design', cast(null as string) from part group by p_type
    union all
    select 3000000 + s_nationkey, substr(md5(min(s_name)), 1, 9), cast(null as string), cast(null as string) from supplier group by s_nationkey
    union all
    select 4000000 + n_nationkey, 'the ' || n_name || ' trade', cast(null as string), cast(null as string) from nation
    union all select 5000000 + r_regionkey, '   ', cast(null as string), cast(null as string) from region"""

WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
STOPS = f"[{sp.values(STOP_WORDS)}]"


def _base(people_bio: bool = True) -> str:
    """CTEs for all pairs: q (queries), e (entities), s (name similarity), fr (text rank), al, tg."""
    return f"""
    q as (select query_id, lower(trim(query)) as q, sector as q_sector, country as q_country, {sp.trigrams('lower(trim(query))')} as qg,
          list_distinct(list_filter({WORDS.format('query')}, lambda w: not list_contains({STOPS}, w))) as qw
          from ({SEARCHES}) where trim(query) <> ''),
    e as (select 'firm' as entity_type, id, slug, display_name, canonical_name, sector, country, country_code, short_description
          from v_firms where publish_status = 'published' and merged_into is null
          union all select 'person', id, slug, display_name, canonical_name, sector, null, null, bio from v_people where publish_status = 'published'),
    nm as (select canonical_name, {sp.trigrams('canonical_name')} as g from (select distinct canonical_name from e)),
    ns as (select query_id, canonical_name, {sp.jaccard('qg', 'g')} as sim from q, nm),
    tk as (select entity_type, id, unnest(w) as word, generate_subscripts(w, 1) as pos from (
           select entity_type, id, {WORDS.format("coalesce(display_name, '') || ' ' || coalesce(short_description, '')")} as w from e)),
    qx as (select query_id, len(qw) as nq, unnest(qw) as word from q),
    h as (select query_id, nq, entity_type, id, pos, tk.word from tk join qx on qx.word = tk.word),
    md as (select query_id, entity_type, id from h group by all having count(distinct word) = max(nq)),
    hm as (select h.* from h join md using (query_id, entity_type, id)),
    lastpos as (select a.query_id, a.entity_type, a.id, a.nq, a.pos as fin, b.word, max(b.pos) as lp
           from hm a join hm b on a.query_id = b.query_id and a.entity_type = b.entity_type and a.id = b.id and b.pos <= a.pos group by all),
    cov as (select query_id, entity_type, id, fin, min(lp) as start from lastpos group by query_id, entity_type, id, fin having count(*) = max(nq)),
    mc as (select query_id, entity_type, id, start, min(fin) as fin from cov group by all),
    fr as (select mc.query_id, mc.entity_type, mc.id, sum(d) as fts from (
           select mc.query_id, mc.entity_type, mc.id, 0.1 / (1 + mc.fin - mc.start - (count(*) - 1)) as d
           from mc join hm on hm.query_id = mc.query_id and hm.entity_type = mc.entity_type and hm.id = mc.id and hm.pos between mc.start and mc.fin
           group by mc.query_id, mc.entity_type, mc.id, mc.start, mc.fin) mc group by all)"""


TAGGED = f"""
    tg as (select distinct query_id, et.entity_type, et.entity_id as id from q
           join (select id, slug, {sp.trigrams('slug')} as g from v_tags) t on {sp.jaccard('qg', 't.g')} > 0.3
           join v_entity_tags et on et.tag_id = t.id),
    al as (select query_id, entity_type, entity_id as id, max({sp.jaccard('qg', 'g')}) as alias_sim from q,
           (select entity_type, entity_id, {sp.trigrams('alias_normalized')} as g from v_aliases) group by 1, 2, 3)"""


SEARCHED = f"""
    with {_base()}, {TAGGED},
    j as (select q.query_id, e.entity_type, e.id, e.display_name,
                 greatest(ns.sim * 2.0, coalesce(al.alias_sim * 1.5, 0), coalesce(fr.fts, 0), case when tg.id is not null then 0.4 else 0 end) as rank
          from q join e on (q_sector is null or e.sector = q_sector)
               and (q_country is null or e.entity_type = 'person' or e.country = q_country or e.country_code = upper(q_country))
          join ns on ns.query_id = q.query_id and ns.canonical_name = e.canonical_name
          left join al on al.query_id = q.query_id and al.entity_type = e.entity_type and al.id = e.id
          left join fr on fr.query_id = q.query_id and fr.entity_type = e.entity_type and fr.id = e.id
          left join tg on tg.query_id = q.query_id and tg.entity_type = e.entity_type and tg.id = e.id
          where ns.sim > 0.35 or coalesce(al.alias_sim, 0) > 0.35 or tg.id is not null or fr.id is not null),
    r as (select *, cast(row_number() over (partition by query_id, entity_type order by round(rank, 9) desc, id) as int) as place from j)
    select query_id, entity_type, id, display_name, round(rank, 6) as rank, place from r where place <= 12"""


@query("search_directory", SEARCHED)
def _(s):
    entities = search.searchable(s.firms, s.people)
    found = search.search(s.sql(SEARCHES), entities, s.aliases, s.tags, s.entity_tags)
    return found.select("query_id", "entity_type", "id", "display_name", F.round("rank", 6).alias("rank"), "place")


def _indexed(s, extended: bool = False):
    """A search index of the directory; `extended` files the firms of one sector later, as a second segment."""
    entities = write_once(search.searchable(s.firms, s.people))
    first = entities.where("sector <> 'design'") if extended else entities
    index = searchindex.build(first, s.aliases, s.tags, f"{checkpoint_root(s.spark)}/search-{uuid.uuid4().hex}")
    if extended:
        index.extend(entities, s.aliases, s.tags)
        index.extend(entities)
    return index


def _found(s, index):
    found = index.search(s.sql(SEARCHES), s.aliases, s.tags, s.entity_tags)
    return found.select("query_id", "entity_type", "id", "display_name", F.round("rank", 6).alias("rank"), "place")


@query("search_indexed", SEARCHED)
def _(s):
    return _found(s, _indexed(s))


@query("search_extended_index", SEARCHED)
def _(s):
    return _found(s, _indexed(s, extended=True))


@query("index_words", f"""
    with {_base()} select entity_type, word, count(distinct id) as n, max(c) as most from (
        select entity_type, id, word, count(*) as c from tk where not list_contains({STOPS}, word) group by all) group by entity_type, word""")
def _(s):
    index = _indexed(s, extended=True)
    most = index.postings().groupBy("entity_type", "word").agg(F.max("most").cast("long").alias("most"))
    return index.words().join(most, ["entity_type", "word"])


@query("search_v1", f"""
    with {_base()},
    j as (select q.query_id, e.entity_type, e.id, e.display_name, greatest(ns.sim, coalesce(fr.fts, 0)) as rank
          from q join e on (q_sector is null or e.sector = q_sector) and (q_country is null or e.entity_type = 'person' or e.country = q_country)
          join ns on ns.query_id = q.query_id and ns.canonical_name = e.canonical_name
          left join fr on fr.query_id = q.query_id and fr.entity_type = e.entity_type and fr.id = e.id
          where ns.sim > 0.2 or fr.id is not null),
    r as (select *, cast(row_number() over (partition by query_id, entity_type order by round(rank, 9) desc, id) as int) as place from j)
    select query_id, entity_type, id, display_name, round(rank, 6) as rank, place from r where place <= 12""")
def _(s):
    found = search.search_v1(s.sql(SEARCHES), search.searchable(s.firms, s.people))
    return found.select("query_id", "entity_type", "id", "display_name", F.round("rank", 6).alias("rank"), "place")


@query("text_hits_and_ranks", f"""
    with {_base()} select query_id, entity_type, id, round(fts, 6) as fts from fr""")
def _(s):
    from plinth.functions.fulltext import fts_rank
    entities, asked = search.searchable(s.firms, s.people), search.prepared(s.sql(SEARCHES))
    hits = search.text_hits(asked, entities).join(asked, "query_id").join(entities, ["entity_type", "id"])
    rank = fts_rank(F.col("text_lexemes"), F.col("q_words"))
    return hits.select("query_id", "entity_type", "id", F.round(rank, 6).alias("fts"))


@query("tag_match", f"with {_base()}, {TAGGED} select query_id, entity_type, id from tg")
def _(s):
    return search.tag_hits(search.prepared(s.sql(SEARCHES)), s.tags, s.entity_tags)


@query("alias_best_sim", f"""
    with {_base()}, {TAGGED} select al.query_id, al.entity_type, al.id, round(alias_sim, 6) as alias_sim
    from al join md on md.query_id = al.query_id and md.entity_type = al.entity_type and md.id = al.id""")
def _(s):
    entities, asked = search.searchable(s.firms, s.people), search.prepared(s.sql(SEARCHES))
    admitted = search.text_hits(asked, entities).join(asked, "query_id")
    return search.alias_best_sim(admitted, s.aliases).withColumn("alias_sim", F.round("alias_sim", 6))
