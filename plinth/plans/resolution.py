"""Similarity joins, matching stages, resolution and mentions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plinth.operators import audit, resolve, simindex, simjoin
from plinth.plans import sqlparts as sp
from plinth.plans.registry import query
from plinth.session import checkpoint_root

LIVE = "merged_into is null"

# Names to resolve: variants of known names, and names nobody knows yet.
CANDIDATES = """
    select p_partkey as pos,
           case p_partkey % 7 when 0 then upper(p_name) || ', Inc.'
                when 1 then substr(p_name, 1, 1) || substr(split_part(p_name, ' ', 2), 1, 1)
                when 2 then p_name || 's' when 3 then p_name || ' junior' when 4 then 'The ' || p_name || ' collective'
                when 5 then p_brand || ' ' || p_name else p_type || ' of ' || p_brand end as name,
           case when p_partkey % 27 < 2 then 'Q' || cast(p_partkey - p_partkey % 27 as string) end as wikidata_id
    from part
    union all
    select 1000000000 + s_suppkey, s_name || ' & Co', cast(null as string) from supplier"""


def _outcomes(rows: str, trigram: bool = True) -> str:
    """CTEs that give `o`: per normalised name of `rows` the stage, target and similarity, by brute force."""
    near = f"""
    sims as (select n.normalized, t.id, {sp.jaccard('n.g', 't.g')} as sim
             from (select normalized, {sp.trigrams('normalized')} as g from st where exact_id is null and alias_id is null) n,
                  (select min(id) as id, canonical_name, {sp.trigrams('canonical_name')} as g from v_people group by canonical_name) t),
    near as (select normalized, max(sim) as sim, arg_min(id, (-sim, id)) as near_id from sims where sim >= 0.6 group by normalized)"""
    none = "near as (select cast(null as varchar) as normalized, cast(null as double) as sim, cast(null as bigint) as near_id where false)"
    return f"""
    nm as (select *, {sp.normalize('name')} as normalized from ({rows})),
    ex as (select canonical_name, min(id) as exact_id from v_people group by 1),
    al as (select alias_normalized, min(entity_id) as alias_id from v_aliases where entity_type = 'person' group by 1),
    st as (select distinct nm.normalized, exact_id, alias_id from nm left join ex on canonical_name = normalized
           left join al on alias_normalized = normalized),
    {near if trigram else none},
    o as (select st.normalized, case when exact_id is not null then 'exact' when alias_id is not null then 'alias'
            when sim >= 0.85 then 'trigram' when sim >= 0.6 then 'review' else 'new' end as match_type,
            coalesce(exact_id, alias_id, near_id) as target_id, sim from st left join near on near.normalized = st.normalized)"""


_RESULT = f"""
    case when match_type in ('trigram', 'review') then round(sim, 6) when match_type = 'new' then 0.0 else 1.0 end as confidence,
    case when match_type = 'new' then sha256('person|' || {sp.slug('normalized')}) when match_type <> 'review' then cast(target_id as varchar) end as entity_id,
    case when match_type = 'review' then cast(target_id as varchar) end as suggested_id"""


def _shown(df):
    return df.select("pos", "match_type", F.round("confidence", 6).alias("confidence"), "entity_id", "suggested_id")


RESOLVED = f"""
    with {_outcomes(CANDIDATES)},
    r as (select nm.pos, nm.normalized, case when w.id is not null then 'wikidata' else o.match_type end as match_type,
                 coalesce(w.id, o.target_id) as target_id, o.sim
          from nm join o on o.normalized = nm.normalized
          left join (select wikidata_id, min(id) as id from v_people where wikidata_id is not null group by 1) w on w.wikidata_id = nm.wikidata_id)
    select pos, match_type, {_RESULT} from r"""


@query("resolve_people", RESOLVED)
def _(s):
    return _shown(resolve.resolve(s.sql(CANDIDATES), s.people, s.aliases, "person", id_column="wikidata_id"))


def _name_index(s):
    """The names of published people, with those of the others filed later."""
    people = s.people
    index = simindex.build(people.where("publish_status = 'published'"), "canonical_name", f"{checkpoint_root(s.spark)}/names-{uuid.uuid4().hex}", 0.5)
    index.extend(people, "canonical_name")
    return index


@query("resolve_people_indexed", RESOLVED)
def _(s):
    return _shown(resolve.resolve(s.sql(CANDIDATES), s.people, s.aliases, "person", id_column="wikidata_id", index=_name_index(s)))


@query("similar_names_indexed", f"""
    with a as (select name, {sp.trigrams('name')} as g from (select distinct {sp.normalize('name')} as name from ({CANDIDATES}))),
    b as (select canonical_name, {sp.trigrams('canonical_name')} as g from (select distinct canonical_name from v_people))
    select name as left_name, canonical_name as right_name, round({sp.jaccard('a.g', 'b.g')}, 6) as sim
    from a, b where {sp.jaccard('a.g', 'b.g')} > 0.5""")
def _(s):
    from plinth.functions.text import normalize_name
    index = _name_index(s).compact(f"{checkpoint_root(s.spark)}/names-{uuid.uuid4().hex}")
    return index.pairs(s.sql(CANDIDATES).select(normalize_name("name").alias("name")), "name", 0.5).withColumn("sim", F.round("sim", 6))


@query("resolve_simple", f"""
    with {_outcomes(CANDIDATES, trigram=False)}
    select nm.pos, o.match_type, {_RESULT} from nm join o using (normalized)""")
def _(s):
    return _shown(resolve.resolve_simple(s.sql(CANDIDATES), s.people, s.aliases, "person"))


# Names without a match in order of their first row, each with its earlier neighbours; a walk over them carries
# those that create an entity. Every row then takes the best of what is known and of the creators before it.
IN_ORDER = f"""
    with recursive {_outcomes(CANDIDATES)},
    firsts as (select normalized, min(pos) as first from nm group by 1),
    open as materialized (select o.*, first, {sp.trigrams('o.normalized')} as g from o join firsts using (normalized) where match_type in ('trigram', 'review', 'new')),
    fresh as materialized (select normalized, first, g, row_number() over (order by first) as i from open where match_type = 'new'),
    forms as (select normalized as seen, i, first, unnest({sp.aliases('normalized')}) as alias from fresh),
    called as materialized (select distinct seen, i, first, {sp.normalize('alias')} as seer from forms),
    alike as materialized (select f.i, e.i as j from fresh f join fresh e on e.i < f.i and ({sp.jaccard('f.g', 'e.g')} >= 0.6
              or exists (select 1 from called c where c.i = e.i and c.seer = f.normalized))),
    neighbours as materialized (select fresh.i, coalesce(list(j) filter (where j is not null), []) as js from fresh left join alike on alike.i = fresh.i group by fresh.i),
    walk as (select 0::bigint as i, []::bigint[] as made
             union all select n.i, case when list_has_any(made, js) then made else list_append(made, n.i) end from walk join neighbours n on n.i = walk.i + 1),
    made as materialized (select fresh.*, sha256('person|' || {sp.slug('normalized')}) as target_id from fresh
             where list_contains((select made from walk order by i desc limit 1), i)),
    options as materialized (
        select o.normalized, m.first as since, 0 as kind, m.first::double as rank, m.target_id, cast(null as double) as sim
        from open o join called c on c.seer = o.normalized and c.seen <> o.normalized join made m on m.i = c.i
        union all
        select o.normalized, m.first, 1, -{sp.jaccard('o.g', 'm.g')}, m.target_id, {sp.jaccard('o.g', 'm.g')}
        from open o join made m on m.normalized <> o.normalized and {sp.jaccard('o.g', 'm.g')} >= 0.6
        union all
        select normalized, -1, 1, -sim, cast(target_id as varchar), sim from open where target_id is not null),
    best as (select nm.pos, arg_min({{'kind': kind, 'target_id': p.target_id, 'sim': p.sim}}, (kind, rank, p.target_id)) as b
             from nm join options p on p.normalized = nm.normalized and p.since < nm.pos group by nm.pos),
    r as (select nm.pos, nm.normalized,
                 case when o.match_type in ('exact', 'alias') then o.match_type when m.first = nm.pos then 'new' when m.i is not null then 'exact'
                      when b.kind = 0 then 'alias' when b.sim >= 0.85 then 'trigram' else 'review' end as match_type,
                 case when o.match_type in ('exact', 'alias') then cast(o.target_id as varchar) when m.i is not null then m.target_id else b.target_id end as target_id,
                 b.sim as sim
          from nm join o on o.normalized = nm.normalized left join made m on m.normalized = nm.normalized left join best on best.pos = nm.pos)
    select pos, match_type, {_RESULT} from r"""


@query("resolve_batch", IN_ORDER)
def _(s):
    return _shown(resolve.resolve_batch(s.sql(CANDIDATES), s.people, s.aliases, "person"))


@query("resolve_reviews", f"""
    with {_outcomes(CANDIDATES)}
    select nm.name as candidate_name, 'person' as entity_type, cast(target_id as varchar) as suggested_entity_id, round(sim, 6) as confidence
    from nm join o on o.normalized = nm.normalized where match_type = 'review'""")
def _(s):
    resolved = resolve.resolve(s.sql(CANDIDATES), s.people, s.aliases, "person")
    return resolve.to_review(resolved, "person").select(
        "candidate_name", "entity_type", "suggested_entity_id", F.round("confidence", 6).alias("confidence"))


@query("match_by_id", """
    select c.pos, w.id as matched_id from (select pos, wikidata_id from (""" + CANDIDATES + """)) c
    left join (select wikidata_id, min(id) as id from v_people where wikidata_id is not null group by 1) w on w.wikidata_id = c.wikidata_id""")
def _(s):
    return resolve.match_id(s.sql(CANDIDATES), s.people).select("pos", "matched_id")


FIRM_NAMES = "select c_custkey as pos, lower(c_mktsegment) || ' works ' || cast(c_custkey + 7 as string) as normalized from customer"


@query("match_exact", f"""
    select n.pos, e.id as exact_id from ({FIRM_NAMES}) n
    left join (select canonical_name, min(id) as id from v_firms where {LIVE} group by 1) e on e.canonical_name = n.normalized""")
def _(s):
    return resolve.match_exact(s.sql(FIRM_NAMES), s.firms, "firm").select("pos", "exact_id")


ALIAS_NAMES = "select c_custkey as pos, 'w' || cast(c_custkey as string) as normalized from customer"


@query("match_alias", f"""
    select n.pos, a.entity_id as alias_id, coalesce(f.merged_into, a.entity_id) as followed_id from ({ALIAS_NAMES}) n
    left join (select alias_normalized, min(entity_id) as entity_id from v_aliases where entity_type = 'firm' group by 1) a
    on a.alias_normalized = n.normalized left join v_firms f on f.id = a.entity_id""")
def _(s):
    names = s.sql(ALIAS_NAMES)
    followed = resolve.match_alias(names, s.aliases, "firm", merges=s.firms).withColumnRenamed("alias_id", "followed_id")
    return resolve.match_alias(names, s.aliases, "firm").select("pos", "normalized", "alias_id").join(
        followed.select("pos", "followed_id"), "pos").select("pos", "alias_id", "followed_id")


@query("not_known", f"""
    select pos, normalized as canonical_name from ({FIRM_NAMES})
    where normalized not in (select canonical_name from v_firms where {LIVE})
    and normalized not in (select alias_normalized from v_aliases where entity_type = 'firm')""")
def _(s):
    names = s.sql(FIRM_NAMES).withColumnRenamed("normalized", "canonical_name")
    return resolve.not_known(names, s.firms, s.aliases, "firm").select("pos", "canonical_name")


@query("not_in_by_id", """
    select o_orderkey as pos, 'Q' || cast(o_orderkey as varchar) as wikidata_id from orders
    where 'Q' || cast(o_orderkey as varchar) not in (select wikidata_id from v_people where wikidata_id is not null)""")
def _(s):
    rows = s.sql("select o_orderkey as pos, 'Q' || cast(o_orderkey as string) as wikidata_id from orders")
    return resolve.not_in_by_id(rows, s.people).select("pos", "wikidata_id")


@query("match_trigram_top5", f"""
    with n as (select distinct {sp.normalize('name')} as name from ({CANDIDATES})),
    a as (select name, {sp.trigrams('name')} as g from n),
    t as (select canonical_name, list(id order by id)[1:5] as ids, {sp.trigrams('canonical_name')} as g from v_people group by canonical_name),
    p as (select name, canonical_name, ids, {sp.jaccard('a.g', 't.g')} as sim from a, t),
    u as (select name, canonical_name, sim, unnest(ids) as id from p where sim > 0.5),
    r as (select *, cast(row_number() over (partition by name order by sim desc, id) as int) as place from u)
    select name, id, canonical_name, round(sim, 6) as sim, place from r where place <= 5""")
def _(s):
    from plinth.functions.text import normalize_name
    names = s.sql(CANDIDATES).select(normalize_name("name").alias("name"))
    return simjoin.match_trigram(names, s.people, "name").withColumn("sim", F.round("sim", 6))


@query("best_match", f"""
    with n as (select distinct {sp.normalize('name')} as name from ({CANDIDATES})),
    a as (select name, {sp.trigrams('name')} as g from n),
    t as (select canonical_name, min(id) as id, {sp.trigrams('canonical_name')} as g from v_people group by canonical_name),
    p as (select name, id, {sp.jaccard('a.g', 't.g')} as sim from a, t)
    select name, arg_min(id, (-sim, id)) as id, round(max(sim), 6) as sim from p where sim >= 0.6 group by name""")
def _(s):
    from plinth.functions.text import normalize_name
    names = s.sql(CANDIDATES).select(normalize_name("name").alias("name"))
    return simjoin.best_match(names, s.people, "name").withColumn("sim", F.round("sim", 6))


PART_PAIRS = f"""
    with a as (select distinct p_name as name, {sp.trigrams('p_name')} as g from part)
    select x.name as left_name, y.name as right_name, round({sp.jaccard('x.g', 'y.g')}, 6) as sim
    from a x, a y where x.name < y.name and {sp.jaccard('x.g', 'y.g')} > """


@query("similar_part_names", PART_PAIRS + "0.5")
def _(s):
    return simjoin.similar_pairs_within(s.base("part"), 0.5, "p_name").withColumn("sim", F.round("sim", 6))


@query("similar_part_names_loose", PART_PAIRS + "0.3")
def _(s):
    return simjoin.similar_pairs_within(s.base("part"), 0.3, "p_name").withColumn("sim", F.round("sim", 6))


TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query("similar_page_titles", f"""
    with a as (select distinct {TITLE} as name from pages), g as (select name, {sp.trigrams('name')} as g from a)
    select x.name as left_name, y.name as right_name, round({sp.jaccard('x.g', 'y.g')}, 6) as sim
    from g x, g y where x.name < y.name and {sp.jaccard('x.g', 'y.g')} > 0.3""")
def _(s):
    titles = s.sql(f"select {TITLE} as name from pages")
    return simjoin.similar_pairs_within(titles, 0.3, "name").withColumn("sim", F.round("sim", 6))


@query("documents_like_page_titles", f"""
    with d as (select distinct unnest(string_split(text, chr(10))) as name from documents), p as (select distinct {TITLE} as name from pages),
    a as (select name, {sp.trigrams('name')} as g from d), b as (select name, {sp.trigrams('name')} as g from p)
    select a.name as left_name, b.name as right_name, round({sp.jaccard('a.g', 'b.g')}, 6) as sim
    from a, b where {sp.jaccard('a.g', 'b.g')} > 0.3""")
def _(s):
    lines, titles = s.sql("select distinct explode(split(text, '\\n')) as line from documents"), s.sql(f"select {TITLE} as title from pages")
    return simjoin.similar_pairs(lines, titles, 0.3, "line", "title").withColumn("sim", F.round("sim", 6))


@query("title_mentions", f"""
    with w as (select lower(unnest(string_split({TITLE}, ' '))) as canonical_name, page_id as id from pages),
    f as (select canonical_name, min(id) as id from w where length(canonical_name) >= 5 group by 1),
    m as (select distinct doc_id, f.id, f.canonical_name from documents, f where contains(lower(text), canonical_name))
    select doc_id, id, canonical_name from m""")
def _(s):
    pages = s.sql(f"select page_id as id, {TITLE} as title from pages")
    names = pages.select("id", F.explode(F.split("title", " ")).alias("w")).select("id", F.lower("w").alias("canonical_name"))
    return simjoin.match_mentions(s.base("documents"), names, "doc_id", "text")


@query("adjacent_duplicates", f"""
    with n as (select id, display_name, canonical_name, lead(id) over w as next_id, lead(canonical_name) over w as next_name,
                      lead(display_name) over w as next_display_name
               from v_firms where publish_status = 'published' and {LIVE} window w as (order by canonical_name, id)),
    r as (select *, {sp.jaccard(sp.trigrams('canonical_name'), sp.trigrams('next_name'))} as ratio from n
          where next_id is not null and canonical_name <> next_name)
    select id, display_name, next_id, next_display_name, round(ratio, 6) as ratio from r where ratio > 0.8""")
def _(s):
    return audit.adjacent_duplicates(s.firms, 0.8).withColumn("ratio", F.round("ratio", 6))
