"""Detail joins, nested arrays and structured-data documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.operators import audit, detail
from plinth.plans.registry import query

ACTIVE = "publish_status = 'published' and merged_into is null"
PARTS = "cast(greatest(1, ceil(count({0}) / 1000.0)) as int)"


@query("firm_detail", f"""
    select f.id, {PARTS.format('p.id')} as parts, count(p.id) as members,
           coalesce(string_agg(p.id || ':' || p.display_name || ':' || m.role || ':' || m.is_current, ';' order by p.id), '') as people
    from v_firms f left join v_firm_people m on m.firm_id = f.id left join v_people p on p.id = m.person_id group by f.id""")
def _(s):
    line = lambda p: F.concat_ws(":", p["person_id"].cast("string"), p["name"], p["role"], p["is_current"].cast("string"))
    return detail.firm_detail(s.firms, s.firm_people, s.people).select(
        "id", "parts", F.size("people").cast("long").alias("members"),
        F.array_join(F.transform("people", line), ";").alias("people"))


@query("person_with_firm", """
    select p.id, p.display_name, f.display_name as firm_name, f.slug as firm_slug, f.sector as firm_sector
    from v_people p left join v_firms f on f.id = p.current_firm_id""")
def _(s):
    return detail.person_with_firm(s.people, s.firms).select(
        "id", "display_name", F.col("firm.display_name").alias("firm_name"), F.col("firm.slug").alias("firm_slug"),
        F.col("firm.sector").alias("firm_sector"))


@query("award_detail", f"""
    select a.id, {PARTS.format('r.award_id')} as parts, count(r.award_id) as recipients, count(f.id) as firms,
           count(p.id) as people, coalesce(sum(f.id), 0)::bigint as firm_ids, coalesce(sum(p.id), 0)::bigint as person_ids,
           count(r.project_name) as projects
    from v_awards a left join v_recipients r on r.award_id = a.id left join v_firms f on f.id = r.firm_id
    left join v_people p on p.id = r.person_id group by a.id""")
def _(s):
    total = lambda field: F.aggregate(
        "recipients", F.lit(0).cast("long"), lambda acc, r: acc + F.coalesce(r[field]["id"], F.lit(0)))
    filled = lambda get: F.size(F.filter("recipients", lambda r: get(r).isNotNull())).cast("long")
    return detail.award_detail(s.awards, s.recipients, s.firms, s.people).select(
        "id", "parts", F.size("recipients").cast("long").alias("recipients"),
        filled(lambda r: r["firm"]).alias("firms"), filled(lambda r: r["person"]).alias("people"),
        total("firm").alias("firm_ids"), total("person").alias("person_ids"),
        filled(lambda r: r["project_name"]).alias("projects"))


@query("entity_aliases_of", """
    select f.id, coalesce(string_agg(alias, ',' order by alias), '') as aliases
    from v_firms f left join v_aliases a on a.entity_id = f.id and a.entity_type = 'firm' group by f.id""")
def _(s):
    return detail.aliases_of(s.firms, s.aliases, "firm").select("id", F.array_join("aliases", ",").alias("aliases"))


for _kind, _owner in [("firm", "firm_id"), ("person", "person_id")]:
    query(f"{_kind}_awards_of", f"""
        select r.{_owner} as entity_id, r.award_id, r.year as received, r.project_name, a.award_name, a.year, a.prestige
        from v_recipients r join v_awards a on a.id = r.award_id where r.{_owner} is not null""")(
        lambda s, kind=_kind: detail.awards_of(s.recipients, s.awards, kind).select(
            "entity_id", "award_id", "received", "project_name", "award_name", "year", "prestige"))


@query("entity_sources_of", """
    with r as (select *, cast(row_number() over (partition by entity_type, entity_id order by created_at desc, source_id) as int) as place
               from v_entity_sources)
    select entity_type, entity_id, place, source_id, mention_type, source_name from r join v_sources s on s.id = r.source_id where place <= 20""")
def _(s):
    return detail.sources_of(s.entity_sources, s.sources).select(
        "entity_type", "entity_id", "place", "source_id", "mention_type", "source_name")


@query("entity_tags_of", """
    with r as (select e.entity_type, e.entity_id, t.slug, t.id as tag_id,
        cast(row_number() over (partition by e.entity_type, e.entity_id order by t.slug, t.id) as int) as place
        from v_entity_tags e join v_tags t on t.id = e.tag_id)
    select entity_type, entity_id, place, slug from r where place <= 10""")
def _(s):
    return detail.tags_of(s.entity_tags, s.tags).select("entity_type", "entity_id", "place", "slug")


FIRST_TAG = "select min(slug) as slug from v_tags where name like 'Tag %'"


@query("entities_for_tag", f"""
    with h as (select e.* from v_entity_tags e join v_tags t on t.id = e.tag_id where t.slug = ({FIRST_TAG}))
    select 'firm' as entity_type, id, display_name, cast(null as varchar) as firm_name from v_firms
    where {ACTIVE} and id in (select entity_id from h where entity_type = 'firm')
    union all
    select 'person', p.id, p.display_name, f.display_name from v_people p left join v_firms f on f.id = p.current_firm_id
    where p.publish_status = 'published' and p.id in (select entity_id from h where entity_type = 'person')""")
def _(s):
    return detail.entities_for_tag(s.sql(FIRST_TAG).scalar(), s.tags, s.entity_tags, s.firms, s.people)


@query("canonical_targets", """
    select m.id, m.slug, m.merged_into, t.slug as target_slug,
           case t.sector when 'multidisciplinary' then 'technology' else t.sector end as target_sector
    from v_firms m left join v_firms t on t.id = m.merged_into where m.merged_into is not null""")
def _(s):
    return detail.canonical_targets(s.firms).select("id", "slug", "merged_into", "target_slug", "target_sector")


@query("dangling_merges", """
    select id, display_name, merged_into from v_firms where merged_into is not null and merged_into not in (select id from v_firms)""")
def _(s):
    return audit.dangling_merges(s.firms)


@query("unlinked_published", f"""
    select id, display_name from v_firms where {ACTIVE}
    and id not in (select entity_id from v_entity_sources where entity_type = 'firm')""")
def _(s):
    return audit.unlinked_firms(s.firms, s.entity_sources).select("id", "display_name")


@query("review_context", """
    with n as (select 'firm' as t, id, display_name as name, concat_ws(', ', nullif(city, ''), nullif(country, '')) as place from v_firms
               union all select 'person', id, display_name, '' from v_people)
    select r.id, r.candidate_name, coalesce(n.name || ' (' || coalesce(nullif(n.place, ''), 'no location') || ')', 'none') as suggested
    from v_review r left join n on n.t = r.entity_type and n.id = r.suggested_entity_id""")
def _(s):
    return detail.review_context(s.review, s.firms, s.people).select("id", "candidate_name", "suggested")


@query("source_context", """
    with r as (select *, row_number() over (partition by entity_type, entity_id order by source_id) as place from v_entity_sources)
    select entity_type, entity_id, md5('Mentioned in: ' || string_agg(title, '; ' order by source_id)) as context
    from r join v_sources s on s.id = r.source_id where place <= 5 and title <> '' group by 1, 2""")
def _(s):
    return detail.source_context(s.entity_sources, s.sources).select("entity_type", "entity_id", F.md5("context").alias("context"))


@query("multi_entity_sources", """
    with m as (select *, count(*) over (partition by source_id) as n from v_entity_sources),
    e as (select 'firm' as entity_type, id, display_name as name from v_firms union all select 'person', id, display_name from v_people),
    j as (select m.source_id, m.entity_type, m.entity_id, e.name, count(*) over (partition by m.source_id) as again
          from m join v_sources s on s.id = m.source_id join e on e.entity_type = m.entity_type and e.id = m.entity_id where m.n >= 2)
    select source_id, entity_type, entity_id, name from j where again >= 2""")
def _(s):
    return detail.multi_entity_sources(s.entity_sources, s.sources, s.firms, s.people).select(
        "source_id", "entity_type", "entity_id", "name")


EDUCATION = """
    select l_partkey as person_id, 'School ' || cast(l_suppkey as string) as institution_name,
           case when l_linenumber % 3 = 0 then cast(null as string) else 'Degree ' || l_returnflag end as degree,
           case when l_linenumber % 2 = 0 then cast(null as int) else cast(year(l_shipdate) as int) end as start_year,
           l_orderkey * 10 + l_linenumber as pos
    from lineitem"""


@query("person_education", f"""
    with d as (select *, row_number() over (partition by person_id, institution_name, coalesce(degree, '') order by pos) as rn from ({EDUCATION}))
    select person_id, institution_name, degree, start_year, cast(row_number() over (
        partition by person_id order by start_year desc nulls first, institution_name, degree nulls first) as int) as place
    from d where rn = 1""")
def _(s):
    from plinth.operators.ingest import upsert_education
    stored = upsert_education(None, s.sql(EDUCATION), [F.asc("pos")])
    return detail.person_education(stored).select("person_id", "institution_name", "degree", "start_year", "place")


_AWARDS_LIST = "(select {0} as id, list(a.award_name order by a.id) as won from v_recipients r join v_awards a on a.id = r.award_id where {0} is not null group by 1)"


@query("firm_json_ld", f"""
    with al as (select entity_id as id, list(alias order by alias) as aliases from v_aliases where entity_type = 'firm' group by 1),
    aw as {_AWARDS_LIST.format('r.firm_id')},
    mem as (select firm_id as id, list({{'@type': 'Person', 'name': p.display_name, 'jobTitle': m.role}} order by p.id) as members
            from v_firm_people m join v_people p on p.id = m.person_id group by 1)
    select f.id, cast(json_merge_patch('{{}}'::json, to_json({{'@context': 'https://schema.org', '@type': 'Organization',
        'name': display_name, 'alternateName': aliases, 'url': nullif(website, ''),
        'sameAs': case when website <> '' then [website] end, 'description': nullif(short_description, ''),
        'address': case when concat_ws(', ', nullif(city, ''), nullif(country, '')) <> ''
            then {{'@type': 'PostalAddress', 'addressLocality': nullif(city, ''), 'addressCountry': nullif(country, '')}} end,
        'foundingDate': cast(founded_year as varchar), 'member': members, 'award': won, 'knowsAbout': sector}})) as varchar) as json_ld
    from v_firms f left join al on al.id = f.id left join aw on aw.id = f.id left join mem on mem.id = f.id where {ACTIVE}""")
def _(s):
    return detail.firm_json_ld(s.firms, s.firm_people, s.people, s.aliases, s.recipients, s.awards).select("id", "json_ld")


@query("person_json_ld", f"""
    with al as (select entity_id as id, list(alias order by alias) as aliases from v_aliases where entity_type = 'person' group by 1),
    aw as {_AWARDS_LIST.format('r.person_id')}
    select p.id, cast(json_merge_patch('{{}}'::json, to_json({{'@context': 'https://schema.org', '@type': 'Person',
        'name': p.display_name, 'alternateName': aliases, 'description': nullif(bio, ''), 'jobTitle': nullif(role, ''),
        'nationality': nullif(nationality, ''),
        'worksFor': case when f.id is not null then {{'@type': 'Organization', 'name': f.display_name, 'url': nullif(f.website, '')}} end,
        'award': won, 'knowsAbout': p.sector}})) as varchar) as json_ld
    from v_people p left join v_firms f on f.id = p.current_firm_id left join al on al.id = p.id left join aw on aw.id = p.id
    where p.publish_status = 'published'""")
def _(s):
    return detail.person_json_ld(s.people, s.firms, s.aliases, s.recipients, s.awards).select("id", "json_ld")


@query("award_json_ld", """
    select id, cast(json_merge_patch('{}'::json, to_json({'@context': 'https://schema.org', '@type': 'CreativeWork', 'name': award_name,
        'creator': case when organization <> '' then {'@type': 'Organization', 'name': organization} end,
        'dateCreated': cast(year as varchar), 'genre': category})) as varchar) as json_ld from v_awards""")
def _(s):
    return detail.award_json_ld(s.awards)
