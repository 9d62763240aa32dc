"""Facets, counts, orders, pages and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.operators import counts, filters, listings, ranking, sqlapi
from plinth.plans.registry import query
from plinth.schema import SECTORS, enum_rank, validate_enum

ACTIVE = "publish_status = 'published' and merged_into is null"


@query("count_firms_by_country", f"""
    select country, count(*) as count from v_firms where {ACTIVE} and country is not null group by country""")
def _(s):
    return counts.count_firms_by_country(s.firms)


@query("active_firms", f"select id, slug, display_name, sector, country from v_firms where {ACTIVE}")
def _(s):
    return filters.active(s.firms, "firm").select("id", "slug", "display_name", "sector", "country")


@query("active_people", "select id, slug, display_name, role from v_people where publish_status = 'published'")
def _(s):
    return filters.active(s.people, "person").select("id", "slug", "display_name", "role")


@query("firms_by_sector", f"select id, display_name from v_firms where {ACTIVE} and sector = 'design'")
def _(s):
    return filters.facet(filters.active(s.firms, "firm"), sector="design").select("id", "display_name").orderBy(
        "display_name", "id")


@query("firms_by_country", f"select id, display_name from v_firms where {ACTIVE} and country = 'NATION_9'")
def _(s):
    return filters.facet(filters.active(s.firms, "firm"), country="NATION_9").select("id", "display_name").orderBy(
        "display_name", "id")


@query("firms_by_sector_and_country", f"""
    select id, display_name from v_firms where {ACTIVE} and sector = 'technology' and country = 'NATION_9'""")
def _(s):
    both = filters.facet(filters.active(s.firms, "firm"), sector="technology", country="NATION_9")
    return both.select("id", "display_name").orderBy("display_name", "id")


@query("firms_by_country_or_code", """
    select id, country, country_code from v_firms where country = 'de' or country_code = upper('de')""")
def _(s):
    return s.firms.where(filters.country_or_code("de")).select("id", "country", "country_code")


@query("people_letter_range", """
    select id, display_name from v_people where publish_status = 'published'
    and display_name >= 'N' and display_name < 'O'""")
def _(s):
    return filters.letter_prefix(filters.active(s.people, "person"), "N").select("id", "display_name")


@query("people_role_contains", """
    select id, role from v_people where publish_status = 'published' and contains(lower(role), 'lead / r&d')""")
def _(s):
    return filters.role_contains(filters.active(s.people, "person"), "Lead / R&D").select("id", "role")


@query("validate_sector_enum", """
    select sector, sector in ('architecture', 'design', 'technology') as valid, count(*) as count
    from v_firms group by 1, 2""")
def _(s):
    good, bad = validate_enum(s.firms, "sector", SECTORS[:3])
    tagged = good.select("sector", F.lit(True).alias("valid")).unionByName(bad.select("sector", F.lit(False).alias("valid")))
    return tagged.groupBy("sector", "valid").agg(F.count("*").alias("count"))


@query("count_firms_by_sector", f"""
    with m as (select * from (values ('architecture', 1), ('design', 2), ('technology', 3), ('multidisciplinary', 4)) t(sector, position))
    select m.sector, m.position, count(f.id) as count
    from m left join (select * from v_firms where {ACTIVE}) f on f.sector = m.sector group by 1, 2""")
def _(s):
    return counts.count_firms_by_sector(s.firms)


@query("firms_in_sector_order", """
    select id, case sector when 'architecture' then 1 when 'design' then 2 when 'technology' then 3 else 4 end as sector_rank
    from v_firms""")
def _(s):
    return s.firms.select("id", enum_rank("sector", SECTORS).alias("sector_rank")).orderBy("sector_rank", "id")


@query("count_people_by_role", """
    select role, count(*) as count from v_people where publish_status = 'published' and role is not null group by role""")
def _(s):
    return counts.count_people_by_role(s.people)


@query("people_letters", """
    select distinct upper(substr(display_name, 1, 1)) as letter from v_people
    where publish_status = 'published' and regexp_matches(substr(display_name, 1, 1), '[A-Za-z]')""")
def _(s):
    return counts.people_letters(s.people)


@query("count_awards_by_organization", """
    select organization, count(*) as count from v_awards where organization is not null group by organization""")
def _(s):
    return counts.count_awards_by_organization(s.awards)


@query("entity_source_counts", f"""
    select entity_id, count(*) as source_count from v_entity_sources
    where entity_type = 'firm' and entity_id in (select id from v_firms where {ACTIVE} and sector = 'design')
    group by entity_id""")
def _(s):
    ids = filters.facet(filters.active(s.firms, "firm"), sector="design")
    return counts.entity_source_counts(s.entity_sources, ids, "firm")


@query("tag_counts", """
    select t.id, t.name, t.slug, t.category, count(e.tag_id) as entity_count
    from v_tags t left join v_entity_tags e on e.tag_id = t.id group by all""")
def _(s):
    return counts.tag_counts(s.tags, s.entity_tags)


@query("tags_by_category", """
    select coalesce(nullif(category, ''), 'Other') as category, name, slug, count(*) as entity_count
    from v_tags t join v_entity_tags e on e.tag_id = t.id group by all""")
def _(s):
    return counts.tags_by_category(s.tags, s.entity_tags)


@query("tag_category_sizes", """
    select category, count(*) as tags, cast(sum(n) as bigint) as entities from (
        select coalesce(nullif(category, ''), 'Other') as category, t.id, count(*) as n
        from v_tags t join v_entity_tags e on e.tag_id = t.id group by all) group by category""")
def _(s):
    return counts.category_sizes(s.tags, s.entity_tags)


@query("home_stats", f"""
    with f as (select * from v_firms where {ACTIVE})
    select 'firms_architecture' as metric, count(*) as value from f where sector = 'architecture'
    union all select 'firms_design', count(*) from f where sector = 'design'
    union all select 'firms_technology', count(*) from f where sector = 'technology'
    union all select 'firms_multidisciplinary', count(*) from f where sector = 'multidisciplinary'
    union all select 'total_firms', count(*) from f
    union all select 'people', count(*) from v_people where publish_status = 'published'
    union all select 'awards', count(*) from v_awards
    union all select 'sources', count(*) from v_sources""")
def _(s):
    return counts.home_stats(s.firms, s.people, s.awards, s.sources)


@query("alias_counts", """
    select entity_id, count(*) as alias_count from v_aliases where entity_type = 'firm' group by entity_id""")
def _(s):
    return counts.counts_per_key(s.aliases.where("entity_type = 'firm'"), "entity_id", "alias_count")


@query("people_per_firm", "select firm_id, count(*) as people_count from v_firm_people group by firm_id")
def _(s):
    return counts.counts_per_key(s.firm_people, "firm_id", "people_count")


@query("publish_status_counts", """
    with m as (select * from (values ('published', 1), ('draft', 2), ('hidden', 3)) t(publish_status, position))
    select 'firms' as "table", m.publish_status, position, count(f.id) as count
    from m left join v_firms f on f.publish_status = m.publish_status group by all
    union all
    select 'people', m.publish_status, position, count(p.id)
    from m left join v_people p on p.publish_status = m.publish_status group by all""")
def _(s):
    return counts.publish_status_counts(s.firms, s.people)


@query("quality_histogram", """
    with m as (select * from (values ('80-100', 1), ('60-79', 2), ('40-59', 3), ('20-39', 4), ('0-19', 5)) t(bucket, position)),
    b as (select case when quality_score >= 80 then '80-100' when quality_score >= 60 then '60-79'
                 when quality_score >= 40 then '40-59' when quality_score >= 20 then '20-39' else '0-19' end as bucket
          from v_firms where merged_into is null)
    select m.bucket, position, count(b.bucket) as count from m left join b on b.bucket = m.bucket group by all""")
def _(s):
    return counts.quality_histogram(s.firms)


@query("confidence_histogram", """
    with m as (select * from (values ('0.8+', 1), ('0.7-0.8', 2), ('0.6-0.7', 3), ('<0.6', 4)) t(bucket, position)),
    b as (select case when confidence >= 0.8 then '0.8+' when confidence >= 0.7 then '0.7-0.8'
                 when confidence >= 0.6 then '0.6-0.7' else '<0.6' end as bucket
          from v_review where status = 'pending' and confidence <> 0)
    select m.bucket, position, count(b.bucket) as count from m left join b on b.bucket = m.bucket group by all""")
def _(s):
    return counts.confidence_histogram(s.review)


@query("queue_status_counts", """
    with e as (select * from (values ('pending', 1), ('processing', 2), ('done', 3), ('failed', 4)) t(status, position)),
    r as (select * from (values ('pending', 1), ('accepted', 2), ('rejected', 3), ('skipped', 4)) t(status, position))
    select 'enrichment' as queue, e.status, position, count(q.id) as count
    from e left join v_queue q on q.status = e.status group by all
    union all
    select 'review', r.status, position, count(q.id) from r left join v_review q on q.status = r.status group by all""")
def _(s):
    return counts.queue_status_counts(s.queue, s.review)


@query("source_health", """
    select source_name, entity_count, status, status = 'error' as failing,
           coalesce(substr(cast(last_run_at as varchar), 1, 10), 'never') as last_run from v_cursors""")
def _(s):
    return counts.source_health(s.cursors)


@query("gap_counts", f"""
    with f as (select * from v_firms where {ACTIVE}), p as (select * from v_people where publish_status = 'published')
    select 'total_firms' as gap, count(*) as count from f
    union all select 'firms_no_desc', count(*) from f where short_description is null
    union all select 'firms_no_website', count(*) from f where website is null
    union all select 'firms_no_image', count(*) from f where image_url is null
    union all select 'total_people', count(*) from p
    union all select 'people_no_bio', count(*) from p where bio is null
    union all select 'people_no_image', count(*) from p where image_url is null
    union all select 'queue_pending', count(*) from v_queue where status = 'pending'""")
def _(s):
    return counts.gap_counts(s.firms, s.people, s.queue)


@query("exact_duplicates", """
    select canonical_name, count(*) as members, min(id) as first_id from v_firms
    where merged_into is null group by canonical_name having count(*) > 1""")
def _(s):
    return counts.exact_duplicates(s.firms)


@query("exact_duplicate_members", """
    select canonical_name, members, first_id, id, display_name from (
        select *, count(*) over (partition by canonical_name) as members, min(id) over (partition by canonical_name) as first_id
        from v_firms where merged_into is null) where members > 1""")
def _(s):
    return counts.duplicate_members(s.firms)


@query("run_totals", """
    select cast(sum(entity_count) as bigint) as total_entities, round(sum(duration_s), 1) as total_duration_s,
           count(error) as failures, case when count(error) > 0 then 'FAILED' else 'OK' end as outcome from v_runs""")
def _(s):
    return counts.run_totals(s.runs)


@query("firms_page", f"""
    select id, display_name from v_firms where {ACTIVE} and sector = 'architecture'
    order by display_name, id limit 12 offset 24""")
def _(s):
    rows = filters.facet(filters.active(s.firms, "firm"), sector="architecture").select("id", "display_name")
    return ranking.page(rows, [F.asc("display_name"), F.asc("id")], 3, 12)


@query("firms_page_totals", f"""
    select count(*) as total, cast(ceil(count(*) / 12.0) as bigint) as pages from v_firms
    where {ACTIVE} and sector = 'architecture'""")
def _(s):
    rows = filters.facet(filters.active(s.firms, "firm"), sector="architecture")
    return ranking.page_totals(rows, 12)


@query("people_pages_bulk", """
    select id, row_number() over (order by display_name, id) as row_no,
           (row_number() over (order by display_name, id) - 1) // 36 + 1 as page
    from v_people where publish_status = 'published'""")
def _(s):
    rows = filters.active(s.people, "person").select("id", "display_name")
    return ranking.page_of_all(rows, [F.asc("display_name"), F.asc("id")], 36).select("id", "row_no", "page")


@query("awards_pages_bulk", """
    with o as (select id, row_number() over (order by year desc nulls first, award_name asc nulls last, id) as row_no from v_awards)
    select id, row_no, (row_no - 1) // 36 + 1 as page from o""")
def _(s):
    rows = s.awards.select("id", "year", "award_name")
    return ranking.page_of_all(rows, listings.award_order(), 36).select("id", "row_no", "page")


@query("awards_page", """
    select id, award_name, year from v_awards order by year desc nulls first, award_name asc nulls last, id limit 36 offset 36""")
def _(s):
    return ranking.page(s.awards.select("id", "award_name", "year"), listings.award_order(), 2, 36)


@query("awards_by_organization", "select id, award_name, year from v_awards where organization = '1-URGENT'")
def _(s):
    chosen = s.awards.where(F.col("organization") == "1-URGENT").select("id", "award_name", "year")
    return chosen.orderBy(*listings.award_order())


@query("sources_page", """
    select id, published_at from v_sources order by published_at desc nulls first, id limit 20 offset 40""")
def _(s):
    return ranking.page(s.sources.select("id", "published_at"), listings.sources_order(), 3, 20)


@query("sources_by_name", "select id, published_at from v_sources where source_name = 'Dezeen'")
def _(s):
    return listings.sources_by_name(s.sources, "Dezeen").select("id", "published_at")


@query("sources_by_sector", """
    select id, published_at from v_sources where sector = 'design' order by published_at desc nulls first, id limit 20""")
def _(s):
    return listings.sources_by_sector(s.sources, "design").select("id", "published_at")


@query("people_recent_page", """
    select id, created_at from v_people where publish_status = 'published' order by created_at desc, id limit 36""")
def _(s):
    rows = filters.active(s.people, "person").select("id", "created_at")
    return ranking.page(rows, listings.people_order("recent"), 1, 36)


@query("review_worklist", """
    select id, candidate_name, confidence from v_review where status = 'pending' and confidence >= 0.6
    order by confidence desc, id limit 50""")
def _(s):
    return listings.review_worklist(s.review).select("id", "candidate_name", "confidence")


_NEEDS_FIRM = "(coalesce(short_description, '') = '' or coalesce(website, '') = '' or coalesce(image_url, '') = '')"


@query("needs_enrichment_firms", f"select id from v_firms where {_NEEDS_FIRM}")
def _(s):
    return s.firms.where(listings.needs_enrichment("firm")).select("id")


@query("needs_enrichment_people", """
    select id from v_people where coalesce(bio, '') = '' or coalesce(image_url, '') = ''""")
def _(s):
    return s.people.where(listings.needs_enrichment("person")).select("id")


def _tier(tier: str, direction: str, factor: int) -> str:
    return f"""select id, quality_score from (
        select * from v_firms where {ACTIVE} order by quality_score {direction}, id limit {factor * 40})
        where {_NEEDS_FIRM} order by quality_score {direction}, id limit 40"""


for _name, _direction, _factor in [("top", "desc", 2), ("mid", "desc", 3), ("tail", "asc", 2)]:
    query(f"select_tier_{_name}", _tier(_name, _direction, _factor))(
        lambda s, tier=_name: listings.select_tier(s.firms, "firm", tier, 40).select("id", "quality_score"))


@query("long_tail_worklist", """
    select id, quality_score from v_people where publish_status = 'published' and bio is null
    order by quality_score, id limit 100""")
def _(s):
    return listings.long_tail(s.people, "person", 100).select("id", "quality_score")


@query("queue_head", "select id, entity_id from v_queue where status = 'pending' and entity_type = 'firm' order by created_at, id limit 25")
def _(s):
    return listings.queue_head(s.queue, 25, "firm").select("id", "entity_id")


@query("image_worklist", f"""
    select id, quality_score from v_firms where {ACTIVE} and image_url is null and website is not null
    and sector = 'design' order by quality_score desc, id limit 30 offset 10""")
def _(s):
    return listings.image_worklist(s.firms, 30, 10, "design").select("id", "quality_score")


@query("geocode_worklist", """
    select id, city, country from v_firms where publish_status = 'published' and latitude is null
    and city is not null and country is not null order by id limit 200""")
def _(s):
    return listings.geocode_worklist(s.firms, 200).select("id", "city", "country")


@query("reconcile_worklist", f"select id from v_firms where {ACTIVE} and wikidata_id is null")
def _(s):
    return listings.reconcile_worklist(s.firms, "firm").select("id")


@query("sitemap_urls", f"""
    with st as (select * from (values ('', 'weekly', 1.0), ('/search', 'weekly', 0.8), ('/architecture', 'weekly', 0.9),
        ('/design', 'weekly', 0.9), ('/technology', 'weekly', 0.9), ('/people', 'weekly', 0.9), ('/awards', 'monthly', 0.8),
        ('/firms/country', 'weekly', 0.8), ('/people/role', 'weekly', 0.8), ('/architecture/firms', 'weekly', 0.8),
        ('/design/firms', 'weekly', 0.8), ('/technology/firms', 'weekly', 0.8)) t(path, freq, prio))
    select 'https://d.example.org' || path as url, cast(null as varchar) as last_modified, freq as change_frequency,
           cast(prio as double) as priority from st
    union all select 'https://d.example.org/' || case sector when 'multidisciplinary' then 'technology' else sector end
           || '/firms/' || slug, cast(created_at as varchar), 'monthly', 0.7 from v_firms where {ACTIVE}
    union all select 'https://d.example.org/people/' || slug, cast(created_at as varchar), 'monthly', 0.6
           from v_people where publish_status = 'published'
    union all select 'https://d.example.org/firms/country/' || lower(country), null, 'weekly', 0.7
           from v_firms where {ACTIVE} and country is not null group by country having count(*) >= 3
    union all select 'https://d.example.org/people/role/'
           || regexp_replace(regexp_replace(lower(role), '[^a-z0-9]+', '-', 'g'), '-+$', ''), null, 'weekly', 0.7
           from v_people where publish_status = 'published' and role is not null group by role
    union all select 'https://d.example.org/awards/' || slug, null, 'yearly', 0.6 from v_awards""")
def _(s):
    return listings.sitemap_urls(s.spark, "https://d.example.org", s.firms, s.people, s.awards, modified="created_at")


@query("static_params", f"""
    select distinct 'firms' as family, case sector when 'multidisciplinary' then 'technology' else sector end as sector, slug
    from v_firms where {ACTIVE}
    union all select distinct 'people', null, slug from v_people
    union all select distinct 'tags', null, slug from v_tags
    union all select distinct 'awards', null, slug from v_awards""")
def _(s):
    return listings.static_params(s.firms, s.people, s.tags, s.awards)


@query("sql_table_functions", f"""
    select 'firms_in' as fn, cast(id as varchar) as key, 1 as n from v_firms where {ACTIVE} and sector = 'design'
    union all select 'source_counts', cast(entity_id as varchar), count(*) from v_entity_sources where entity_type = 'person' group by 2
    union all select 'by_country', country, count(*) from v_firms where {ACTIVE} and country is not null group by 2""")
def _(s):
    sqlapi.register(s.spark, {"firms": s.firms, "entity_sources": s.entity_sources})
    return s.spark.sql("""
        select 'firms_in' as fn, cast(id as string) as key, 1L as n from firms_in('design', null)
        union all select 'source_counts', cast(entity_id as string), source_count from entity_source_counts('person')
        union all select 'by_country', value, firms from count_firms_by('country')""")


@query("skip_unlabelled", """
    select p_partkey as id, label, not regexp_matches(label, '^Q\\d+$') as kept, not starts_with(label, 'Q') as kept_legacy
    from (select p_partkey, case p_partkey % 3 when 0 then 'Q' || p_partkey when 1 then 'Quinn ' || p_name else p_name end as label from part)""")
def _(s):
    labelled = s.sql("""select p_partkey as id, case p_partkey % 3 when 0 then 'Q' || cast(p_partkey as string)
                        when 1 then 'Quinn ' || p_name else p_name end as label from part""")
    kept = filters.skip_unlabelled(labelled, "label").select("id", F.lit(True).alias("kept"))
    old = filters.skip_unlabelled(labelled, "label", legacy=True).select("id", F.lit(True).alias("kept_legacy"))
    return labelled.join(kept, "id", "left").join(old, "id", "left").select(
        "id", "label", F.coalesce("kept", F.lit(False)).alias("kept"), F.coalesce("kept_legacy", F.lit(False)).alias("kept_legacy"))
