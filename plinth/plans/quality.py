"""Quality scores, relevance, audit and dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.operators import audit, filters, quality
from plinth.plans import sqlparts as sp
from plinth.plans.registry import query

LIVE = "merged_into is null"
ACTIVE = f"publish_status = 'published' and {LIVE}"


def _long_short(column: str) -> list[tuple[str, int]]:
    return [(f"length({column}) >= 50", 15), (f"length({column}) between 1 and 49", 8)]


FIRM_SCORE = sp.points(
    (sp.has("country"), 20), (sp.has("city"), 15), *_long_short("short_description"), (sp.has("website"), 10),
    (sp.has("founded_year"), 10), (sp.has("size_range"), 10), ("a.n > 0", 10), ("m.n > 0", 10))
PERSON_SCORE = sp.points(
    (sp.has("current_firm_id"), 25), (f"{sp.has('role')} or {sp.has('title')}", 20), *_long_short("bio"),
    (sp.has("nationality"), 15), ("a.n > 0", 15), ("sector <> 'architecture' and sector <> ''", 10))


@query("firm_quality", f"""
    with a as (select entity_id, count(*) as n from v_aliases where entity_type = 'firm' group by 1),
    m as (select firm_id, count(*) as n from v_firm_people group by 1),
    s as (select id, display_name, {FIRM_SCORE} as score from v_firms f left join a on a.entity_id = f.id left join m on m.firm_id = f.id where {LIVE})
    select id, score as quality_score, case when {sp.contains_any('display_name', filters.QUALITY_IRRELEVANT_WORDS)} then 'hidden'
           when score >= 40 then 'published' else 'draft' end as publish_status from s""")
def _(s):
    scored = quality.compute_firm_quality(s.firms, s.aliases, s.firm_people)
    return scored.select("id", "quality_score", "publish_status")


@query("person_quality", f"""
    with a as (select entity_id, count(*) as n from v_aliases where entity_type = 'person' group by 1),
    s as (select id, {PERSON_SCORE} as score from v_people p left join a on a.entity_id = p.id)
    select id, score as quality_score, case when score >= 30 then 'published' else 'draft' end as publish_status from s""")
def _(s):
    return quality.compute_person_quality(s.people, s.aliases).select("id", "quality_score", "publish_status")


def _kw(words: list[str]) -> str:
    cases = ", ".join(f"case when contains(lower(title), {sp.quoted(w)}) then {sp.quoted(w)} end" for w in words)
    return f"list_filter([{cases}], lambda w: w is not null)"


def _first3(column: str, words: list[str]) -> str:
    return f"array_to_string(list_filter([{sp.values(words)}], lambda w: list_contains({column}, w))[1:3], ', ')"


CLASSIFIED = f"""
    rs as (select id, slug, display_name, quality_score from v_people where role = 'Researcher' and publish_status = 'published'),
    lk as (select entity_id as id, source_id from v_entity_sources where entity_type = 'person'),
    sw as (select id as source_id, source_name, title <> '' as titled, {_kw(quality.RELEVANT_WORDS)} as good, {_kw(quality.IRRELEVANT_WORDS)} as bad from v_sources),
    j as (select lk.id, sw.* from lk join rs on rs.id = lk.id join sw on sw.source_id = lk.source_id),
    g as (select id, count(*) filter (where titled) as titles, list_distinct(flatten(list(good) filter (where titled))) as good,
                 list_distinct(flatten(list(bad) filter (where titled))) as bad,
                 list_sort(list_distinct(list(source_name) filter (where source_name in ({sp.values(quality.TRUSTED_SOURCES)})))) as trusted from j group by id),
    cl as (select rs.id, rs.slug, rs.display_name as name, rs.quality_score as score,
        case when coalesce(titles, 0) = 0 then 'borderline' when len(trusted) > 0 then 'relevant' when len(bad) > 0 and len(good) = 0 then 'irrelevant'
             when len(good) > 0 then 'relevant' else 'borderline' end as classification,
        case when coalesce(titles, 0) = 0 then 'no source titles linked' when len(trusted) > 0 then 'from ' || array_to_string(trusted, ', ')
             when len(bad) > 0 and len(good) = 0 then 'irrelevant: ' || {_first3('bad', quality.IRRELEVANT_WORDS)}
             when len(good) > 0 then 'matched: ' || {_first3('good', quality.RELEVANT_WORDS)} else 'no keyword matches' end as reason
        from rs left join g on g.id = rs.id)"""


def _classified(s):
    return quality.classify_relevance(s.people, s.entity_sources, s.sources)


@query("classify_relevance", f"with {CLASSIFIED} select id, slug, name, score, classification, reason from cl")
def _(s):
    return _classified(s)


@query("classification_counts", f"""
    with {CLASSIFIED}, m as (select * from (values ('relevant', 1), ('irrelevant', 2), ('borderline', 3)) t(classification, position))
    select m.classification, position, count(cl.id) as count from m left join cl on cl.classification = m.classification group by all""")
def _(s):
    return quality.classification_counts(_classified(s))


@query("apply_relevance", f"""
    with {CLASSIFIED} select p.id, case when cl.classification = 'irrelevant' then 'draft' else p.publish_status end as publish_status
    from v_people p left join cl on cl.id = p.id""")
def _(s):
    return quality.apply_relevance(s.people, _classified(s)).select("id", "publish_status")


@query("relevance_report", f"with {CLASSIFIED} select classification, name, slug, score, reason from cl")
def _(s):
    return quality.relevance_report(_classified(s))


@query("from_trusted_source", f"""
    select distinct entity_id as id from v_entity_sources e join v_sources s on s.id = e.source_id
    where entity_type = 'person' and source_name in ({sp.values(quality.TRUSTED_SOURCES)})""")
def _(s):
    return quality.from_trusted_source(s.entity_sources, s.sources)


JUNK = "(regexp_matches({0}, '^\\d+$') or regexp_matches({0}, '^[A-Za-z]$') or regexp_matches({0}, '^[^\\p{{L}}\\p{{N}}_]+$') or length({0}) < 2)"
SLUG = "regexp_matches(slug, '--|[^a-z0-9-]|^-|-$')"
FIRM_FILLED = sp.points(*[(sp.has(c), 1) for c in ["country", "city", "website", "founded_year", "short_description", "size_range"]])
PERSON_FILLED = sp.points(*[(sp.has(c), 1) for c in ["role", "title", "nationality", "bio", "current_firm_id"]])
NORM = sp.normalize("display_name")
RATIO = sp.jaccard(sp.trigrams("canonical_name"), sp.trigrams("next_name"))


def _part(severity, category, kind, entity, name, detail, source):
    return (f"select '{severity}' as severity, '{category}' as category, {kind} as entity_type, cast({entity} as varchar) as entity_id, "
            f"{name} as name, {detail} as detail from {source}")


MISMATCH = f"'canonical=''' || canonical_name || ''' vs expected=''' || {NORM} || ''''"
ISSUES = "\n union all ".join([
    _part("critical", "junk_name", "'firm'", "id", "display_name", "'Name too short or garbage: ''' || display_name || ''''", f"v_firms where {LIVE} and {JUNK.format('display_name')}"),
    _part("high", "irrelevant_entity", "'firm'", "id", "display_name", "'Likely irrelevant: ''' || display_name || ''''", f"v_firms where {LIVE} and {sp.contains_any('display_name', filters.AUDIT_IRRELEVANT_WORDS)}"),
    _part("medium", "bad_slug", "'firm'", "id", "display_name", "'Bad slug: ''' || slug || ''''", f"v_firms where {LIVE} and {SLUG}"),
    _part("low", "thin_record", "'firm'", "id", "display_name", "'Fewer than 2 metadata fields filled'", f"v_firms where {LIVE} and {FIRM_FILLED} < 2"),
    _part("high", "missing_field", "'firm'", "id", "display_name", "'Missing sector'", f"v_firms where {LIVE} and coalesce(sector, '') = ''"),
    _part("medium", "canonical_mismatch", "'firm'", "id", "display_name", MISMATCH, f"v_firms where {LIVE} and canonical_name is distinct from {NORM}"),
    _part("critical", "junk_name", "'person'", "id", "display_name", "'Name too short or garbage: ''' || display_name || ''''", f"v_people where {JUNK.format('display_name')}"),
    _part("medium", "bad_slug", "'person'", "id", "display_name", "'Bad slug: ''' || slug || ''''", f"v_people where {SLUG}"),
    _part("low", "thin_record", "'person'", "id", "display_name", "'Fewer than 2 metadata fields filled'", f"v_people where {PERSON_FILLED} < 2"),
    _part("medium", "suspicious_name", "'person'", "id", "display_name", "'Single-word name — may be incomplete'", "v_people where not contains(trim(display_name), ' ')"),
    _part("medium", "canonical_mismatch", "'person'", "id", "display_name", MISMATCH, f"v_people where canonical_name is distinct from {NORM}"),
    _part("medium", "junk_alias", "entity_type", "entity_id", "alias", "'Alias too short: ''' || alias_normalized || ''''", "v_aliases where length(alias_normalized) < 2"),
    _part("high", "junk_alias", "entity_type", "entity_id", "alias", "'Single-char alias: ''' || alias_normalized || ''''", "v_aliases where length(alias_normalized) = 1"),
    _part("critical", "exact_duplicate", "'firm'", "min(id)", "canonical_name", "'Exact canonical_name duplicate: ' || count(*) || ' firms'", f"v_firms where {LIVE} group by canonical_name having count(*) > 1"),
    _part("medium", "enrichment_stuck", "'system'", "''", "''", "'Enrichment queue: ' || count(*) || ' items in ''' || status || ''' state'", "v_queue where status in ('failed', 'processing') group by status"),
    _part("high", "review_backlog", "'system'", "''", "''", "'Review queue: ' || count(*) || ' pending items need operator attention'", "v_review where status = 'pending' having count(*) > 100"),
    _part("medium", "missing_field", "'source'", "''", "''", "count(*) || ' sources without URLs'", "v_sources where url is null having count(*) > 0"),
    _part("medium", "broken_feed", "'source'", "''", "source_name", "'Feed ''' || source_name || ''' in error state'", "v_cursors where status = 'error'"),
    _part("low", "no_source_links", "'firm'", "''", "''", "count(*) filter (where id not in (select entity_id from lf)) || ' published firms have no entity_sources links (of ' || count(*) || ')'",
          f"v_firms where {ACTIVE} having count(*) filter (where id not in (select entity_id from lf)) > 0"),
    _part("critical", "dangling_merge", "'firm'", "id", "display_name", "'merged_into=' || merged_into || ' but target does not exist'", "v_firms where merged_into is not null and merged_into not in (select id from v_firms)"),
    _part("high", "fuzzy_duplicate", "'firm'", "id", "display_name", "'Very similar to ''' || next_display_name || ''' (ratio=' || printf('%.3f', ratio) || ')'", "fz where ratio > 0.9"),
])
LINKED = "lf as (select distinct entity_id from v_entity_sources where entity_type = 'firm')"
FUZZY = f"""fz0 as (select id, display_name, canonical_name, lead(canonical_name) over w as next_name, lead(display_name) over w as next_display_name
    from v_firms where {ACTIVE} window w as (order by canonical_name, id)),
    fz as (select *, {RATIO} as ratio from fz0 where next_name is not null and canonical_name <> next_name)"""


def _issues(s):
    tables = {
        "firms": s.firms, "people": s.people, "entity_aliases": s.aliases, "enrichment_queue": s.queue,
        "review_queue": s.review, "sources": s.sources, "ingest_cursors": s.cursors,
        "entity_sources": s.entity_sources,
    }
    return audit.audit_issues(tables, fuzzy_threshold=0.9)


@query("audit_issues", f"with {LINKED}, {FUZZY} {ISSUES}")
def _(s):
    return _issues(s)


@query("audit_firm_totals", f"""
    with {LINKED}, {FUZZY}, i as ({ISSUES}), c as (select severity, category, count(*) as count from i where entity_type = 'firm' group by 1, 2),
    k as (select unnest(['critical', 'high', 'medium', 'low', 'high', 'medium']) as severity,
                 unnest(['junk_name', 'irrelevant_entity', 'bad_slug', 'thin_record', 'missing_field', 'canonical_mismatch']) as category)
    select severity, category, coalesce(count, 0) as count from k left join c using (severity, category)""")
def _(s):
    return audit.firm_totals(audit.firm_flags(s.firms))


@query("audit_by_severity", f"""
    with {LINKED}, {FUZZY}, i as ({ISSUES}), m as (select * from (values ('critical', 1), ('high', 2), ('medium', 3), ('low', 4)) t(severity, position))
    select m.severity, position, count(i.category) as count from m left join i on i.severity = m.severity group by all""")
def _(s):
    return audit.issues_by_severity(_issues(s))


@query("audit_by_category", f"with {LINKED}, {FUZZY}, i as ({ISSUES}) select category, count(*) as count from i group by category")
def _(s):
    return audit.issues_by_category(_issues(s))


@query("audit_examples", f"""
    with {LINKED}, {FUZZY}, i as ({ISSUES}),
    r as (select *, cast(row_number() over (partition by severity order by category, entity_type, entity_id, name, detail) as int) as place
          from i where severity in ('critical', 'high', 'medium'))
    select * from r where place <= 10""")
def _(s):
    return audit.examples_per_severity(_issues(s))


@query("thin_ratio", f"""
    select count(*) filter (where {PERSON_FILLED} < 2) as thin, count(*) as checked, count(*) as total,
           round(count(*) filter (where {PERSON_FILLED} < 2) / count(*), 6) as share, count(*) filter (where {PERSON_FILLED} < 2) as estimated from v_people""")
def _(s):
    return audit.thin_ratio(s.people, filters.thin_person())


@query("dashboard_entities", f"""
    select 'firms_active' as entity, count(*) filter (where {LIVE}) as count from v_firms
    union all select 'firms_merged', count(merged_into) from v_firms union all select 'people', count(*) from v_people
    union all select 'sources', count(*) from v_sources union all select 'aliases', count(*) from v_aliases""")
def _(s):
    boards = quality.dashboard(s.spark, s.firms, s.people, s.sources, s.aliases, s.queue, s.review, s.cursors)
    return boards["entities"]


@query("dashboard_duplicates", """
    select candidate_name, confidence, suggested_entity_id from v_review where status = 'pending' and confidence >= 0 order by confidence desc, id limit 10""")
def _(s):
    boards = quality.dashboard(s.spark, s.firms, s.people, s.sources, s.aliases, s.queue, s.review, s.cursors)
    return boards["duplicates"].select("candidate_name", "confidence", "suggested_entity_id")
