"""Raw nested records, built by Spark from the driver tables, flattened and resolved."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.functions import scoring
from plinth.functions.text import normalize_name
from plinth.operators import relations
from plinth.operators.simjoin import dealt_out
from plinth.plans import sqlparts as sp
from plinth.plans.registry import query
from plinth.sources import award_tables, editions, elements, feeds, labs, repos, sinks, works

ENTRIES = """
    select o_orderkey as pos, cast(year(o_orderdate) as int) as year,
           case o_orderpriority when '1-URGENT' then 'pritzker' when '2-HIGH' then 'riba' when '3-MEDIUM' then 'aia' else 'none' end as programme,
           case o_orderkey % 11 when 0 then 'City of ' || c_name when 1 then '' when 2 then cast(null as string)
                else c_mktsegment || ' Laureate ' || cast(o_custkey % 97 as string) end as person_name,
           case when o_orderkey % 3 = 0 then cast(null as string) else c_mktsegment || ' Works ' || cast(o_custkey as string) end as firm_name,
           case o_orderkey % 4 when 0 then 'Japan' when 1 then 'France/Italy' when 2 then '' else 'Norway' end as nationality
    from orders join customer on o_custkey = c_custkey"""
PROGRAMMES = ", ".join("(" + sp.values(list(p)) + ")" for p in award_tables.ENTRY_PROGRAMMES)
KEPT = f"""(select * from ({ENTRIES}) join (values {PROGRAMMES}) p(programme, award_name, organization, prestige) using (programme)
    where person_name <> '' and not starts_with(person_name, 'City of'))"""


@query("award_entries", f"select pos, year, person_name, firm_name, nationality, award_name, organization, prestige from {KEPT}")
def _(s):
    return award_tables.award_entries(s.sql(ENTRIES)).drop("programme")


# The same entries with years that are missing and a second spelling of an award, for Spark and DuckDB.
YEAR = "case when nationality = '' then cast(null as int) else year end"
AWARD = "case when nationality = 'Japan' then upper(award_name) || '!' else award_name end"
SPELLED = f"(select * replace ({YEAR} as year, {AWARD} as award_name) from {KEPT})"


def _facts(s):
    return relations.award_facts(award_tables.award_entries(s.sql(ENTRIES)), s.people, s.firms, s.aliases)


AWARD_SLUG = sp.slug(sp.normalize("concat_ws(' ', award_name, cast(year as varchar))"))


@query("award_facts_recipients", f"""
    select distinct sha256('award|' || {AWARD_SLUG}) as award_id, year, {sp.normalize('person_name')} as person, {sp.normalize('firm_name')} as firm from {SPELLED}""")
def _(s):
    entries = award_tables.award_entries(s.sql(ENTRIES)).withColumns({"year": F.expr(YEAR), "award_name": F.expr(AWARD)})
    facts = relations.award_facts(entries, s.people.where("false"), s.firms.where("false"), s.aliases.where("false"))
    name = lambda kind: facts[kind].select(F.col("entity_id").alias(f"{kind}_id"), normalize_name("name").alias(kind)).distinct()
    won = facts["recipients"].join(name("people").withColumnRenamed("people_id", "person_id"), "person_id").join(
        name("firms").withColumnRenamed("firms_id", "firm_id"), "firm_id", "left")
    return won.select("award_id", "year", F.col("people").alias("person"), F.col("firms").alias("firm")).distinct()


@query("award_counters", f"""
    with k as (select *, {sp.normalize('person_name')} as person, {sp.normalize('firm_name')} as firm from {KEPT}),
    p as (select programme, count(*) as n_kept, count(*) filter (pos = first) as people_created, count(*) filter (pos <> first) as people_linked
          from (select *, min(pos) over (partition by person) as first from k) group by programme),
    f as (select programme, count(*) filter (pos = first) as firms_created, count(*) filter (pos <> first) as firms_linked
          from (select *, min(pos) over (partition by firm) as first from k where firm <> '') group by programme),
    w as (select programme, count(*) as recipients from (select distinct programme, award_name, year, person, coalesce(firm, '') from k) group by programme),
    r as (select programme, count(*) as n_read from ({ENTRIES}) group by programme)
    select programme, n_read, n_read - coalesce(n_kept, 0) as skipped, coalesce(people_created, 0) as people_created, coalesce(people_linked, 0) as people_linked,
           coalesce(firms_created, 0) as firms_created, coalesce(firms_linked, 0) as firms_linked, coalesce(recipients, 0) as recipients
    from r left join p using (programme) left join f using (programme) left join w using (programme)""")
def _(s):
    raw = s.sql(ENTRIES)
    entries = award_tables.award_entries(raw)
    facts = relations.award_facts(entries, s.people.where("false"), s.firms.where("false"), s.aliases.where("false"))
    return relations.award_counters(raw, entries, facts)


@query("award_facts_firm_links", f"select count(*) as links from (select distinct person_name, firm_name from {KEPT} where firm_name is not null)")
def _(s):
    return _facts(s)["firm_people"].agg(F.count("*").alias("links"))


EDITION_LINES = """
    select l_orderkey, l_linenumber, cast(year(o_orderdate) as int) as year, p_name, p_brand, s_name, o_custkey
    from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey"""


def _edition_json(s):
    """Edition JSON per order: as a list, wrapped, and with a single director object. An order has at most seven lines."""
    lines = s.sql(EDITION_LINES)
    person = F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("nationality"), F.col("s_name").alias("firm"),
                      F.when(F.col("l_linenumber") == 7, F.lit("Guest")).alias("role"))
    at = lambda *n: F.sort_array(F.collect_list(F.when(F.col("l_linenumber").isin(*n), person)))
    grouped = lines.groupBy(F.col("l_orderkey").alias("key"), "year", "o_custkey").agg(
        at(1).alias("director"), at(2).alias("golden_lion_lifetime"), at(3).alias("golden_lion_best_participant"),
        at(4, 5, 6, 7).alias("notable_participants"))
    pavilion = F.when(F.col("key") % 2 == 0, F.struct(F.concat(F.lit("Architect "), "o_custkey").alias("architect")))
    full = F.struct("year", "director", "golden_lion_lifetime", "golden_lion_best_participant",
                    pavilion.alias("golden_lion_best_pavilion"), "notable_participants")
    lone = F.struct("year", F.get("director", F.lit(0)).alias("director"))
    text = (F.when(F.col("key") % 3 == 0, F.to_json(F.array(full)))
            .when(F.col("key") % 3 == 1, F.to_json(F.struct(F.array(full).alias("editions"))))
            .otherwise(F.to_json(F.array(lone))))
    return grouped.select(text.alias("value"))


@query("flatten_editions", f"""
    with l as ({EDITION_LINES}),
    r as (select year, case l_linenumber when 1 then 'Venice Biennale Director' when 2 then 'Golden Lion Lifetime Achievement'
                 when 3 then 'Golden Lion Best Participant' end as award_name, p_name as name, p_brand as nationality, s_name as firm,
                 case l_linenumber when 1 then 'Curator/Director' when 2 then 'Architect' when 3 then 'Architect' when 7 then 'Guest' else 'Participant' end as role
          from l where l_orderkey % 3 <> 2
          union all
          select year, 'Venice Biennale Director', p_name, p_brand, s_name, 'Curator/Director' from (
            select *, row_number() over (partition by l_orderkey order by p_name, p_brand, s_name) as rn from l where l_linenumber = 1 and l_orderkey % 3 = 2) where rn = 1
          union all
          select distinct on (l_orderkey) year, 'Golden Lion Best National Pavilion', 'Architect ' || o_custkey, null, null, 'Architect'
          from l where l_orderkey % 3 <> 2 and l_orderkey % 2 = 0)
    select year, award_name, name, nationality, firm, role, count(*) as count from r group by all""")
def _(s):
    rows = editions.flatten_editions(editions.parse_editions(_edition_json(s)))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("count"))


WORK_LINES = """
    select l_orderkey as k, l_linenumber as n, o_orderdate, o_orderpriority, p_partkey, p_name, p_type, s_suppkey, s_nationkey
    from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey"""
INST = "case when s_nationkey % 3 = 0 then 'Institute of Technology ' || cast(s_suppkey as string) when s_nationkey % 3 = 1 then ' Smart Urban Lab ' else 'General Hospital' end"
ARRANGED = f"(select *, row_number() over (partition by k order by n, p_partkey, s_suppkey) - 1 as seat, {INST} as inst from ({WORK_LINES}))"


def _works(s):
    """Work records per order, parsed from JSON; authors are the lines of the order, at most seven."""
    lines = s.sql(f"select * from {ARRANGED}")
    author = F.struct(F.concat(F.lit("A"), "p_partkey").alias("id"), F.when(F.col("n") != 5, F.col("p_name")).otherwise("").alias("display_name"),
                      F.when(F.col("n") % 2 == 0, F.concat(F.lit("https://orcid.org/"), F.col("p_partkey"))).alias("orcid"))
    plain = F.struct(F.lit("General Hospital").alias("display_name"), F.lit("US").alias("country_code"))
    inst = F.struct(F.col("inst").alias("display_name"), F.when(F.col("s_nationkey") % 2 == 0, F.lit("DE")).otherwise("").alias("country_code"))
    insts = F.when(F.col("n") == 6, F.array().cast("array<struct<display_name:string,country_code:string>>")).otherwise(F.array(plain, inst))
    grouped = lines.groupBy("k", "o_orderdate", "o_orderpriority").agg(
        F.sort_array(F.collect_list(F.struct("seat", author.alias("author"), insts.alias("institutions")))).alias("a"),
        F.min("p_type").alias("topic"))
    work = F.struct(
        F.concat(F.lit("W"), "k").alias("id"),
        F.when(F.col("k") % 10 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" Study "), "k", F.lit(" of "), "o_orderpriority")).alias("title"),
        F.when(F.col("k") % 4 == 0, F.concat(F.lit("https://doi.org/"), "k")).alias("doi"),
        F.when(F.col("k") % 7 != 0, F.year("o_orderdate")).alias("publication_year"),
        F.array(F.struct(F.concat("topic", F.lit(" robot design")).alias("display_name"))).alias("topics"),
        F.transform("a", lambda x: F.struct(x["author"].alias("author"), x["institutions"].alias("institutions"))).alias("authorships"))
    return works.parse_works(grouped.select(F.to_json(work).alias("value")))


URL = "case when k % 4 = 0 then 'https://doi.org/' || k else 'W' || k end"
NAMED = "case when n = 5 then '' else p_name end"
SECTOR_VOTES = ", ".join(
    f"{{'hits': -{sp.count_words('topic', words)}, 'rank': {rank}, 'sector': '{sector}'}}" for rank, (sector, words) in enumerate(scoring.SECTOR_WORDS.items()))
REAL = "(trim(inst) <> 'General Hospital' and n <> 6)"


@query("work_sources", f"""
    with f as (select k, any_value(o_orderdate) as d, any_value(o_orderpriority) as p, arg_min({NAMED}, seat) as author, min(p_type) || ' robot design' as topic from {ARRANGED} group by k),
    v as (select *, list_sort([{SECTOR_VOTES}])[1] as vote from f)
    select {URL} as url, 'Study ' || k || ' of ' || p as title, 'OpenAlex' as source_name,
           case when k % 7 <> 0 then make_timestamp(year(d), 1, 1, 0, 0, 0) end as published_at, author, 'api' as source_type, case when vote.hits < 0 then vote.sector else 'technology' end as sector
    from v where k % 10 <> 0""")
def _(s):
    return works.flatten_works(_works(s))["sources"]


@query("work_institutions", f"""
    with f as (select k, trim(inst) as name, arg_min(case when s_nationkey % 2 = 0 then 'DE' end, seat) as x, min(seat) as seat from {ARRANGED} where {REAL} and k % 10 <> 0 group by 1, 2)
    select {URL} as url, f.name, case when a.s_nationkey % 2 = 0 then 'DE' end as country_code
    from f join {ARRANGED} a using (k) where a.seat = f.seat""")
def _(s):
    return works.flatten_works(_works(s))["institutions"].drop("sector")


@query("work_authors", f"""
    select {URL} as url, cast(seat as int) as author_no, p_name as name, case when n % 2 = 0 then cast(p_partkey as varchar) end as orcid, 'A' || p_partkey as author_id
    from {ARRANGED} where k % 10 <> 0 and n <> 5 and {REAL}""")
def _(s):
    return works.flatten_works(_works(s))["authors"].drop("sector")


@query("work_affiliations_venue", f"""
    select {URL} as url, cast(seat as int) as author_no, p_name as name, case when {REAL} then inst end as institution,
           case when {REAL} and s_nationkey % 2 = 0 then 'DE' end as country_code
    from {ARRANGED} where k % 10 <> 0 and n <> 5 and length(p_name) >= 4""")
def _(s):
    return works.flatten_works(_works(s), mode="venue")["affiliations"]


@query("work_affiliations_topic", f"""
    select {URL} as url, cast(seat as int) as author_no, p_name as name, inst as institution, case when s_nationkey % 2 = 0 then 'DE' end as country_code
    from {ARRANGED} where k % 10 <> 0 and n <> 5 and {REAL}""")
def _(s):
    return works.flatten_works(_works(s))["affiliations"]


@query("work_topics", f"""
    select 'W' || k as id, case when k % 3 = 0 then t || ' robot' when k % 3 = 1 then t || ' housing, urban' else '' end as topics,
           case when k % 3 = 0 then 'technology' when k % 3 = 1 then 'architecture' else 'technology' end as sector
    from (select l_orderkey as k, min(p_type) as t from lineitem join part on l_partkey = p_partkey group by 1)""")
def _(s):
    base = s.sql("select l_orderkey as k, min(p_type) as t from lineitem join part on l_partkey = p_partkey group by 1")
    topic = lambda c: F.struct(c.alias("display_name"))
    concept = lambda c, level: F.struct(c.alias("display_name"), F.lit(level).cast("int").alias("level"))
    none = F.array().cast("array<struct<display_name:string>>")
    made = base.select(
        F.concat(F.lit("W"), "k").alias("id"), F.when(F.col("k") % 3 == 0, F.array(topic(F.concat("t", F.lit(" robot"))))).otherwise(none).alias("topics"),
        F.when(F.col("k") % 3 == 2, F.array(concept(F.lit("too narrow"), 3), concept(F.lit("no level"), None))).otherwise(
            F.array(concept(F.concat("t", F.lit(" housing, urban")), 1))).alias("concepts"))
    names = works.topics_of()
    return made.select("id", F.array_join(names, "|").alias("topics"), scoring.classify_sector(names).alias("sector"))


LABS = """
    select s_suppkey as pos, case when s_suppkey % 9 = 0 then ' ' else ' ' || case when s_suppkey % 13 < 3 then 'Shared ' || cast(s_suppkey % 4 as string) else s_name end || ' Lab ' end as name,
           case when s_nationkey % 8 = 0 then '' else 'de' end as country_code, case when s_suppkey % 3 = 0 then '' else 'Town' end as city, 'County' as county,
           case when s_suppkey % 4 = 0 then cast(null as string) when s_suppkey % 4 = 1 then repeat(s_name, 20) else ' short ' end as blurb,
           case when s_suppkey % 5 = 0 then cast(null as string) else 'mini_fab_lab' end as kind_name,
           case when s_nationkey % 7 = 0 then 'closed' else 'active' end as activity_status, s_suppkey % 6 as links_kind, s_acctbal
    from supplier"""


@query("ingest_labs", f"""
    with l as (select *, trim(name) as n, trim(coalesce(blurb, '')) as b from ({LABS}))
    select n as display_name, {sp.normalize('n')} as canonical_name, 'technology' as sector, 'DE' as country, case when city = '' then 'County' else city end as city,
      case links_kind when 0 then 'https://netflix.com/lab' when 1 then 'http://lab.org' when 2 then null when 3 then 'https://lab.example.com' else 'https://sub.lab.net' end as website,
      concat_ws('. ', case when kind_name is null then 'Fab Lab' else 'Mini Fab Lab' end, nullif(b, ''),
        case when links_kind > 2 then 'Capabilities: 3D Printing, Laser Cutting, Bio Lab' end) as short_description,
      {sp.slug(sp.normalize('n'))} as slug
    from l where n <> '' and country_code <> '' and activity_status = 'active'
    qualify row_number() over (partition by {sp.normalize('n')} order by pos) = 1""")
def _(s):
    url = lambda u: F.struct(F.lit(u).alias("url"))
    k = F.col("links_kind")
    links = (F.when(k == 0, F.array(url("https://www.facebook.com/x"), url("https://netflix.com/lab"))).when(k == 1, F.array(url("http://lab.org")))
             .when(k == 2, F.array(url("https://x.com/lab"), url(""))).when(k == 3, F.array(url("https://instagram.com/a"), url("https://lab.example.com")))
             .otherwise(F.array(url("https://sub.lab.net"))))
    caps = F.when(k > 2, F.array(F.lit("three_d_printing"), F.lit("laser"), F.lit("bio_lab"))).otherwise(F.array().cast("array<string>"))
    raw = s.sql(LABS).withColumns({"links": links, "capabilities": caps})
    return labs.ingest_labs(raw, s.firms, s.aliases, order=[F.col("pos")])


@query("flatten_map_elements", """
    select c_custkey as id, c_name as name, case when c_custkey % 3 = 0 then 0.0 else cast(c_custkey % 90 as double) end as latitude,
           cast(c_custkey % 180 as double) as longitude, case when c_custkey % 2 = 0 then c_mktsegment end as city,
           case c_custkey % 5 when 0 then 'FR' when 1 then 'XX' end as country_code,
           case c_custkey % 4 when 0 then 'https://a.org' when 1 then 'https://b.org' end as website from customer where c_custkey % 6 <> 5""")
def _(s):
    k = F.col("c_custkey")
    tags = F.map_filter(F.create_map(
        F.lit("name"), F.when(k % 6 == 5, F.lit("ab")).otherwise(F.col("c_name")), F.lit("addr:city"), F.when(k % 2 == 0, F.col("c_mktsegment")),
        F.lit("addr:country"), F.when(k % 5 == 0, F.lit("fr")).when(k % 5 == 1, F.lit("xx")).when(k % 5 == 2, F.lit("France")),
        F.lit("website"), F.when(k % 4 == 0, F.lit("https://a.org")), F.lit("contact:website"), F.when(k % 4 == 1, F.lit("https://b.org"))),
        lambda key, v: v.isNotNull())
    lat = F.when(k % 3 == 0, F.lit(0.0)).otherwise((k % 90).cast("double"))
    lon = (k % 180).cast("double")
    raw = s.base("customer").select(
        k.alias("id"), F.when(k % 2 == 0, lat).alias("lat"), F.when(k % 2 == 0, lon).alias("lon"),
        F.when(k % 2 == 1, F.struct(lat.alias("lat"), lon.alias("lon"))).alias("center"), tags.alias("tags"))
    return elements.flatten_map_elements(raw)


REPOS = """select event_id as pos, event_type || '/' || cast(event_id % 5000 as string) as full_name, 'https://h.example/' || cast(event_id % 5000 as string) as html_url,
    'u' || cast(user_id as string) as login, case user_id % 3 when 0 then 'User' when 1 then 'Organization' else 'Bot' end as type from events"""


def _repos(s):
    return s.sql(REPOS).select("pos", "full_name", "html_url", F.struct("login", "type").alias("owner"))


@query("repo_owners", f"select login, case any_value(type) when 'User' then 'person' when 'Organization' then 'firm' end as entity_type, min(pos) as pos from ({REPOS}) group by login")
def _(s):
    return repos.repo_owners(_repos(s))


@query("repo_sources", f"select arg_min(full_name, pos) as title, html_url as url, arg_min(login, pos) as author from ({REPOS}) group by html_url")
def _(s):
    return repos.repo_sources(_repos(s)).select("title", "url", "author")


@query("repo_sources_first_per_owner", f"select arg_min(full_name, pos) as title, arg_min(html_url, pos) as url, login as author from ({REPOS}) group by login")
def _(s):
    return repos.repo_sources(_repos(s), legacy=True).select("title", "url", "author")


BOUND = """select p_partkey, case when p_partkey % 5 = 0 then 'Q' || cast(p_partkey as string) else upper(substr(p_name, 1, 1)) || substr(p_name, 2) end as label,
    p_size, p_retailprice from part"""


def _bindings(s):
    k, v = F.col("p_partkey"), lambda c: F.when(c.isNotNull(), F.struct(c.cast("string").alias("value")))
    pairs = {
        "item": F.concat(F.lit("http://kg.example/entity/Q"), k + 5), "itemLabel": F.col("label"), "sitelinks": F.col("p_size").cast("string"),
        "inception": F.when(k % 3 == 0, F.concat((k % 100 + 1900).cast("string"), F.lit("-05-01T00:00:00Z"))),
        "website": F.when(k % 4 == 0, F.concat(F.lit("https://k"), k, F.lit(".org"))),
        "birthYear": F.when(k % 2 == 0, F.concat((k % 80 + 1900).cast("string"), F.lit(".0"))), "deathYear": F.when(k % 6 == 0, F.lit("n/a")),
        "coord": F.when(k % 5 == 1, F.concat(F.lit("Point("), (k % 180).cast("string"), F.lit(".5 -"), (k % 90).cast("string"), F.lit(")"))),
        "nationalityLabel": F.when(k % 2 == 1, F.lit("Norway")),
    }
    made = F.create_map(*[x for name, value in pairs.items() for x in (F.lit(name), v(value))])
    return elements.read_bindings(s.sql(BOUND).select(F.map_filter(made, lambda key, x: x.isNotNull()).alias("binding")))


BOUND_SQL = f"""(select p_partkey as k, 'Q' || (p_partkey + 5) as wikidata_id, label, cast(p_size as int) as sitelinks,
    case when p_partkey % 3 = 0 then cast(p_partkey % 100 + 1900 as int) end as founded_year,
    case when p_partkey % 4 = 0 then 'https://k' || p_partkey || '.org' end as website, cast(null as varchar) as country,
    case when p_partkey % 2 = 1 then 'Norway' end as nationality, case when p_partkey % 2 = 0 then cast(p_partkey % 80 + 1900 as int) end as birth_year,
    cast(null as int) as death_year, case when p_partkey % 5 = 1 then cast(p_partkey % 180 + 0.5 as double) end as longitude,
    case when p_partkey % 5 = 1 then cast(-(p_partkey % 90) as double) end as latitude from ({BOUND}))"""


@query("read_bindings", f"select * exclude (k) from {BOUND_SQL}")
def _(s):
    return _bindings(s).withColumn("latitude", F.col("latitude") + 0.0)


@query("reconcile", f"""
    with b as (select * from (select *, row_number() over (partition by label order by sitelinks desc nulls last, wikidata_id) as rn from {BOUND_SQL}) where rn = 1)
    select p.id, coalesce(p.wikidata_id, b.wikidata_id) as wikidata_id, coalesce(nullif(p.nationality, ''), b.nationality) as nationality
    from v_people p left join b on b.label = p.display_name and p.publish_status = 'published' and p.wikidata_id is null""")
def _(s):
    return relations.reconcile(s.people, _bindings(s), "person").select("id", "wikidata_id", "nationality")


@query("discover", f"""
    with u as (select * from {BOUND_SQL} where sitelinks >= 5 and not regexp_matches(label, '^Q\\d+$')
               and wikidata_id not in (select wikidata_id from v_people where wikidata_id is not null)),
    t as (select canonical_name, min(id) as id from v_people group by 1)
    select u.wikidata_id, u.label, 'exact' as match_type, cast(t.id as varchar) as entity_id from u join t on t.canonical_name = lower(u.label)""")
def _(s):
    return relations.discover(_bindings(s), s.people, s.aliases, "person").select("wikidata_id", "label", "match_type", "entity_id")


FEED = """select 'g' || cast(doc_id as string) as guid, case when doc_id % 13 = 0 then '' else 'https://f.example/' || cast(doc_id % 700 as string) end as link,
    case when doc_id % 17 = 0 then '  ' else ' ' || text || ' ' end as title,
    case doc_id % 3 when 0 then 'Tue, 05 Mar 2024 10:00:00 +0100' when 1 then '2024-03-05T10:00:00Z' end as pubDate,
    case when doc_id % 3 = 2 then '2023-01-02' end as updated, case when doc_id % 2 = 0 then ' ' else ' A' || lang end as author from documents"""


@query("feed_items", f"""
    select guid as entry_id, link as url, trim(title) as title,
           case substr(guid, 2)::bigint % 3 when 0 then '2024-03-05 09:00:00' when 1 then '2024-03-05 10:00:00' else '2023-01-02 00:00:00' end as published_at,
           nullif(trim(author), '') as author, 'Wire' as source_name, 'rss' as source_type, 'design' as sector
    from ({FEED}) where link <> '' and trim(title) <> ''""")
def _(s):
    items = feeds.feed_items(s.sql(FEED), "Wire", "design")
    return items.withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))


@query("award_table_facts", """
    select o_orderkey as programme, cast(1 as int) as row_no, cast(year(o_orderdate) as int) as year, c_mktsegment || ' Architects ' || o_custkey as name, 'firm' as entity_type
    from orders join customer on o_custkey = c_custkey
    union all
    select o_orderkey, 2, 1999, 'Ann ' || lower(c_mktsegment), 'person' from orders join customer on o_custkey = c_custkey""")
def _(s):
    return _table_facts(s)


def _table_facts(s):
    lines = s.sql("""select o_orderkey as programme, year(o_orderdate) as y, o_custkey, c_mktsegment from orders join customer on o_custkey = c_custkey""")
    html = F.concat(
        F.lit('<p>x</p><table class="sortable wikitable"><tr><th>Year</th><th>Winner</th></tr><tr><td>'), "y", F.lit("</td><td><b>"), "c_mktsegment",
        F.lit(" Architects "), "o_custkey", F.lit("</b>[1] (UK)</td></tr><tr><td>1999<td>Ann "), F.lower("c_mktsegment"),
        F.lit(" ;</tr><tr><td>2001</td></tr></table><table><tr><td>2002</td><td>Nobody</td></tr></table>"))
    # Dealt over all tasks: the rows are few bytes, their pages are dear to parse.
    return award_tables.award_table_facts(dealt_out(lines, "programme").select("programme", html.alias("html")))


@query("award_table_recipients", f"""
    with t as (select o_orderkey as k, cast(year(o_orderdate) as int) as year, c_mktsegment || ' Architects ' || o_custkey as name, 'firm' as kind, 'Prize ' || o_orderpriority as award_name
               from orders join customer on o_custkey = c_custkey
               union all select o_orderkey, 1999, 'Ann ' || lower(c_mktsegment), 'person', 'Prize ' || o_orderpriority from orders join customer on o_custkey = c_custkey),
    i as (select *, sha256('award|' || {AWARD_SLUG}) as award_id, sha256(kind || '|' || {sp.slug(sp.normalize('name'))}) as id from t)
    select distinct award_id, case when kind = 'firm' then id end as firm_id, case when kind = 'person' then id end as person_id, year from i""")
def _(s):
    named = s.sql("select o_orderkey as programme, 'Prize ' || o_orderpriority as award_name, o_orderpriority as organization, '1' as prestige from orders")
    rows = _table_facts(s).join(named, "programme").withColumn("pos", F.col("programme") * 10 + F.col("row_no"))
    facts = relations.award_facts_of_rows(rows, s.people.where("false"), s.firms.where("false"), s.aliases.where("false"))
    return facts["recipients"]


@query("run_log", """
    select run_day, cast(sum(entity_count) as bigint) as total_entities, count(error) as failures, count(*) as jobs,
           string_agg(name, ',' order by name) as names, round(sum(round(duration_s, 1)), 1) as seconds from v_runs group by run_day""")
def _(s):
    logged = sinks.run_log_row(s.runs, F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp"), by=["run_day"])
    return logged.select(
        "run_day", "total_entities", "failures", F.size("summary").cast("long").alias("jobs"),
        F.array_join("sources_run", ",").alias("names"),
        F.round(F.aggregate("summary", F.lit(0.0), lambda acc, r: acc + r["duration_s"]), 1).alias("seconds"))


TRIPLES = """
    select l_orderkey as source_id, l_orderkey * 10 + l_linenumber as pos, upper(p_name) as subject_name, 'person' as subject_type,
           case l_linenumber when 1 then 'works_at' when 2 then 'founded' when 3 then 'partner_at' when 4 then 'acquired_by'
                when 5 then 'collaborated_with' when 6 then 'designed' else 'spin_off_from' end as predicate,
           case when l_linenumber = 4 then p_name else 'Works ' || cast(o_custkey as string) end as object_name,
           case when l_linenumber = 4 then 'person' else 'firm' end as object_type, cast(year(o_orderdate) as int) as year, p_partkey, o_custkey, l_linenumber
    from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey"""
ENTITIES = """
    select distinct l_orderkey as source_id, 'person' as entity_type, l_partkey as entity_id, p_name as name from lineitem join part on l_partkey = p_partkey where l_linenumber < 6
    union all select distinct o_orderkey, 'firm', o_custkey, 'WORKS ' || cast(o_custkey as string) from orders where o_orderstatus = 'O'"""
PLACED = f"""
    tr as ({TRIPLES}), en as (select source_id, lower(name) as key, arg_min(entity_type, (entity_type, cast(entity_id as varchar))) as kind,
              min(cast(entity_id as varchar)) as id from ({ENTITIES}) group by 1, 2),
    rs as (select distinct object_name as name, 'firm' as kind, 'F' || o_custkey as id from tr where object_type = 'firm'),
    pl as (select tr.*, a.id as s_id, a.kind as s_kind, coalesce(b.id, rs.id) as o_id, coalesce(b.kind, tr.object_type) as o_kind from tr
           left join en a on a.source_id = tr.source_id and a.key = lower(subject_name) left join en b on b.source_id = tr.source_id and b.key = lower(object_name)
           left join rs on rs.name = tr.object_name and rs.kind = tr.object_type where a.id is not null and coalesce(b.id, rs.id) is not null)"""


def _routed(s):
    triples = s.sql(TRIPLES)
    resolved = triples.where("object_type = 'firm'").select(
        F.col("object_name").alias("name"), F.lit("firm").alias("entity_type"), F.concat(F.lit("F"), "o_custkey").alias("entity_id")).distinct()
    return relations.route_relationships(triples, s.sql(ENTITIES), resolved)


@query("route_firm_people", f"""
    with {PLACED}, k as (select *, row_number() over (partition by o_id, s_id order by pos desc) as rn from pl
        where predicate in ('works_at', 'founded', 'partner_at') and s_kind = 'person' and o_kind = 'firm')
    select o_id as firm_id, s_id as person_id, case predicate when 'works_at' then 'Employee' when 'founded' then 'Founder' else 'Partner' end as role from k where rn = 1""")
def _(s):
    return _routed(s)["firm_people"].select("firm_id", "person_id", "role")


@query("route_entity_relationships", f"""
    with {PLACED}, m as (select *, case predicate when 'collaborated_with' then 'collaboration' when 'acquired_by' then 'acquired_by' when 'spin_off_from' then 'spin_off' end as rel from pl),
    k as (select *, row_number() over (partition by s_id, s_kind, o_id, o_kind, rel order by pos desc) as rn from m where rel is not null)
    select s_id as from_entity_id, o_id as to_entity_id, o_kind as to_entity_type, rel as relationship, year as start_year from k where rn = 1""")
def _(s):
    return _routed(s)["relationships"].select("from_entity_id", "to_entity_id", "to_entity_type", "relationship", "start_year")
