"""Scalar expressions applied to whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.functions import extract, geo, pages, scoring, similarity, text
from plinth.operators import filters
from plinth.plans import sqlparts as sp
from plinth.plans.registry import query

NORM_TEXT = sp.normalize("text")


@query("normalize_texts", f"""
    select doc_id, length(n) as chars, md5(n) as digest from (select doc_id, {NORM_TEXT} as n from documents)""")
def _(s):
    norm = s.base("documents").select("doc_id", text.normalize_name("text").alias("n"))
    return norm.select("doc_id", F.length("n").cast("long").alias("chars"), F.md5("n").alias("digest"))


# Names with marks, ampersands, legal forms and accents, made from the tables themselves.
COMPANY_NAMES = """
    select s_suppkey as id, '  ' || s_name || case s_nationkey % 6 when 0 then ' & Söhne GmbH' when 1 then ', Inc. Ltd'
           when 2 then ' + Partners' when 3 then ' Création Co.' when 4 then '''s  Straße-Studio AG' else ' Group' end as name
    from supplier
    union all
    select 1000000000 + p_partkey, p_name || ' ' || p_brand || case p_size % 4 when 0 then ' Architects Pty. Ltd.'
           when 1 then ' Łódź Lab' when 2 then ' Co Company' else ' sarl' end
    from part"""


@query("normalize_names", f"select id, {sp.normalize('name')} as normalized from ({COMPANY_NAMES})")
def _(s):
    return s.sql(COMPANY_NAMES).select("id", text.normalize_name("name").alias("normalized"))


@query("slugs", f"select id, {sp.slug(sp.normalize('name'))} as slug from ({COMPANY_NAMES})")
def _(s):
    return s.sql(COMPANY_NAMES).select("id", text.slugify("name").alias("slug"))


@query("name_aliases", f"""
    select distinct id, unnest({sp.aliases('n')}) as alias from (select id, {sp.normalize('name')} as n from ({COMPANY_NAMES}))""")
def _(s):
    return s.sql(COMPANY_NAMES).select("id", F.explode(text.name_aliases("name")).alias("alias"))


@query("role_slugs", """
    select distinct role, regexp_replace(regexp_replace(lower(role), '[^a-z0-9]+', '-', 'g'), '-+$', '') as slug
    from v_people where role is not null""")
def _(s):
    return s.people.where(F.col("role").isNotNull()).select("role", text.role_slug("role").alias("slug")).distinct()


COUNTRY_VALUES = ", ".join(f"({sp.quoted(k)}, '{v}')" for k, v in sorted(geo.country_map().items()))


@query("country_codes", f"""
    with m as (select * from (values {COUNTRY_VALUES}) t(k, code))
    select id, country, code as iso_code from v_firms left join m on k = upper(trim(country))""")
def _(s):
    return geo.with_country_code(s.firms.select("id", "country"), "country")


@query("backfill_country_codes", f"""
    with m as (select * from (values {COUNTRY_VALUES}) t(k, code))
    select id, coalesce(country_code, code) as country_code from v_firms left join m on k = upper(trim(country))""")
def _(s):
    from plinth.operators.quality import backfill_country_codes
    return backfill_country_codes(s.firms).select("id", "country_code")


@query("unmatched_countries", f"""
    with m as (select * from (values {COUNTRY_VALUES}) t(k, code))
    select trim(country) as country, count(*) as count from v_firms
    where country is not null and country_code is null and upper(trim(country)) not in (select k from m) group by 1""")
def _(s):
    from plinth.operators.quality import unmatched_countries
    return unmatched_countries(s.firms)


NATIONALITIES = """
    select o_orderkey as id, case o_orderkey % 8 when 0 then 'Japan' when 1 then 'France/Germany' when 2 then ' United Kingdom '
           when 3 then 'Bahrain' when 4 then 'Atlantis' when 5 then '' when 6 then 'Scotland / USA'
           when 7 then cast(null as string) end as nationality from orders"""


@query("nationality_codes", f"""
    select id,
      case o when '' then null when 'Japan' then 'JP' when 'France/Germany' then 'FR' when ' United Kingdom ' then 'GB'
             when 'Bahrain' then 'BA' when 'Atlantis' then 'AT' when 'Scotland / USA' then 'SC' end as award_code,
      case o when 'Japan' then 'JP' when 'France/Germany' then 'FR' when ' United Kingdom ' then 'GB'
             when 'Bahrain' then 'BH' when 'Scotland / USA' then 'GB' end as edition_code
    from (select id, nationality as o from ({NATIONALITIES}))""")
def _(s):
    return s.sql(NATIONALITIES).select(
        "id", geo.nationality_code("nationality", "award").alias("award_code"),
        geo.nationality_code("nationality", "edition").alias("edition_code"))


@query("map_country_codes", """
    select id, case when length(country) = 2 then upper(country) when upper(country) in ('DE', 'JP') then upper(country) end as code
    from v_firms""")
def _(s):
    return s.firms.select("id", geo.map_country_code("country").alias("code"))


@query("country_and_location_labels", """
    select id, case upper(country_code) when 'DE' then 'Germany' when 'JP' then 'Japan' end as country_name,
           concat_ws(', ', nullif(city, ''), nullif(country, '')) as location,
           case sector when 'multidisciplinary' then 'technology' else sector end as path from v_firms""")
def _(s):
    return s.firms.select(
        "id", geo.country_label("country_code").alias("country_name"),
        text.location_label("city", "country").alias("location"), text.sector_path("sector").alias("path"))


DATED = """select doc_id, text || ' ' || cast(1890 + doc_id % 230 as string) || ' x' || cast(doc_id as string) as body from documents"""


@query("years_of_texts", f"""
    select doc_id, try_cast(nullif(regexp_extract(body, '\\b(19\\d{{2}}|20\\d{{2}})\\b', 1), '') as int) as year from ({DATED})""")
def _(s):
    return s.sql(DATED).select("doc_id", text.year_of("body").alias("year"))


NOTED = """select o_orderkey as id, ' ,' || o_orderpriority || '[' || cast(o_orderkey as string) || '] Name (' || o_orderstatus
           || ') (x) ; ' as cell from orders"""


@query("clean_recipients", f"""
    select id, trim(regexp_replace(regexp_replace(cell, '\\[.*?\\]', '', 'g'), '\\(.*?\\)', '', 'g'), ' ,;') as name from ({NOTED})""")
def _(s):
    return s.sql(NOTED).select("id", text.clean_recipient("cell").alias("name"))


@query("relevant_institutions", f"""
    select id, {sp.contains_any('name', filters.RELEVANT_INSTITUTION_WORDS)} as relevant from ({COMPANY_NAMES})""")
def _(s):
    return s.sql(COMPANY_NAMES).select("id", filters.relevant_institution("name").alias("relevant"))


@query("irrelevant_firms", f"""
    select id, {sp.contains_any('display_name', filters.QUALITY_IRRELEVANT_WORDS)} as hidden,
           {sp.contains_any('display_name', filters.AUDIT_IRRELEVANT_WORDS)} as flagged from v_firms""")
def _(s):
    return s.firms.select(
        "id", filters.irrelevant_firm("display_name", filters.QUALITY_IRRELEVANT_WORDS).alias("hidden"),
        filters.irrelevant_firm("display_name", filters.AUDIT_IRRELEVANT_WORDS).alias("flagged"))


@query("junk_names_and_slugs", """
    select id, regexp_matches(display_name, '^\\d+$') or regexp_matches(display_name, '^[A-Za-z]$')
           or regexp_matches(display_name, '^[^\\p{L}\\p{N}_]+$') or length(display_name) < 2 as junk,
           regexp_matches(slug, '--|[^a-z0-9-]|^-|-$') as bad from v_firms""")
def _(s):
    return s.firms.select("id", filters.junk_name("display_name").alias("junk"), filters.bad_slug("slug").alias("bad"))


FIRM_FIELDS = sp.points(*[(sp.has(c), 1) for c in
                          ["country", "city", "website", "founded_year", "short_description", "size_range"]])
PERSON_FIELDS = sp.points(*[(sp.has(c), 1) for c in ["role", "title", "nationality", "bio", "current_firm_id"]])


@query("thin_firms", f"select id, {FIRM_FIELDS} as filled, {FIRM_FIELDS} < 2 as thin from v_firms")
def _(s):
    return s.firms.select("id", filters.filled_firm_fields().alias("filled"), filters.thin_firm().alias("thin"))


@query("thin_people", f"select id, {PERSON_FIELDS} as filled, {PERSON_FIELDS} < 2 as thin from v_people")
def _(s):
    return s.people.select("id", filters.filled_person_fields().alias("filled"), filters.thin_person().alias("thin"))


CONTENT = sp.points(*[(sp.has(c), 1) for c in ["short_description", "country", "city", "website", "founded_year"]])


@query("noindex_firms", f"""
    select id, {CONTENT} + case when id in (select firm_id from v_firm_people) then 1 else 0 end < 3
           or publish_status <> 'published' as noindex from v_firms""")
def _(s):
    return filters.noindex_firms(s.firms, s.firm_people).select("id", "noindex")


SPOTS = "select o_orderkey as id, cast(o_orderkey * 37 % 181 - 90 as double) as latitude, cast(o_orderkey * 53 % 361 - 180 as double) as longitude from orders"
REGION_VALUES = ", ".join(f"({sp.quoted(n)}, {a}, {b}, {c}, {d})" for n, a, b, c, d in filters.REGIONS)


@query("assign_regions", f"""
    select id, region from ({SPOTS}) join (values {REGION_VALUES}) r(region, south, west, north, east)
    on latitude between south and north and longitude between west and east""")
def _(s):
    return filters.assign_regions(s.sql(SPOTS)).select("id", "region")


IMAGE_URLS = """
    select page_id as id, split_part(split_part(url, '?', 1), '#', 1) || case page_id % 9 when 0 then '/logo-big.png'
      when 1 then '/files/styles/wide/a.jpg' when 2 then '/hero-1600x900.jpg' when 3 then '/shot-640x480.jpg'
      when 4 then '/a_thumb.jpg' when 5 then '/my-icon.svg' when 6 then '/thumbs/x.jpg' when 7 then '/photo.jpg'
      else '/favicon.ico' end || '?v=logo' as image from pages"""


@query("valid_image_urls", f"""
    with p as (select id, image, lower(regexp_extract(image, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) as path from ({IMAGE_URLS})),
    n as (select *, regexp_extract(path, '([^/]*)$', 1) as file from p)
    select id, not (regexp_matches(file, '^(logo[._-]|favicon|placeholder)|sprite\\.|icon-|-icon\\.|placeholder|_thumb|-thumb\\.')
      or regexp_matches(path, '/styles/|/thumbs/|sitesv|/favicon')
      or coalesce(try_cast(nullif(regexp_extract(file, '[-_](\\d{{2,3}})x\\d{{2,3}}', 1), '') as int) < 800, false)) as valid from n""")
def _(s):
    return s.sql(IMAGE_URLS).select("id", filters.valid_image_url("image").alias("valid"))


@query("entity_kinds", f"""
    select id, case when {sp.contains_any('name', ["architects", "studio", "associates", "partners", "group", "office", "practice", "atelier", "workshop"])}
    then 'firm' else 'person' end as kind from ({COMPANY_NAMES})""")
def _(s):
    from plinth.sources.award_tables import entity_kind
    return s.sql(COMPANY_NAMES).select("id", entity_kind("name").alias("kind"))


SECTOR_HITS = {k: sp.count_words("text", w) for k, w in scoring.SECTOR_WORDS.items()}


@query("classify_sectors", f"""
    with h as (select doc_id, {SECTOR_HITS['architecture']} as a, {SECTOR_HITS['design']} as d, {SECTOR_HITS['technology']} as t
               from (select doc_id, text || case doc_id % 5 when 0 then ' urban design' when 1 then ' Smart robot housing'
                     when 2 then ' graphic material building' else '' end as text from documents))
    select doc_id, case when a > 0 and a >= d and a >= t then 'architecture' when d > 0 and d >= t then 'design' else 'technology' end as sector
    from h""")
def _(s):
    topics = F.concat("text", F.when(F.col("doc_id") % 5 == 0, F.lit(" urban design"))
                      .when(F.col("doc_id") % 5 == 1, F.lit(" Smart robot housing"))
                      .when(F.col("doc_id") % 5 == 2, F.lit(" graphic material building")).otherwise(F.lit("")))
    return s.base("documents").select("doc_id", scoring.classify_sector(F.array(topics)).alias("sector"))


TAGGED = """select doc_id, text || case doc_id % 7 when 0 then ' a Timber and glass pavilion near a hotel, an airport bridge with steel'
    when 1 then ' social housing' when 2 then ' Museum church mosque' else '' end as body from documents"""
TAG_CASES = ", ".join(f"case when contains(lower(body), {sp.quoted(w)}) then {sp.quoted(t)} end" for w, t in extract.TAG_WORDS)


@query("keyword_tags", f"""
    with f as (select doc_id, list_filter([{TAG_CASES}], lambda t: t is not null) as tags from ({TAGGED})),
    u as (select doc_id, unnest(tags) as tag, generate_subscripts(tags, 1) as pos from f),
    d as (select doc_id, tag, min(pos) as pos from u group by all),
    r as (select doc_id, tag, cast(row_number() over (partition by doc_id order by pos) as int) as place from d)
    select * from r""")
def _(s):
    found = s.sql(TAGGED).select("doc_id", F.posexplode(extract.keyword_tags("body")).alias("pos", "tag"))
    return found.select("doc_id", "tag", (F.col("pos") + 1).alias("place"))


DESCRIBED = """select doc_id, split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3) as name, text as body,
    case when doc_id % 2 = 0 then 'firm' else 'person' end as kind from documents"""


def _sentence_sql(kind: str, words: list[str]) -> str:
    return f"""
    with sents as (
      select doc_id, lower(name) as name, unnest(parts) as raw, generate_subscripts(parts, 1) as pos
      from (select doc_id, name, regexp_split_to_array(body, '[.!?]+') as parts from ({DESCRIBED}) where kind = '{kind}')),
    t as (select doc_id, name, pos, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') as sentence from sents),
    k as (select *, row_number() over (partition by doc_id order by pos) as place from t where length(sentence) > 30),
    sc as (select doc_id, sentence, place,
      case when contains(lower(sentence), name) then 10
           when len(list_filter(string_split(name, ' '), lambda p: length(p) > 3 and contains(lower(sentence), p))) > 0 then 5 else 0 end
      + 2 * {sp.count_words('sentence', words)}
      - case when {sp.contains_any('sentence', extract.FURNITURE_WORDS)} then 20 else 0 end
      - case when length(sentence) > 300 then 3 else 0 end as score from k),
    b as (select doc_id, sentence, row_number() over (partition by doc_id order by score desc, place) as rn, score from sc),
    l as (select doc_id, regexp_replace(regexp_replace(sentence || '.', '\\s+', ' ', 'g'), '^[^A-Z]*', '') as line
          from b where rn = 1 and score > 0)
    select doc_id, line as summary from l where length(line) >= 30"""


@query("summary_sentences", _sentence_sql("firm", extract.FIRM_SENTENCE_WORDS) + " union all select * from ("
       + _sentence_sql("person", extract.PERSON_SENTENCE_WORDS) + ")")
def _(s):
    df = s.sql(DESCRIBED)
    parts = [extract.summary_sentences(df.where(F.col("kind") == k), "doc_id", "name", "body", k) for k in ("firm", "person")]
    return parts[0].unionByName(parts[1])


def _page_text_sql() -> str:
    out = "html"
    for element in pages.DROPPED_ELEMENTS:
        out = f"regexp_replace({out}, '(?is)<{element}\\b.*?</{element}\\s*>', ' ', 'g')"
    out = f"regexp_replace({out}, '(?s)<!--.*?-->', ' ', 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', ' ', 'g')"
    for entity, plain in pages.ENTITIES:
        out = f"replace({out}, {sp.quoted(entity)}, {sp.quoted(plain)})"
    return sp.collapse(out)


@query("page_texts", f"select page_id, length(t) as chars, md5(t) as digest from (select page_id, {_page_text_sql()} as t from pages)")
def _(s):
    plain = s.base("pages").select("page_id", pages.page_text("html", None).alias("t"))
    return plain.select("page_id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("digest"))


@query("site_domains", """
    select page_id, replace(coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ''), url), 'www.', '') as domain,
           case when regexp_matches(url, '^https?://') then url else 'https://' || url end as full_url,
           contains(replace(lower(url), ' ', ''), replace(lower('Tion Tion'), ' ', '')) as named
    from (select page_id, case when page_id % 4 = 0 then regexp_replace(url, '^https?://', 'www.') else url end as url from pages)""")
def _(s):
    url = F.when(F.col("page_id") % 4 == 0, F.regexp_replace("url", "^https?://", "www.")).otherwise(F.col("url"))
    return s.base("pages").select("page_id", url.alias("url")).select(
        "page_id", text.site_domain("url").alias("domain"), text.ensure_scheme("url").alias("full_url"),
        text.name_in_url(F.lit("Tion Tion"), "url").alias("named"))


@query("commons_paths", """
    with f as (select p_partkey, replace(p_name || ' ' || p_brand || '.jpg', ' ', '_') as f from part)
    select p_partkey, substr(md5(f), 1, 1) || '/' || substr(md5(f), 1, 2) || '/' || f as path from f""")
def _(s):
    name = F.concat("p_name", F.lit(" "), "p_brand", F.lit(".jpg"))
    return s.base("part").select("p_partkey", text.commons_path(name).alias("path"))


@query("trigram_similarity", f"""
    with t as (select p_partkey, {sp.trigrams('p_name')} as a, {sp.trigrams("p_brand || ' ' || p_type || ' ' || p_name")} as b from part)
    select p_partkey, cast(len(a) as int) as grams, round({sp.jaccard('a', 'b')}, 6) as sim from t""")
def _(s):
    other = F.concat_ws(" ", "p_brand", "p_type", "p_name")
    return s.base("part").select(
        "p_partkey", F.size(similarity.trigrams("p_name")).alias("grams"),
        F.round(similarity.similarity("p_name", other), 6).alias("sim"))


@query("seo_descriptions", """
    select 'firm' as kind, id, coalesce(nullif(short_description, ''), display_name || ' is a ' || sector || ' firm'
      || case when concat_ws(', ', nullif(city, ''), nullif(country, '')) = '' then ''
              else ' based in ' || concat_ws(', ', nullif(city, ''), nullif(country, '')) end || '.') as description from v_firms
    union all
    select 'person', id, coalesce(nullif(substr(bio, 1, 160), ''), display_name || ' — ' || coalesce(nullif(role, ''), sector)) from v_people""")
def _(s):
    firms = s.firms.select(F.lit("firm").alias("kind"), "id", scoring.firm_seo_description().alias("description"))
    people = s.people.select(F.lit("person").alias("kind"), "id", scoring.person_seo_description().alias("description"))
    return firms.unionByName(people)


@query("confidence_scores", f"""
    with e as (select id, display_name, sector, founded_year, city, country, short_description as d, website as w, image_url as i from v_firms),
    n as (select *, replace({sp.normalize('display_name')}, ' ', '') as squashed from e)
    select id, round((case when length(d) >= 50 then 20 when length(d) >= 30 then 10 else 0 end
      + case when {sp.has('d')} and contains(lower(d), lower(display_name)) then 10 else 0 end
      + case when {sp.has('w')} then 15 else 0 end
      + case when {sp.has('w')} and contains(regexp_replace(lower(w), '[-.]', '', 'g'), squashed) then 5 else 0 end
      + case when {sp.has('i')} then 10 else 0 end + case when {sp.has('country')} then 5 else 0 end
      + case when {sp.has('sector')} then 5 else 0 end + case when {sp.has('founded_year')} then 5 else 0 end
      + case when {sp.has('city')} then 5 else 0 end + case when id % 3 = 0 then 6 else 0 end) / 100.0, 6) as confidence from n""")
def _(s):
    tags = F.when(F.col("id") % 3 == 0, F.array(F.lit("housing"), F.lit("timber construction")))
    found = s.firms.withColumn("found_tags", tags).withColumnsRenamed(
        {"short_description": "description", "website": "found_website", "image_url": "found_image"})
    return found.select("id", F.round(scoring.confidence("firm"), 6).alias("confidence"))


@query("cut_and_work_urls", """
    select id, coalesce(nullif(coalesce(url, ''), ''), 'doc:' || cast(id as varchar)) as url, substr(title, 1, 500) as title from v_sources""")
def _(s):
    from plinth.sources.works import work_url
    return s.sources.select("id", work_url("url", F.concat(F.lit("doc:"), F.col("id").cast("string"))).alias("url"),
                            text.cut("title", 500).alias("title"))


@query("confidence_people", f"""
    select id, round(least(c + case when id % 4 = 0 then 0.1 else 0 end, 1.0), 6) as confidence from (
      select id, (case when length(bio) >= 50 then 20 when length(bio) >= 30 then 10 else 0 end
        + case when {sp.has('bio')} and contains(lower(bio), lower(display_name)) then 10 else 0 end
        + case when {sp.has('image_url')} then 10 else 0 end + case when {sp.has('sector')} then 5 else 0 end
        + case when {sp.has('role')} then 5 else 0 end + case when {sp.has('nationality')} then 5 else 0 end) / 100.0 as c from v_people)""")
def _(s):
    found = s.people.withColumnsRenamed({"bio": "description", "image_url": "found_image"}).withColumns({
        "found_website": F.lit(None).cast("string"), "found_tags": F.lit(None).cast("array<string>")})
    score = scoring.boosted(scoring.confidence("person"), F.col("id") % 4 == 0)
    return found.select("id", F.round(score, 6).alias("confidence"))
