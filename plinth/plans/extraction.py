"""Extraction from pages and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.functions import extract, pages
from plinth.plans import sqlparts as sp
from plinth.plans.registry import query

# Pages of the page table with images, captions and share tags put in.
SITE = """
    select page_id, 'https://site' || cast(page_id as string) || '.example.com/a/b.html' as base,
           replace(html, '</head>', '<meta property="og:image" content="https://cdn.example.com/' || cast(page_id as string) || '.jpg?width=800&amp;quality=70">'
             || '<meta name="twitter:image" content="https://cdn.example.com/t.jpg">' || case when page_id % 3 = 0 then '<meta name="author" content=" Ann Lens ">' else '' end || '</head>')
           || repeat('<img src="plain.jpg">', 40) || '<img id="credit" src="void.jpg">' || '<div class="hero"><img src="/hero' || cast(page_id as string) || '.jpg"></div><img srcset="s.jpg 400w, big' || cast(page_id as string)
           || '.jpg 1200w"><p><img src="pic-1600x900.jpg"><img src="pic-600x400.jpg"><img src="logo-1600x900.png"></p>'
           || case when page_id % 3 = 1 then '<figcaption>Photo by: Max  Frame</figcaption>' else '' end as html
    from pages"""


@query("image_candidates", f"""
    with p as (select page_id, base, 'https://site' || page_id || '.example.com' as host from ({SITE})),
    c as (select page_id, 1 as priority, 'srcset 1200w' as kind, host || '/a/big' || page_id || '.jpg' as url from p
      union all select page_id, 2, 'hero img', host || '/hero' || page_id || '.jpg' from p
      union all select page_id, 3, 'large img (1600x900)', host || '/a/pic-1600x900.jpg' from p
      union all select page_id, 4, 'og:image bumped', 'https://cdn.example.com/' || page_id || '.jpg?width=1600&quality=90' from p
      union all select page_id, 5, 'og:image', 'https://cdn.example.com/' || page_id || '.jpg?width=800&quality=70' from p
      union all select page_id, 6, 'twitter:image', 'https://cdn.example.com/t.jpg' from p)
    select page_id, cast(priority as int) as priority, kind, url from c""")
def _(s):
    facts = s.sql(SITE).select("page_id", "base", pages.page_facts("html").alias("facts"))
    found = facts.select("page_id", F.explode(pages.image_candidates("facts", "base")).alias("i"))
    return found.select("page_id", "i.priority", "i.kind", "i.url")


@query("photo_credits", f"""
    select page_id, case page_id % 3 when 0 then 'Ann Lens' when 1 then 'Max Frame' end as credit from ({SITE})""")
def _(s):
    facts = s.sql(SITE).select("page_id", "html", pages.page_facts("html").alias("facts"))
    return facts.select("page_id", pages.photo_credit("facts", "html").alias("credit"))


CDN = """select o_orderkey as id, 'https://cdn.example.com/i.jpg?' || case o_orderkey % 6 when 0 then 'w=400' when 1 then 'width=1200&height=900'
    when 2 then 'size=large' when 3 then 'quality=60&x=1' when 4 then 'w=2000&quality=95' else 'a=b' end || '#f' as url from orders"""


@query("bump_cdn_width", f"""
    select id, 'https://cdn.example.com/i.jpg?' || case id % 6 when 0 then 'w=1600' when 1 then 'width=1600&height=900' when 2 then 'size=large'
      when 3 then 'quality=90&x=1' when 4 then 'w=2000&quality=95' else 'a=b' end || '#f' as url from ({CDN})""")
def _(s):
    return s.sql(CDN).select("id", pages.bump_cdn_width("url").alias("url"))


BIOS = """
    select doc_id, text || case doc_id % 4
        when 0 then '. She studied urban design at MIT where she met people. He holds a MArch from Yale School of Architecture in 1998! Later a PhD at Yale School of Architecture in 2004.'
        when 1 then chr(10) || 'Graduated from the University of Tokyo in architecture, BArch 1987. Educated at ETH Zurich' || chr(10) || 'Diploma of the Bauhaus 1925'
        when 2 then '. No schooling is mentioned here' else '. A master of Pratt Institute from 2011' end as bio from documents"""


@query("extract_education", f"""
    with e(r, institution_name, degree, field, end_year) as (values
      (0, 'MIT', null, 'Urban Design', null), (0, 'Yale School of Architecture', 'MArch', 'Architecture', 1998),
      (1, 'University of Tokyo', 'BArch', 'Architecture', 1987), (1, 'ETH Zurich', null, null, null), (1, 'Bauhaus', 'Diploma', null, null),
      (3, 'Pratt Institute', null, null, 2011))
    select doc_id, institution_name, degree, field, cast(end_year as int) as end_year from ({BIOS}) join e on r = doc_id % 4""")
def _(s):
    return extract.extract_education(s.sql(BIOS), "doc_id", "bio")


CREDITS = """select o_orderkey as id, case o_orderkey % 5 when 0 then 'x Photo by Jane Doe' when 1 then 'All rights © 2020 Max Frame. More'
    when 2 then 'courtesy of Studio North, Oslo' when 3 then 'shot by Ann Lee.' else 'nothing here' end as body from orders"""


@query("credits_in_text", f"""
    select id, case id % 5 when 0 then 'Jane Doe' when 1 then 'Max Frame' when 2 then 'Studio North' when 3 then 'Ann Lee' end as credit from ({CREDITS})""")
def _(s):
    return s.sql(CREDITS).select("id", extract.credit_in_text("body").alias("credit"))
