"""Bibliographic works: nested JSON to sources, institutions, authors and their edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.geo import last_segment
from plinth.functions.scoring import classify_sector
from plinth.functions.text import as_col, blank_to_null, has, let
from plinth.operators.filters import relevant_institution

WORK = (
    "id string, title string, doi string, publication_year int, "
    "topics array<struct<display_name:string>>, concepts array<struct<display_name:string,level:int>>, "
    "authorships array<struct<author:struct<id:string,display_name:string,orcid:string>,"
    "institutions:array<struct<display_name:string,country_code:string>>>>"
)


def parse_works(df: DataFrame, column: str = "value") -> DataFrame:
    """JSON texts as works. Each is parsed once: a plain `from_json` would be put into every filter and
    column behind it by the optimizer, and run again for each."""
    return df.select(F.inline(F.array(F.from_json(column, WORK))))


def work_url(doi: Column | str, work_id: Column | str) -> Column:
    return F.coalesce(blank_to_null(doi), blank_to_null(work_id))


def topics_of(topics: Column | str = "topics", concepts: Column | str = "concepts") -> Column:
    """Topic names, else names of concepts of level 2 or lower; a missing level is too high."""
    every = F.filter(F.transform(as_col(topics), lambda t: t["display_name"]), lambda n: F.length(n) > 0)
    broad = F.filter(as_col(concepts), lambda c: F.coalesce(c["level"], F.lit(99)) <= 2)
    fallback = F.filter(F.transform(broad, lambda c: c["display_name"]), lambda n: F.length(n) > 0)
    none = F.array().cast("array<string>")
    return let(every, lambda named: F.when(F.size(F.coalesce(named, none)) > 0, named).otherwise(F.coalesce(fallback, none)))


def first_relevant(institutions: Column | str) -> Column:
    return F.get(F.filter(as_col(institutions), lambda i: relevant_institution(i["display_name"])), F.lit(0))


def usable_works(works: DataFrame) -> DataFrame:
    """Works with a title and an address, with sector and first author."""
    trimmed = works.withColumn("title", F.trim("title")).withColumn("url", work_url("doi", "id"))
    first = F.get(F.col("authorships"), F.lit(0))["author"]["display_name"]
    return trimmed.where(has("title") & F.col("url").isNotNull()).withColumns({
        "sector": classify_sector(topics_of()), "first_author": first})


def work_sources(works: DataFrame, source_name: str = "OpenAlex", sector: str | None = None) -> DataFrame:
    published = F.make_timestamp_ntz(
        F.col("publication_year"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return works.select(
        "url", "title", F.lit(source_name).alias("source_name"),
        published.alias("published_at"), F.col("first_author").alias("author"), F.lit("api").alias("source_type"),
        (F.lit(sector) if sector else F.col("sector")).alias("sector"))


def _authorships(works: DataFrame) -> DataFrame:
    return works.select("url", "sector", F.posexplode("authorships").alias("author_no", "a"))


def work_institutions(works: DataFrame) -> DataFrame:
    """(url, name, country_code, sector): distinct relevant institutions of each work, first mention wins."""
    every = F.flatten(F.transform("authorships", lambda a: a["institutions"]))
    trimmed = F.transform(every, lambda i: F.struct(
        F.trim(i["display_name"]).alias("name"), i["country_code"].alias("country_code")))
    first = let(trimmed, lambda held: let(F.transform(held, lambda i: i["name"]), lambda names: F.filter(
        held, lambda i, at: F.array_position(names, i["name"]) == at + 1)))
    rows = works.select("url", "sector", F.explode(first).alias("i"))
    relevant = rows.where(has("i.name") & relevant_institution("i.name"))
    return relevant.select("url", "i.name", blank_to_null("i.country_code").alias("country_code"), "sector")


def work_authors(works: DataFrame, mode: str = "topic") -> DataFrame:
    """(url, author_no, name, orcid, author_id, sector).

    `topic` mode keeps authors with a relevant institution; `venue` mode keeps all names of four
    characters or more.
    """
    rows = _authorships(works).withColumn("name", F.trim("a.author.display_name")).where(has("name"))
    if mode == "topic":
        rows = rows.where(first_relevant("a.institutions").isNotNull())
    else:
        rows = rows.where(F.length("name") >= 4)
    orcid = F.when(has("a.author.orcid"), last_segment("a.author.orcid"))
    return rows.select("url", "author_no", "name", orcid.alias("orcid"), F.col("a.author.id").alias("author_id"), "sector")


def author_affiliations(works: DataFrame, mode: str = "topic") -> DataFrame:
    """(url, author_no, name, institution, country_code): each author's first relevant institution."""
    rows = _authorships(works).withColumn("name", F.trim("a.author.display_name")).where(has("name"))
    if mode == "venue":
        rows = rows.where(F.length("name") >= 4)
    placed = rows.withColumn("i", first_relevant("a.institutions"))
    if mode == "topic":
        placed = placed.where(F.col("i").isNotNull())
    return placed.select(
        "url", "author_no", "name", F.col("i.display_name").alias("institution"),
        blank_to_null("i.country_code").alias("country_code"))


def flatten_works(works: DataFrame, mode: str = "topic", source_name: str = "OpenAlex") -> dict[str, DataFrame]:
    """The four outputs of a works table."""
    usable = usable_works(works)
    fixed = "technology" if mode == "venue" else None
    return {
        "sources": work_sources(usable, source_name, fixed),
        "institutions": work_institutions(usable),
        "authors": work_authors(usable, mode),
        "affiliations": author_affiliations(usable, mode),
    }
