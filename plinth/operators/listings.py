"""Listing orders, worklists and the page-address datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions.text import has, role_slug, sector_path
from plinth.operators.counts import count_firms_by_country, count_people_by_role
from plinth.operators.filters import active


def award_order() -> list[Column]:
    return [F.desc_nulls_first("year"), F.asc_nulls_last("award_name"), F.asc("id")]


def sources_order() -> list[Column]:
    return [F.desc_nulls_first("published_at"), F.asc("id")]


def people_order(sort: str = "name") -> list[Column]:
    first = F.desc("created_at") if sort == "recent" else F.asc("display_name")
    return [first, F.asc("id")]


def sources_by_name(sources: DataFrame, name: str) -> DataFrame:
    return sources.where(F.col("source_name") == name).orderBy(*sources_order())


def sources_by_sector(sources: DataFrame, sector: str, limit: int = 20) -> DataFrame:
    return sources.where(F.col("sector") == sector).orderBy(*sources_order()).limit(limit)


def needs_enrichment(kind: str) -> Column:
    if kind == "firm":
        return ~has("short_description") | ~has("website") | ~has("image_url")
    return ~has("bio") | ~has("image_url")


def select_tier(df: DataFrame, kind: str, tier: str, limit: int) -> DataFrame:
    """Top-k by quality first, then the gap filter, then the limit: in that order."""
    order = F.asc("quality_score") if tier == "tail" else F.desc("quality_score")
    pool = active(df, kind).orderBy(order, F.asc("id")).limit(limit * (3 if tier == "mid" else 2))
    return pool.where(needs_enrichment(kind)).orderBy(order, F.asc("id")).limit(limit)


def long_tail(df: DataFrame, kind: str, limit: int) -> DataFrame:
    field = "short_description" if kind == "firm" else "bio"
    return active(df, kind).where(F.col(field).isNull()).orderBy("quality_score", "id").limit(limit)


def queue_head(queue: DataFrame, limit: int, entity_type: str | None = None) -> DataFrame:
    waiting = queue.where(F.col("status") == "pending")
    if entity_type:
        waiting = waiting.where(F.col("entity_type") == entity_type)
    return waiting.orderBy("created_at", "id").limit(limit)


def image_worklist(firms: DataFrame, limit: int, offset: int = 0, sector: str | None = None) -> DataFrame:
    todo = active(firms, "firm").where(F.col("image_url").isNull() & F.col("website").isNotNull())
    if sector:
        todo = todo.where(F.col("sector") == sector)
    return todo.orderBy(F.desc("quality_score"), F.asc("id")).offset(offset).limit(limit)


def geocode_worklist(firms: DataFrame, limit: int) -> DataFrame:
    todo = firms.where(
        (F.col("publish_status") == "published") & F.col("latitude").isNull()
        & F.col("city").isNotNull() & F.col("country").isNotNull())
    return todo.orderBy("id").limit(limit)


def reconcile_worklist(df: DataFrame, kind: str) -> DataFrame:
    return active(df, kind).where(F.col("wikidata_id").isNull())


def review_worklist(review_queue: DataFrame, limit: int = 50, min_confidence: float = 0.6) -> DataFrame:
    waiting = review_queue.where((F.col("status") == "pending") & (F.col("confidence") >= min_confidence))
    return waiting.orderBy(F.desc("confidence"), F.asc("id")).limit(limit)


# Static pages as (path, change frequency, priority).
STATIC_PAGES = [
    ("", "weekly", 1.0), ("/search", "weekly", 0.8), ("/architecture", "weekly", 0.9),
    ("/design", "weekly", 0.9), ("/technology", "weekly", 0.9), ("/people", "weekly", 0.9),
    ("/awards", "monthly", 0.8), ("/firms/country", "weekly", 0.8), ("/people/role", "weekly", 0.8),
    ("/architecture/firms", "weekly", 0.8), ("/design/firms", "weekly", 0.8), ("/technology/firms", "weekly", 0.8),
]


def sitemap_urls(
    spark: SparkSession, base_url: str, firms: DataFrame, people: DataFrame, awards: DataFrame,
    modified: str = "updated_at", min_firms: int = 3,
) -> DataFrame:
    """Every public page: static, firms, people, countries with enough firms, roles, awards."""
    def rows(df: DataFrame, path: Column, frequency: str, priority: float, stamp: Column | None = None) -> DataFrame:
        stamped = stamp if stamp is not None else F.lit(None)
        return df.select(
            F.concat(F.lit(base_url), path).alias("url"), stamped.cast("string").alias("last_modified"),
            F.lit(frequency).alias("change_frequency"), F.lit(priority).alias("priority"))

    static = spark.createDataFrame(STATIC_PAGES, "path string, change_frequency string, priority double").select(
        F.concat(F.lit(base_url), "path").alias("url"), F.lit(None).cast("string").alias("last_modified"),
        "change_frequency", "priority")
    countries = count_firms_by_country(firms).where(F.col("count") >= min_firms)
    return (
        static
        .unionByName(rows(active(firms, "firm"), F.concat(F.lit("/"), sector_path("sector"), F.lit("/firms/"), "slug"),
                          "monthly", 0.7, F.col(modified)))
        .unionByName(rows(active(people, "person"), F.concat(F.lit("/people/"), "slug"), "monthly", 0.6, F.col(modified)))
        .unionByName(rows(countries, F.concat(F.lit("/firms/country/"), F.lower("country")), "weekly", 0.7))
        .unionByName(rows(count_people_by_role(people), F.concat(F.lit("/people/role/"), role_slug("role")), "weekly", 0.7))
        .unionByName(rows(awards, F.concat(F.lit("/awards/"), "slug"), "yearly", 0.6))
    )


def static_params(firms: DataFrame, people: DataFrame, tags: DataFrame, awards: DataFrame) -> DataFrame:
    """(family, sector, slug) of every prebuilt page. People are not filtered, firms are."""
    none = F.lit(None).cast("string")
    parts = [
        active(firms, "firm").select(F.lit("firms").alias("family"), sector_path("sector").alias("sector"), "slug"),
        people.select(F.lit("people").alias("family"), none.alias("sector"), "slug"),
        tags.select(F.lit("tags").alias("family"), none.alias("sector"), "slug"),
        awards.select(F.lit("awards").alias("family"), none.alias("sector"), "slug"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()
