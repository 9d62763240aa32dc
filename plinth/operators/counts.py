"""Facet counts and one-pass summaries. All are partial-then-final hash aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.text import blank_to_null, has
from plinth.operators.filters import active
from plinth.schema import PUBLISH_STATUSES, QUEUE_STATUSES, REVIEW_STATUSES, SECTORS, enum_table


def count_by(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-NULL value, most frequent first, value as tie-break."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))
    return counted.orderBy(F.desc("count"), F.asc(column))


def count_firms_by_country(firms: DataFrame) -> DataFrame:
    return count_by(active(firms, "firm"), "country")


def count_people_by_role(people: DataFrame) -> DataFrame:
    return count_by(active(people, "person"), "role")


def count_awards_by_organization(awards: DataFrame) -> DataFrame:
    return count_by(awards, "organization")


def zero_filled(df: DataFrame, column: str, members: list[str]) -> DataFrame:
    """Rows per member of an enum in declaration order, 0 for members that do not occur."""
    counted = df.groupBy(column).agg(F.count("*").alias("count"))
    return (
        enum_table(df.sparkSession, column, members)
        .join(counted, column, "left")
        .select(column, "position", F.coalesce("count", F.lit(0)).cast("long").alias("count"))
        .orderBy("position")
    )


def count_firms_by_sector(firms: DataFrame) -> DataFrame:
    return zero_filled(active(firms, "firm"), "sector", SECTORS)


def people_letters(people: DataFrame) -> DataFrame:
    first = F.substring("display_name", 1, 1)
    return (
        active(people, "person").where(first.rlike("[A-Za-z]"))
        .select(F.upper(first).alias("letter")).distinct().orderBy("letter")
    )


def entity_source_counts(links: DataFrame, ids: DataFrame, entity_type: str) -> DataFrame:
    """Links per requested id; ids without a link are absent."""
    return (
        links.where(F.col("entity_type") == entity_type)
        .join(ids.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
        .groupBy("entity_id").agg(F.count("*").alias("source_count"))
    )


def tag_counts(tags: DataFrame, entity_tags: DataFrame) -> DataFrame:
    used = entity_tags.groupBy("tag_id").agg(F.count("*").alias("entity_count"))
    return (
        tags.join(used, tags["id"] == used["tag_id"], "left").drop("tag_id")
        .withColumn("entity_count", F.coalesce("entity_count", F.lit(0)).cast("long"))
        .orderBy("name", "id")
    )


def tags_by_category(tags: DataFrame, entity_tags: DataFrame) -> DataFrame:
    """Used tags with their category (blank is "Other"), ready to be listed category by category."""
    category = F.coalesce(blank_to_null("category"), F.lit("Other"))
    return (
        tag_counts(tags, entity_tags).where(F.col("entity_count") > 0)
        .select(category.alias("category"), "name", "slug", "entity_count")
        .orderBy("category", "name", "slug")
    )


def category_sizes(tags: DataFrame, entity_tags: DataFrame) -> DataFrame:
    return (
        tags_by_category(tags, entity_tags).groupBy("category")
        .agg(F.count("*").alias("tags"), F.sum("entity_count").alias("entities")).orderBy("category")
    )


def home_stats(firms: DataFrame, people: DataFrame, awards: DataFrame, sources: DataFrame) -> DataFrame:
    """(metric, value) rows: firms per sector and in all, published people, awards, sources."""
    sectors = count_firms_by_sector(firms).select(
        F.concat(F.lit("firms_"), "sector").alias("metric"), F.col("count").alias("value"))

    def one(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")

    known = active(firms, "firm").where(F.col("sector").isin(SECTORS))
    return (
        sectors.unionByName(one(known, "total_firms"))
        .unionByName(one(active(people, "person"), "people"))
        .unionByName(one(awards, "awards")).unionByName(one(sources, "sources"))
    )


def counts_per_key(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(name))


def publish_status_counts(firms: DataFrame, people: DataFrame) -> DataFrame:
    def one(df: DataFrame, table: str) -> DataFrame:
        return zero_filled(df, "publish_status", PUBLISH_STATUSES).select(
            F.lit(table).alias("table"), "publish_status", "position", "count")

    return one(firms, "firms").unionByName(one(people, "people"))


def bucketed(df: DataFrame, column: str, bounds: list[tuple[str, float]], last: str) -> DataFrame:
    """Counts per named bucket, 0 for empty ones. `bounds` lists (name, lower bound) from high to low."""
    label: Column = F.lit(last)
    for name, low in reversed(bounds):
        label = F.when(F.col(column) >= low, F.lit(name)).otherwise(label)
    named = df.select(label.alias("bucket"))
    return zero_filled(named, "bucket", [name for name, _ in bounds] + [last])


def quality_histogram(firms: DataFrame) -> DataFrame:
    bounds = [("80-100", 80), ("60-79", 60), ("40-59", 40), ("20-39", 20)]
    return bucketed(firms.where(F.col("merged_into").isNull()), "quality_score", bounds, "0-19")


def confidence_histogram(review_queue: DataFrame) -> DataFrame:
    """Pending reviews per confidence bucket; NULL and 0 are left out."""
    pending = review_queue.where((F.col("status") == "pending") & (F.col("confidence") != 0))
    return bucketed(pending, "confidence", [("0.8+", 0.8), ("0.7-0.8", 0.7), ("0.6-0.7", 0.6)], "<0.6")


def queue_status_counts(enrichment_queue: DataFrame, review_queue: DataFrame) -> DataFrame:
    def one(df: DataFrame, name: str, members: list[str]) -> DataFrame:
        return zero_filled(df, "status", members).select(F.lit(name).alias("queue"), "status", "position", "count")

    return one(enrichment_queue, "enrichment", QUEUE_STATUSES).unionByName(
        one(review_queue, "review", REVIEW_STATUSES))


def source_health(cursors: DataFrame) -> DataFrame:
    """Per cursor: count, status, error flag and last run, "never" without one."""
    ran = F.col("last_run_at").cast("string")
    return cursors.select(
        "source_name", "entity_count", "status", (F.col("status") == "error").alias("failing"),
        F.coalesce(F.substring(ran, 1, 10), F.lit("never")).alias("last_run"),
    ).orderBy("source_name")


def gap_counts(firms: DataFrame, people: DataFrame, queue: DataFrame) -> DataFrame:
    """Eight gap counts as (gap, count) rows from one pass per table."""
    def missing(column: str) -> Column:
        return F.count_if(F.col(column).isNull())

    firm_gaps = active(firms, "firm").agg(
        F.count("*").alias("total_firms"), missing("short_description").alias("firms_no_desc"),
        missing("website").alias("firms_no_website"), missing("image_url").alias("firms_no_image"))
    person_gaps = active(people, "person").agg(
        F.count("*").alias("total_people"), missing("bio").alias("people_no_bio"),
        missing("image_url").alias("people_no_image"))
    waiting = queue.agg(F.count_if(F.col("status") == "pending").alias("queue_pending"))

    def rows(df: DataFrame) -> DataFrame:
        return df.unpivot([], df.columns, "gap", "count")

    return rows(firm_gaps).unionByName(rows(person_gaps)).unionByName(rows(waiting))


def exact_duplicates(firms: DataFrame) -> DataFrame:
    """Canonical names held by more than one unmerged firm, with group size and lowest id.

    Members are rows of `duplicate_members`, so a name shared by very many firms stays spread out.
    """
    live = firms.where(F.col("merged_into").isNull())
    return (
        live.groupBy("canonical_name").agg(F.count("*").alias("members"), F.min("id").alias("first_id"))
        .where(F.col("members") > 1)
    )


def duplicate_members(firms: DataFrame) -> DataFrame:
    live = firms.where(F.col("merged_into").isNull())
    groups = exact_duplicates(firms)
    return live.join(groups, "canonical_name").select("canonical_name", "members", "first_id", "id", "display_name")


def run_totals(results: DataFrame) -> DataFrame:
    """Entities, duration and failures over per-source results, and the overall outcome."""
    failed = F.count_if(has("error"))
    return results.agg(
        F.sum("entity_count").cast("long").alias("total_entities"),
        F.round(F.sum("duration_s"), 1).alias("total_duration_s"),
        failed.alias("failures"),
        F.when(failed > 0, F.lit("FAILED")).otherwise(F.lit("OK")).alias("outcome"),
    )
