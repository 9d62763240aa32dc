"""Detail views: entities with what hangs on them, nested in bounded parts or as flat rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.packing import listed_texts, packed_text
from plinth.functions.scoring import firm_seo_description
from plinth.functions.text import blank_to_null, has, location_label, sector_path
from plinth.operators.filters import active
from plinth.operators.ranking import top_n
from plinth.session import bounded_batches, write_once

PART_SIZE = 1000


def nest(df: DataFrame, key: str, item: Column, name: str, spread: str, part_size: int = PART_SIZE) -> DataFrame:
    """Items of each key as sorted arrays of about `part_size`: rows (key, part, parts, name).

    Nearly every key gets one part. A key that holds a large share of all rows gets many, dealt by
    the hash of `spread`, so no task and no row holds an unbounded group and nothing is left out.
    Only keys of more than one part are counted into `sizes`, so the planner can send it to where
    the rows are instead of gathering the rows of a key first.
    """
    sizes = df.groupBy(F.col(key).alias("_key")).agg(F.ceil(F.count("*") / part_size).cast("int").alias("parts")).where("parts > 1")
    dealt = (
        df.where(F.col(key).isNotNull()).select(key, spread, item.alias("_item"))
        .join(sizes, F.col(key) == F.col("_key"), "left").withColumn("parts", F.coalesce("parts", F.lit(1))).drop("_key")
    )
    part = F.pmod(F.xxhash64(spread), F.col("parts")).cast("int")
    return (
        dealt.withColumn("part", part).groupBy(key, "parts", "part")
        .agg(F.sort_array(F.collect_list("_item")).alias(name))
    )


def with_nested(df: DataFrame, nested: DataFrame, key: str, name: str) -> DataFrame:
    """Left join of nested parts: an entity without items keeps one row with an empty array."""
    empty = F.array().cast(nested.schema[name].dataType)
    return (
        df.join(nested, key, "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("part", F.coalesce("part", F.lit(0)))
        .withColumn(name, F.coalesce(name, empty))
    )


#: Groups that rows without a key are dealt into.
UNKEYED = 1024


def left_join(df: DataFrame, right: DataFrame, key: str, spread: list[str]) -> DataFrame:
    """Left join in which rows without a key, that meet nothing, are dealt by `spread`: a shuffle by the key
    alone sends them all to one task. Their `_deal` differs, that of rows with a key is 0 on both sides;
    it is worked out from the key on the right, as a constant there would be folded out of the join."""
    dealt = df.withColumn("_deal", F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*spread), F.lit(UNKEYED))).otherwise(F.lit(0).cast("long")))
    return dealt.join(right.withColumn("_deal", F.pmod(F.xxhash64(key), F.lit(1))), [key, "_deal"], "left").drop("_deal")


def firm_members(firm_people: DataFrame, people: DataFrame) -> DataFrame:
    """(firm_id, role, is_current, person columns): one row per link."""
    person = people.select(
        F.col("id").alias("person_id"), F.col("slug").alias("person_slug"),
        F.col("display_name").alias("person_name"))
    return firm_people.select("firm_id", "person_id", "role", "is_current").join(person, "person_id")


def firm_detail(firms: DataFrame, firm_people: DataFrame, people: DataFrame, part_size: int = PART_SIZE) -> DataFrame:
    """Firms with their people as arrays of (person_id, name, slug, role, is_current)."""
    item = F.struct("person_id", F.col("person_name").alias("name"), F.col("person_slug").alias("slug"), "role", "is_current")
    nested = nest(firm_members(firm_people, people), "firm_id", item, "people", "person_id", part_size)
    return with_nested(firms, nested.withColumnRenamed("firm_id", "id"), "id", "people")


def person_with_firm(people: DataFrame, firms: DataFrame) -> DataFrame:
    """Every person with the current firm as a struct, NULL without one."""
    firm = firms.select(
        F.col("id").alias("current_firm_id"), F.struct("display_name", "slug", "sector").alias("firm"))
    return left_join(people, firm, "current_firm_id", ["id"])


def award_detail(
    awards: DataFrame, recipients: DataFrame, firms: DataFrame, people: DataFrame, part_size: int = PART_SIZE,
) -> DataFrame:
    """Awards with recipients as arrays of (year, project_name, firm, person)."""
    firm = firms.select(F.col("id").alias("firm_id"), F.struct("id", "slug", "display_name").alias("firm"))
    person = people.select(F.col("id").alias("person_id"), F.struct("id", "slug", "display_name").alias("person"))
    with_firm = left_join(recipients, firm, "firm_id", ["award_id", "person_id"])
    full = left_join(with_firm, person, "person_id", ["award_id", "firm_id"]).withColumn(
        "_spread", F.xxhash64("firm_id", "person_id", "year", "project_name"))
    item = F.struct("year", "project_name", "firm", "person")
    nested = nest(full, "award_id", item, "recipients", "_spread", part_size)
    return with_nested(awards, nested.withColumnRenamed("award_id", "id"), "id", "recipients")


def aliases_of(entities: DataFrame, aliases: DataFrame, entity_type: str, part_size: int = PART_SIZE) -> DataFrame:
    """(id, aliases) for all entities of a type, sorted."""
    own = aliases.where(F.col("entity_type") == entity_type)
    nested = nest(own, "entity_id", F.col("alias"), "aliases", "alias", part_size)
    return with_nested(entities.select("id"), nested.withColumnRenamed("entity_id", "id"), "id", "aliases")


def awards_of(recipients: DataFrame, awards: DataFrame, entity_type: str) -> DataFrame:
    """One row per (entity, award): year, project and the award."""
    owner = "firm_id" if entity_type == "firm" else "person_id"
    won = recipients.where(F.col(owner).isNotNull()).select(
        F.col(owner).alias("entity_id"), "award_id", F.col("year").alias("received"), "project_name")
    return won.join(awards.withColumnRenamed("id", "award_id"), "award_id")


def sources_of(links: DataFrame, sources: DataFrame, n: int = 20) -> DataFrame:
    """The latest n links of every entity that lead to a source, with their place.

    The n links are taken first; links without a source row are dropped after.
    """
    latest = top_n(links, ["entity_type", "entity_id"], [F.desc("created_at"), F.asc("source_id")], n, rank="place")
    return latest.join(sources.withColumnRenamed("id", "source_id"), "source_id")


def tags_of(entity_tags: DataFrame, tags: DataFrame, n: int = 10) -> DataFrame:
    """Up to n tags of every entity by tag slug."""
    named = entity_tags.select("entity_type", "entity_id", "tag_id").join(
        tags.select(F.col("id").alias("tag_id"), "name", "slug"), "tag_id")
    return top_n(named, ["entity_type", "entity_id"], [F.asc("slug"), F.asc("tag_id")], n, rank="place")


def entities_for_tag(
    tag_slug: str | Column, tags: DataFrame, entity_tags: DataFrame, firms: DataFrame, people: DataFrame,
) -> DataFrame:
    """Public firms and people that hold the tag, people with their firm's name."""
    holders = entity_tags.join(
        tags.where(F.col("slug") == tag_slug).select(F.col("id").alias("tag_id")), "tag_id", "left_semi")

    def holding(df: DataFrame, kind: str) -> DataFrame:
        ids = holders.where(F.col("entity_type") == kind).select(F.col("entity_id").alias("id"))
        return df.join(ids, "id", "left_semi")

    shown_firms = holding(active(firms, "firm"), "firm").select(
        F.lit("firm").alias("entity_type"), "id", "display_name", F.lit(None).cast("string").alias("firm_name"))
    shown_people = person_with_firm(holding(active(people, "person"), "person"), firms).select(
        F.lit("person").alias("entity_type"), "id", "display_name", F.col("firm.display_name").alias("firm_name"))
    return shown_firms.unionByName(shown_people).orderBy("entity_type", "display_name", "id")


def canonical_targets(firms: DataFrame) -> DataFrame:
    """Merged firms with the path of the firm they went into: one hop."""
    target = firms.select(
        F.col("id").alias("merged_into"), F.col("slug").alias("target_slug"),
        sector_path("sector").alias("target_sector"))
    merged = firms.where(F.col("merged_into").isNotNull()).select("id", "slug", "merged_into")
    return merged.join(target, "merged_into", "left")


def entity_names(firms: DataFrame, people: DataFrame) -> DataFrame:
    """Firms and people as (entity_type, entity_id, name, place)."""
    named_firms = firms.select(
        F.lit("firm").alias("entity_type"), F.col("id").alias("entity_id"), F.col("display_name").alias("name"),
        location_label("city", "country").alias("place"))
    named_people = people.select(
        F.lit("person").alias("entity_type"), F.col("id").alias("entity_id"), F.col("display_name").alias("name"),
        F.lit("").alias("place"))
    return named_firms.unionByName(named_people)


def review_context(review_queue: DataFrame, firms: DataFrame, people: DataFrame) -> DataFrame:
    """Reviews with the suggested entity as "name (place)", `none` without one."""
    names = entity_names(firms, people).withColumnRenamed("entity_id", "suggested_entity_id")
    label = F.concat("name", F.lit(" ("), F.coalesce(blank_to_null("place"), F.lit("no location")), F.lit(")"))
    return review_queue.join(names, ["entity_type", "suggested_entity_id"], "left").withColumn(
        "suggested", F.coalesce(label, F.lit("none"))).drop("name", "place")


#: Links whose titles meet in one part of `source_context` at most, and parts of fewer links that there are at least.
LINKS_OF_A_PART, LEAST_PARTS = 200_000, 64


def source_context(links: DataFrame, sources: DataFrame, n: int = 5) -> DataFrame:
    """(entity_type, entity_id, context): titles of the first n linked sources by id.

    A title may be a long text that many entities are linked with. Entities are dealt into parts by range of their
    first source, so that those of a part share titles; a title is packed once, beside its source, and moves packed and
    once for each part that needs it. Of a source that very many entities share, a part has a bounded share. A
    window gathers the n of an entity: it sorts behind the shuffle only, where an aggregate would gather, sort
    and spill before it as well.
    """
    keys = ["entity_type", "entity_id"]
    lowest = F.min("source_id").over(Window.partitionBy(*keys))
    first = write_once(top_n(links.select(*keys, "source_id"), keys, [F.asc("source_id")], n).withColumn("_first", lowest))
    bounded_batches(links.sparkSession)
    texts = sources.where(has("title")).select(F.col("id").alias("source_id"), packed_text("title").alias("_packed"))
    rows = first.count()
    parts = max(math.ceil(rows / LINKS_OF_A_PART), min(LEAST_PARTS, math.ceil(rows / 1000)), 1)
    dealt = first.repartitionByRange(parts, "_first", *keys).withColumn("_part", F.spark_partition_id())

    def gathered(df: DataFrame, by: list[str], order: list[str], item: Column, name: str) -> DataFrame:
        """One row of each group with all items in order, by a window."""
        group = Window.partitionBy(*by).orderBy(*order)
        everything = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        listed = df.select("*", F.collect_list(item).over(everything).alias(name), F.row_number().over(group).alias("_at"))
        return listed.where("_at = 1").select(*by, name)

    needed = gathered(dealt.repartition("source_id"), ["source_id", "_part"], keys, F.struct(*keys), "_entities")
    met = needed.join(texts, "source_id").repartition("_part").select("_part", "source_id", "_packed", F.inline("_entities"))
    item = F.struct(F.col("source_id").alias("place"), F.col("_packed").alias("packed"))
    listed = gathered(met, ["_part", *keys], ["source_id"], item, "_titles")
    text = F.concat(F.lit("Mentioned in: "), listed_texts("_titles"))
    return listed.select(*keys, text.alias("context"))


def multi_entity_sources(
    links: DataFrame, sources: DataFrame, firms: DataFrame, people: DataFrame, at_least: int = 2,
) -> DataFrame:
    """Links of sources that mention at least two known entities: one row per (source, entity).

    The count is taken again after names are looked up, as links may lead nowhere. A source that
    mentions very many entities stays many rows.
    """
    def busy(df: DataFrame) -> DataFrame:
        return df.groupBy("source_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= at_least).select("source_id")

    own = links.select("source_id", "entity_type", "entity_id")
    multi = own.join(busy(own), "source_id", "left_semi")
    titled = multi.join(sources.select(F.col("id").alias("source_id"), "title"), "source_id")
    named = titled.join(entity_names(firms, people).drop("place"), ["entity_type", "entity_id"])
    return named.join(busy(named), "source_id", "left_semi")


def person_education(education: DataFrame) -> DataFrame:
    """Education rows with their place on the person's page: latest start first, unknown start on top."""
    from pyspark.sql import Window

    order = Window.partitionBy("person_id").orderBy(
        F.desc_nulls_first("start_year"), F.asc("institution_name"), F.asc_nulls_first("degree"))
    return education.withColumn("place", F.row_number().over(order))


def _filled(condition: Column, value: Column) -> Column:
    return F.when(condition, value)


def _listed(
    df: DataFrame, aliases: DataFrame, recipients: DataFrame, awards: DataFrame, kind: str, part_size: int,
    *more: DataFrame,
) -> DataFrame:
    """Entities with nested aliases, awards and `more`, one row per part number that occurs."""
    own = aliases.where(F.col("entity_type") == kind)
    won = awards_of(recipients, awards, kind).select("entity_id", "award_name", "award_id")
    lists = [
        nest(own, "entity_id", F.col("alias"), "aliases", "alias", part_size),
        nest(won, "entity_id", F.struct("award_id", "award_name"), "won", "award_id", part_size),
    ]
    merged = df.select("id").withColumn("part", F.lit(0))
    for nested in [*[n.withColumnRenamed("entity_id", "id").drop("parts") for n in lists], *more]:
        merged = merged.join(nested, ["id", "part"], "full_outer")
    return df.join(merged, "id")


def firm_json_ld(
    firms: DataFrame, firm_people: DataFrame, people: DataFrame, aliases: DataFrame, recipients: DataFrame,
    awards: DataFrame, part_size: int = PART_SIZE,
) -> DataFrame:
    """schema.org Organization per active firm. Absent parts are left out of the document.

    Members of a very large firm are spread over several documents of the same address.
    """
    members = F.struct(F.col("person_id").alias("id"), F.col("person_name").alias("name"), "role")
    joined = _listed(
        active(firms, "firm"), aliases, recipients, awards, "firm", part_size,
        nest(firm_members(firm_people, people), "firm_id", members, "people", "person_id", part_size)
        .withColumnRenamed("firm_id", "id").drop("parts"))
    member = F.transform("people", lambda p: F.struct(
        F.lit("Person").alias("@type"), p["name"].alias("name"), blank_to_null(p["role"]).alias("jobTitle")))
    place = F.length(location_label("city", "country")) > 0
    document = F.to_json(F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Organization").alias("@type"),
        F.col("display_name").alias("name"),
        _filled(F.size("aliases") > 0, F.col("aliases")).alias("alternateName"),
        blank_to_null("website").alias("url"), _filled(has("website"), F.array("website")).alias("sameAs"),
        blank_to_null("short_description").alias("description"),
        _filled(place, F.struct(
            F.lit("PostalAddress").alias("@type"), blank_to_null("city").alias("addressLocality"),
            blank_to_null("country").alias("addressCountry"))).alias("address"),
        F.col("founded_year").cast("string").alias("foundingDate"),
        _filled(F.size("people") > 0, member).alias("member"),
        _filled(F.size("won") > 0, F.transform("won", lambda w: w["award_name"])).alias("award"),
        F.col("sector").alias("knowsAbout"),
    ))
    return joined.select("id", "part", firm_seo_description().alias("description"), document.alias("json_ld"))


def person_json_ld(
    people: DataFrame, firms: DataFrame, aliases: DataFrame, recipients: DataFrame, awards: DataFrame,
    part_size: int = PART_SIZE,
) -> DataFrame:
    """schema.org Person per published person."""
    site = firms.select(F.col("id").alias("current_firm_id"), F.col("website").alias("firm_website"))
    base = person_with_firm(active(people, "person"), firms).join(site, "current_firm_id", "left")
    joined = _listed(base, aliases, recipients, awards, "person", part_size)
    document = F.to_json(F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Person").alias("@type"),
        F.col("display_name").alias("name"),
        _filled(F.size("aliases") > 0, F.col("aliases")).alias("alternateName"),
        blank_to_null("bio").alias("description"), blank_to_null("role").alias("jobTitle"),
        blank_to_null("nationality").alias("nationality"),
        _filled(F.col("firm").isNotNull(), F.struct(
            F.lit("Organization").alias("@type"), F.col("firm.display_name").alias("name"),
            blank_to_null("firm_website").alias("url"))).alias("worksFor"),
        _filled(F.size("won") > 0, F.transform("won", lambda w: w["award_name"])).alias("award"),
        F.col("sector").alias("knowsAbout"),
    ))
    return joined.select("id", "part", document.alias("json_ld"))


def award_json_ld(awards: DataFrame) -> DataFrame:
    """schema.org CreativeWork per award."""
    document = F.to_json(F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("CreativeWork").alias("@type"),
        F.col("award_name").alias("name"),
        _filled(has("organization"), F.struct(
            F.lit("Organization").alias("@type"), F.col("organization").alias("name"))).alias("creator"),
        F.col("year").cast("string").alias("dateCreated"), blank_to_null("category").alias("genre"),
    ))
    return awards.select("id", document.alias("json_ld"))
