"""Writing facts: education, projects, awards, and the award-to-recipient job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.text import slugify
from plinth.operators.merge import upsert
from plinth.operators.ranking import keep_first
from plinth.schema import entity_id


def upsert_education(education: DataFrame | None, rows: DataFrame, order: list[Column]) -> DataFrame:
    """Education keyed by person, institution and degree (no degree is one value); the first row stays."""
    keyed = rows.withColumn("_degree", F.coalesce("degree", F.lit("")))
    keys = ["person_id", "institution_name", "_degree"]
    if education is None:
        return keep_first(keyed, keys, order).drop("_degree")
    old = education.withColumn("_degree", F.coalesce("degree", F.lit("")))
    return upsert(old, keyed, keys, policy="keep_first", order=order).drop("_degree")


def upsert_projects(projects: DataFrame, rows: DataFrame, order: list[Column]) -> DataFrame:
    """Projects by slug; only the columns supplied are touched, and filled values are not blanked."""
    return upsert(projects, rows, ["slug"], order=order)


def award_slug() -> Column:
    """Slug of an award from its name and year; a missing year leaves the name. Never NULL, and said so, for else a join
    would test it for NULL on each row below the grouping."""
    return F.coalesce(slugify(F.concat_ws(" ", "award_name", F.col("year").cast("string"))), F.lit(""))


def award_rows(facts: DataFrame) -> DataFrame:
    """Distinct awards of the facts: slug from name and year, id from the slug. Each spelling is made a slug once."""
    spelt = facts.groupBy("award_name", "year").agg(F.min("organization").alias("organization"), F.min("prestige").alias("prestige"))
    return (
        spelt.withColumn("slug", award_slug()).groupBy("slug").agg(
            F.min("award_name").alias("award_name"), F.min("organization").alias("organization"),
            F.min("year").alias("year"), F.min("prestige").alias("prestige"))
        .withColumn("id", entity_id("award", "slug"))
    )


def with_award(facts: DataFrame, awards: DataFrame) -> DataFrame:
    """Facts with the `award_id` of their name and year among `awards`, by slug. Each spelling is made a slug once."""
    ids = awards.select(F.col("slug").alias("_slug"), F.col("id").alias("award_id"))
    spelt = facts.select("award_name", "year").distinct().withColumn("_slug", award_slug()).join(ids, "_slug")
    spelt = spelt.select(F.col("award_name").alias("_award_name"), F.col("year").alias("_year"), "award_id")
    same = F.col("award_name").eqNullSafe(F.col("_award_name")) & F.col("year").eqNullSafe(F.col("_year"))
    return facts.join(spelt, same).drop("_award_name", "_year")


def upsert_awards(awards: DataFrame, facts: DataFrame) -> DataFrame:
    """Awards with those of the facts added; a known slug is refreshed."""
    rows = award_rows(facts)
    known = awards.select("slug", F.col("id").alias("_known"))
    rows = rows.join(known, "slug", "left").withColumn("id", F.coalesce("_known", "id")).drop("_known")
    return upsert(awards, rows, ["slug"], update_cols=["award_name", "organization", "year", "prestige"])
