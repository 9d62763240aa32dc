"""Applying what an enrichment run found out: descriptions, aliases, tags and the queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.text import has, normalize_name
from plinth.operators.merge import add_aliases, fill_missing, link_edges, queue_transition, upsert
from plinth.operators.ranking import keep_first
from plinth.schema import entity_id

#: The column that a summary fills.
TEXT = {"firm": "short_description", "person": "bio"}
#: Shorter normalised aliases and tags are noise.
LEAST = 2


def _forms(results: DataFrame, column: str, kind: str) -> DataFrame:
    """One row for each name in an array column that is long enough, with its normalised form."""
    named = results.select("entity_id", F.lit(kind).alias("entity_type"), "pos", F.explode(column).alias("name"))
    return named.withColumn("normalized", normalize_name("name")).where(F.length("normalized") >= LEAST)


def apply_enrichment(
    entities: DataFrame, aliases: DataFrame, tags: DataFrame, entity_tags: DataFrame, queue: DataFrame, results: DataFrame,
    kind: str, now: Column | None = None,
) -> dict[str, DataFrame]:
    """New tables after the results (entity_id, summary, aliases, tags, error, pos), in the order of `pos`.

    A summary fills an empty description only, the first one that is not empty. Aliases of firms pass to
    the last that claims them. Tags are known by their normalised name, take the last spelling, and are linked
    once. The pending queue rows of an entity are done if any of its results has no error, else failed.
    Ids are text. Applying the same results again changes nothing.
    """
    good = results.where(F.col("error").isNull())
    column = TEXT[kind]
    told = good.where(has("summary")).select(F.col("entity_id").alias("id"), F.col("summary").alias(column), "pos")
    filled = fill_missing(entities, told, "id", [column], order=[F.asc("pos")])

    if kind == "firm":
        claimed = _forms(good, "aliases", kind).select("entity_id", "entity_type", F.col("name").alias("alias"), F.col("normalized").alias("alias_normalized"), "pos")
        owned = add_aliases(aliases, claimed, [F.desc("pos"), F.asc("alias")], "overwrite")
    else:
        owned = aliases

    meant = _forms(good, "tags", kind)
    spelled = keep_first(meant, ["normalized"], [F.desc("pos"), F.asc("name")]).select(F.col("normalized").alias("slug"), "name")
    known = keep_first(tags.select("slug", F.col("id").alias("_known")), ["slug"], [F.asc("_known")])
    minted = spelled.join(known, "slug", "left").select("slug", "name", F.coalesce("_known", entity_id("tag", "slug")).alias("id"))
    merged = upsert(tags, minted, ["slug"], ["name"])
    links = meant.join(minted.select(F.col("slug").alias("normalized"), F.col("id").alias("tag_id")), "normalized").select("entity_id", "entity_type", "tag_id")
    linked = link_edges(entity_tags, links, ["entity_id", "entity_type", "tag_id"], [F.asc("tag_id")])

    outcome = results.groupBy("entity_id").agg(F.bool_or(F.col("error").isNull()).alias("ok"), F.max_by("error", "pos").alias("error"))
    waiting = queue.where((F.col("entity_type") == kind) & (F.col("status") == "pending")).select("id", "entity_id")
    told = waiting.join(outcome, "entity_id").select("id", "ok", "error")
    return {"entities": filled, "aliases": owned, "tags": merged, "entity_tags": linked, "queue": queue_transition(queue, told, now)}
