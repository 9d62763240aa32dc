"""Keyed merges: upsert, fill-missing, edges and queues. Every result is a whole new table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.text import has, name_aliases, normalize_name, slugify
from plinth.operators.ranking import keep_first
from plinth.schema import entity_id


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def upsert(
    target: DataFrame,
    rows: DataFrame,
    keys: list[str],
    update_cols: list[str] | None = None,
    policy: str = "overwrite",
    order: list[Column] | None = None,
    stamp: str | None = None,
    now: Column | None = None,
    null_keys: bool = True,
) -> DataFrame:
    """Merge `rows` into `target` on `keys` (NULL keys match each other, unless told that there are none).

    Columns the rows lack are preserved. Policies for matched keys: `overwrite` takes the incoming
    value, `keep_first` leaves the row alone, `coalesce` fills only NULLs. `update_cols` limits
    which columns a match may change. Several incoming rows per key are cut to one by `order`.
    `stamp` names a column set to `now` on insert and on any change.
    """
    supplied = [c for c in rows.columns if c not in keys]
    changing = [c for c in (update_cols if update_cols is not None else supplied) if c in supplied]
    incoming = keep_first(rows, keys, order) if order else rows
    now = now if now is not None else F.current_timestamp()

    old = target.withColumn("_old", F.lit(True)).alias("t")
    new = incoming.withColumn("_new", F.lit(True)).alias("u")
    # Plain equality lets a bucketed table keep its place.
    same = Column.eqNullSafe if null_keys else Column.__eq__
    matched = _all([same(F.col(f"t.{k}"), F.col(f"u.{k}")) for k in keys])
    joined = old.join(new, matched, "full_outer")
    is_old, is_new = F.col("_old").isNotNull(), F.col("_new").isNotNull()

    def merged(column: str) -> Column:
        before, after = F.col(f"t.{column}"), F.col(f"u.{column}")
        if policy == "keep_first" or column not in changing:
            value = before
        elif policy == "coalesce":
            value = F.coalesce(before, after)
        else:
            value = F.when(is_new, after).otherwise(before)
        return F.when(is_old, value).otherwise(after)

    outputs, changed = [], []
    for column in target.columns:
        if column in keys:
            value = F.when(is_old, F.col(f"t.{column}")).otherwise(F.col(f"u.{column}"))
        elif column in supplied:
            value = merged(column)
            changed.append(~value.eqNullSafe(F.col(f"t.{column}")))
        else:
            value = F.col(f"t.{column}")
        outputs.append((column, value))
    touched = is_new & (~is_old | (reduce(lambda a, b: a | b, changed) if changed else F.lit(False)))
    return joined.select(*[
        (F.when(touched, now).otherwise(v) if c == stamp else v).alias(c) for c, v in outputs
    ])


def upsert_actions(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of what a merge will do: rows inserted, rows matched, incoming rows that share a key."""
    per_key = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    known = target.select(*keys).distinct().withColumn("_known", F.lit(True)).alias("t")
    fresh = per_key.alias("u")
    joined = fresh.join(known, _all([F.col(f"u.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]), "left")
    return joined.agg(
        F.count_if(F.col("_known").isNull()).alias("created"),
        F.count_if(F.col("_known").isNotNull()).alias("linked"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("skipped"),
    )


def fill_missing(
    target: DataFrame, updates: DataFrame, key: str, columns: list[str],
    together: list[tuple[str, ...]] | None = None, order: list[Column] | None = None,
) -> DataFrame:
    """Write a column only where the target has none. A group in `together` moves only as one."""
    incoming = keep_first(updates, [key], order) if order else updates
    renamed = incoming.select(F.col(key), *[F.col(c).alias(f"_u_{c}") for c in columns])
    joined = target.join(renamed, key, "left")
    group_of = {c: group for group in (together or []) for c in group}

    def filled(column: str) -> Column:
        lead = group_of.get(column, (column,))[0]
        return F.when(has(lead), F.col(column)).otherwise(F.coalesce(f"_u_{column}", column)).alias(column)

    return joined.select(*[filled(c) if c in columns else F.col(c) for c in target.columns])


def link_edges(edges: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Existing edges plus the new ones whose key is not there yet, one per key, NULLs equal."""
    return upsert(edges, rows, keys, policy="keep_first", order=order)


def set_current_firm(people: DataFrame, links: DataFrame, order: list[Column]) -> DataFrame:
    """Give people without a current firm the firm of their first link."""
    first = keep_first(links, ["person_id"], order).select(
        F.col("person_id").alias("id"), F.col("firm_id").alias("current_firm_id"))
    return fill_missing(people, first, "id", ["current_firm_id"])


def add_aliases(aliases: DataFrame, rows: DataFrame, order: list[Column], on_conflict: str = "keep_first") -> DataFrame:
    """Alias ownership per (entity_type, alias_normalized): first owner stays, or the last writer takes it."""
    useful = rows.where(F.length("alias_normalized") > 0)
    policy = "keep_first" if on_conflict == "keep_first" else "overwrite"
    return upsert(aliases, useful, ["entity_type", "alias_normalized"], policy=policy, order=order)


def aliases_for(entities: DataFrame, entity_type: str) -> DataFrame:
    """Alias rows (entity_id, entity_type, alias, alias_normalized) generated from display names."""
    forms = entities.select(F.col("id").alias("entity_id"), F.explode(name_aliases("display_name")).alias("alias"))
    return forms.select(
        "entity_id", F.lit(entity_type).alias("entity_type"), "alias",
        normalize_name("alias").alias("alias_normalized")).where(F.length("alias_normalized") > 0)


def enqueue(queue: DataFrame, rows: DataFrame) -> DataFrame:
    """New pending rows (entity_id, entity_type) without one pending or processing. Done rows do not block."""
    busy = queue.where(F.col("status").isin("pending", "processing")).select("entity_id", "entity_type")
    return (
        rows.select("entity_id", "entity_type").distinct()
        .hint("merge").join(busy, ["entity_id", "entity_type"], "left_anti").withColumn("status", F.lit("pending"))
    )


def queue_transition(queue: DataFrame, outcomes: DataFrame, now: Column | None = None) -> DataFrame:
    """Apply outcomes (id, ok, error): pending becomes done, or failed with one more attempt."""
    now = now if now is not None else F.current_timestamp()
    told = outcomes.select("id", F.col("ok").alias("_ok"), F.col("error").alias("_error"))
    joined = queue.join(told, "id", "left")
    hit = (F.col("status") == "pending") & F.col("_ok").isNotNull()
    failed, done = hit & ~F.col("_ok"), hit & F.col("_ok")
    changes = {
        "status": F.when(done, F.lit("done")).when(failed, F.lit("failed")).otherwise(F.col("status")),
        "attempts": F.when(failed, F.coalesce("attempts", F.lit(0)) + 1).otherwise(F.col("attempts")),
        "last_error": F.when(failed, F.col("_error")).otherwise(F.col("last_error")),
        "enriched_at": F.when(done, now).otherwise(F.col("enriched_at")),
    }
    return joined.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in queue.columns])


def review_candidates(review_queue: DataFrame, rows: DataFrame, order: list[Column]) -> DataFrame:
    """New pending reviews, one per (name, type, suggestion) not already pending.

    A row without a suggestion never conflicts, so all such rows are kept.
    """
    keys = ["candidate_name", "entity_type", "suggested_entity_id"]
    suggested = keep_first(rows.where(F.col("suggested_entity_id").isNotNull()), keys, order)
    waiting = review_queue.where(F.col("status") == "pending").select(*keys)
    fresh = suggested.join(waiting, keys, "left_anti").select(*rows.columns)
    return fresh.unionByName(rows.where(F.col("suggested_entity_id").isNull()))


def apply_review(review_queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (id, decision, at) on pending rows. Only accepted and rejected set `resolved_at`."""
    told = decisions.select("id", F.col("decision").alias("_decision"), F.col("at").alias("_at"))
    joined = review_queue.join(told, "id", "left")
    status = (
        F.when(F.col("_decision") == "accept", F.lit("accepted")).when(F.col("_decision") == "reject", F.lit("rejected"))
        .when(F.col("_decision") == "skip", F.lit("skipped"))
    )
    hit = (F.col("status") == "pending") & status.isNotNull()
    changes = {
        "status": F.when(hit, status).otherwise(F.col("status")),
        "resolved_at": F.when(hit & status.isin("accepted", "rejected"), F.col("_at")).otherwise(F.col("resolved_at")),
    }
    return joined.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in review_queue.columns])


def upsert_entities(
    entities: DataFrame, aliases: DataFrame, queue: DataFrame, rows: DataFrame, kind: str, order: str = "pos",
) -> dict[str, DataFrame]:
    """Insert entities with their aliases and queue rows; returns the new tables and the id map.

    `rows` has display_name, sector and an input order, and may have country, city, website,
    wikidata_id and openalex_id. Rows that share a slug act in order: the first inserts, later ones
    refresh the names and fill external ids. A known slug is refreshed the same way and keeps the rest.
    """
    named = rows.withColumn("slug", slugify("display_name")).withColumn(
        "canonical_name", normalize_name("display_name"))
    place = ["country", "city", "website"] if kind == "firm" else []
    first_wins = [c for c in ["sector", *place] if c in named.columns]
    external = [c for c in ["wikidata_id", "openalex_id"] if c in named.columns]
    incoming = named.groupBy("slug").agg(
        F.max_by("display_name", order).alias("display_name"),
        F.max_by("canonical_name", order).alias("canonical_name"),
        *[F.min_by(c, order).alias(c) for c in first_wins],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in external])
    known = entities.select("slug", F.col("id").alias("_known_id"))
    ids = incoming.join(known, "slug", "left").withColumn(
        "id", F.coalesce(F.col("_known_id").cast("string"), entity_id(kind, "slug")))
    refreshed = upsert(
        entities, ids.where(F.col("_known_id").isNotNull()).select("slug", "display_name", "canonical_name"), ["slug"])
    if external:
        refreshed = fill_missing(refreshed, incoming.select("slug", *external), "slug", external)
    new_rows = ids.where(F.col("_known_id").isNull())
    typed = new_rows.select(*[
        F.col(c).cast(entities.schema[c].dataType).alias(c) for c in entities.columns if c in new_rows.columns])
    minted = ids.select("id", "slug", "display_name")
    kept = add_aliases(aliases, aliases_for(minted, kind), [F.asc("entity_id"), F.asc("alias")])
    waiting = enqueue(queue, minted.select(F.col("id").alias("entity_id"), F.lit(kind).alias("entity_type")))
    return {
        "entities": refreshed.unionByName(typed, allowMissingColumns=True), "aliases": kept,
        "queue": queue.unionByName(waiting, allowMissingColumns=True), "ids": minted.select("slug", "id"),
    }
