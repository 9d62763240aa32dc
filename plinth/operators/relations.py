"""Facts between entities: extracted relationships, award facts, and external knowledge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.geo import nationality_code
from plinth.operators.filters import skip_unlabelled
from plinth.operators.ingest import award_rows, award_slug, with_award
from plinth.operators.listings import reconcile_worklist
from plinth.operators.merge import fill_missing
from plinth.operators.ranking import keep_first
from plinth.operators.resolve import not_in_by_id, resolve, resolve_batch
from plinth.session import write_once

# Predicate with the role it gives a person at a firm, and with the relationship it means.
FIRM_ROLES = [("works_at", "Employee"), ("founded", "Founder"), ("partner_at", "Partner")]
RELATIONSHIPS = [
    ("collaborated_with", "collaboration"), ("acquired_by", "acquired_by"), ("subsidiary_of", "subsidiary"),
    ("spin_off_from", "spin_off"),
]


def _among(extracted: DataFrame, entities: DataFrame, resolved: DataFrame, side: str) -> DataFrame:
    """Adds <side>_id and <side>_kind: the source's own entity of that name, else the resolver's."""
    own = entities.groupBy("source_id", F.lower("name").alias("_key")).agg(
        F.min(F.struct("entity_type", F.col("entity_id").cast("string").alias("id"))).alias("_own"))
    other = resolved.where(F.col("entity_id").isNotNull()).select(
        F.col("name").alias(f"{side}_name"), F.col("entity_type").alias(f"{side}_type"), F.col("entity_id").alias("_other"))
    joined = extracted.withColumn("_key", F.lower(f"{side}_name")).join(own, ["source_id", "_key"], "left").join(
        other, [f"{side}_name", f"{side}_type"], "left")
    known = F.col("_own").isNotNull()
    return joined.withColumns({
        f"{side}_id": F.when(known, F.col("_own.id")).otherwise(F.col("_other")),
        f"{side}_kind": F.when(known, F.col("_own.entity_type")).otherwise(F.col(f"{side}_type")),
    }).drop("_key", "_own", "_other")


def _mapped(pairs: list[tuple[str, str]]) -> Column:
    chosen = F.lit(None).cast("string")
    for predicate, value in pairs:
        chosen = F.when(F.col("predicate") == predicate, F.lit(value)).otherwise(chosen)
    return chosen


def route_relationships(extracted: DataFrame, entities: DataFrame, resolved: DataFrame) -> dict[str, DataFrame]:
    """Extracted triples as firm-people roles (person to firm only) and as typed relationships.

    `entities` are the named links of each source, `resolved` outcomes (name, entity_type, entity_id)
    for names outside it, one row per name and type. The last triple of a key wins.
    """
    placed = _among(_among(extracted, entities, resolved, "subject"), entities, resolved, "object")
    full = placed.where(F.col("subject_id").isNotNull() & F.col("object_id").isNotNull()).withColumns({
        "_role": _mapped(FIRM_ROLES), "_relationship": _mapped(RELATIONSHIPS)})
    roles = full.where(
        F.col("_role").isNotNull() & (F.col("subject_kind") == "person") & (F.col("object_kind") == "firm"))
    roles = roles.select(
        F.col("object_id").alias("firm_id"), F.col("subject_id").alias("person_id"), F.col("_role").alias("role"),
        F.lit(True).alias("is_current"), F.lit("relationship_extraction").alias("source"), "pos")
    edges = full.where(F.col("_relationship").isNotNull()).select(
        F.col("subject_id").alias("from_entity_id"), F.col("subject_kind").alias("from_entity_type"),
        F.col("object_id").alias("to_entity_id"), F.col("object_kind").alias("to_entity_type"),
        F.col("_relationship").alias("relationship"), F.col("year").alias("start_year"), "pos")
    edge_keys = [c for c in edges.columns if c not in ("start_year", "pos")]
    return {
        "firm_people": keep_first(roles, ["firm_id", "person_id"], [F.desc("pos")]).drop("pos"),
        "relationships": keep_first(edges, edge_keys, [F.desc("pos")]).drop("pos"),
    }


def award_facts(
    entries: DataFrame, people: DataFrame, firms: DataFrame, aliases: DataFrame, source: str = "award",
) -> dict[str, DataFrame]:
    """Entries (pos, year, person_name, firm_name, nationality, award_name, organization, prestige) as
    resolved people and firms, awards, recipients and firm links, in one job."""
    persons = resolve_batch(
        entries.select("pos", F.col("person_name").alias("name"), nationality_code("nationality", source).alias("nationality")),
        people, aliases, "person", trigram=False)
    houses = resolve_batch(
        entries.where(F.length("firm_name") > 0).select("pos", F.col("firm_name").alias("name")), firms, aliases, "firm",
        trigram=False)
    # Written, for without its other columns the optimizer would make a slug of each row again.
    awards = write_once(award_rows(entries.where(F.col("award_name").isNotNull())))
    placed = (
        entries.join(persons.select("pos", F.col("entity_id").alias("person_id")), "pos")
        .join(houses.select("pos", F.col("entity_id").alias("firm_id")), "pos", "left")
    )
    # By slug: two spellings of a name are one award, and a missing year has a slug too.
    won = with_award(placed.where(F.col("award_name").isNotNull()), awards)
    keys = ["award_id", "firm_id", "person_id", "year"]
    links = placed.where(F.col("firm_id").isNotNull()).select(
        "firm_id", "person_id", F.lit("Principal").alias("role"), F.lit(True).alias("is_current"), "pos")
    return {
        "people": persons, "firms": houses, "awards": awards, "recipients": won.select(*keys).distinct(),
        "firm_people": keep_first(links, ["firm_id", "person_id"], [F.asc("pos")]).drop("pos"),
    }


def award_facts_of_rows(rows: DataFrame, people: DataFrame, firms: DataFrame, aliases: DataFrame) -> dict[str, DataFrame]:
    """Award rows of pages or editions (pos, year, name, entity_type, award_name, organization, prestige) as resolved
    people and firms, awards, and recipients that are one of both."""
    # Written, for rows of pages are dear to parse and read in each step below.
    rows = write_once(rows)

    def resolved(kind: str, known: DataFrame) -> DataFrame:
        return resolve_batch(rows.where(F.col("entity_type") == kind).select("pos", "name"), known, aliases, kind, trigram=False)

    persons, houses, awards = resolved("person", people), resolved("firm", firms), write_once(award_rows(rows))
    placed = (
        with_award(rows, awards)
        .join(persons.select("pos", F.col("entity_id").alias("person_id")), "pos", "left")
        .join(houses.select("pos", F.col("entity_id").alias("firm_id")), "pos", "left")
    )
    won = placed.where(F.coalesce("person_id", "firm_id").isNotNull()).select("award_id", "firm_id", "person_id", "year").distinct()
    return {"people": persons, "firms": houses, "awards": awards, "recipients": won}


def award_counters(raw: DataFrame, entries: DataFrame, facts: dict[str, DataFrame], by: str = "programme") -> DataFrame:
    """What the award job did, per programme: entries read and skipped, people and firms created and linked, recipients.

    `raw` are the rows before `entries` were chosen from them, `facts` the tables of `award_facts`; both have `by`
    and `pos`. A row counts as created if it brought its entity, as linked if it met one, else it waits for review.
    """
    read = raw.groupBy(by).agg(F.count("*").alias("n_read"))
    kept = entries.groupBy(by).agg(F.count("*").alias("n_kept"))
    counted = read.join(kept, by, "left").select(by, "n_read", (F.col("n_read") - F.coalesce("n_kept", F.lit(0))).alias("skipped"))
    for kind in ("people", "firms"):
        stage = F.col("match_type")
        done = entries.select("pos", by).join(facts[kind].select("pos", "match_type"), "pos").groupBy(by).agg(
            F.count_if(stage == "new").alias(f"{kind}_created"), F.count_if(~stage.isin("new", "review")).alias(f"{kind}_linked"))
        counted = counted.join(done, by, "left")
    ids = lambda kind, name: facts[kind].select("pos", F.col("entity_id").alias(name))
    who = entries.where(F.col("award_name").isNotNull()).join(ids("people", "person_id"), "pos").join(ids("firms", "firm_id"), "pos", "left")
    won = who.groupBy(by).agg(F.count_distinct(F.struct(award_slug(), "firm_id", "person_id", "year")).alias("recipients"))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("people_created", "people_linked", "firms_created", "firms_linked", "recipients")]
    return counted.join(won, by, "left").select(by, "n_read", "skipped", *zero)


FIRM_FACTS = ["wikidata_id", "founded_year", "website", "longitude", "latitude"]
PERSON_FACTS = ["wikidata_id", "birth_year", "death_year", "nationality"]


def reconcile(entities: DataFrame, external: DataFrame, kind: str) -> DataFrame:
    """Fill published entities without an external id from the external row of the same label.

    Of several rows the one with most site links counts. Known values stay; the two coordinates
    move together.
    """
    facts = [c for c in (FIRM_FACTS if kind == "firm" else PERSON_FACTS) if c in entities.columns]
    best = keep_first(external, ["label"], [F.desc_nulls_last("sitelinks"), F.asc("wikidata_id")])
    todo = reconcile_worklist(entities, kind).select("id", F.col("display_name").alias("label"))
    found = todo.join(best.select("label", *facts), "label").drop("label")
    together = [("longitude", "latitude")] if "longitude" in facts else None
    return fill_missing(entities, found, "id", facts, together=together)


def discover(
    external: DataFrame, targets: DataFrame, aliases: DataFrame, kind: str, legacy: bool = False,
) -> DataFrame:
    """External rows with enough site links that no target carries, resolved by name.

    Rows with match_type `new` are to be created with their facts; the others give their target
    its external id where it has none (`fill_missing`).
    """
    enough = external.where(F.col("sitelinks") >= (3 if kind == "firm" else 5))
    labelled = skip_unlabelled(enough.where(F.col("wikidata_id").isNotNull() & (F.length("label") > 0)), "label", legacy)
    unknown = not_in_by_id(labelled, targets)
    once = keep_first(unknown, ["wikidata_id"], [F.desc("sitelinks"), F.asc("label")])
    return resolve(once.withColumn("name", F.col("label")), targets, aliases, kind)
