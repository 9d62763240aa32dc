"""Entity resolution: the staged cascade, for one batch against what is known and within the batch."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.text import name_aliases, normalize_name, slug_of
from plinth.operators.ranking import number_rows
from plinth.operators.simindex import SimilarityIndex
from plinth.operators.simjoin import best_match, dealt_out, similar_pairs, similar_pairs_within
from plinth.schema import entity_id
from plinth.session import write_once

AUTO, REVIEW = 0.85, 0.6


def live_targets(targets: DataFrame, kind: str) -> DataFrame:
    """Targets a name may match: for firms those not merged away."""
    return targets.where(F.col("merged_into").isNull()) if kind == "firm" else targets


def match_id(rows: DataFrame, targets: DataFrame, column: str = "wikidata_id") -> DataFrame:
    """Rows with the target that carries the same external id, as `matched_id`; NULL when none."""
    known = targets.where(F.col(column).isNotNull()).groupBy(column).agg(F.min("id").alias("matched_id"))
    return rows.join(known, column, "left")


def match_exact(names: DataFrame, targets: DataFrame, kind: str, name: str = "normalized") -> DataFrame:
    """Names with the lowest live target id of the same canonical name, as `exact_id`."""
    first = live_targets(targets, kind).groupBy(F.col("canonical_name").alias(name)).agg(F.min("id").alias("exact_id"))
    return names.join(first, name, "left")


def match_alias(
    names: DataFrame, aliases: DataFrame, kind: str, name: str = "normalized", merges: DataFrame | None = None,
) -> DataFrame:
    """Names with the owner of the equal alias, as `alias_id`. With `merges` (the firms table) the
    owner is replaced by the firm it was merged into."""
    own = aliases.where(F.col("entity_type") == kind).groupBy(F.col("alias_normalized").alias(name)).agg(
        F.min("entity_id").alias("alias_id"))
    if merges is not None:
        hop = merges.where(F.col("merged_into").isNotNull()).select(
            F.col("id").alias("alias_id"), F.col("merged_into").alias("_into"))
        own = own.join(hop, "alias_id", "left").select(name, F.coalesce("_into", "alias_id").alias("alias_id"))
    return names.join(own, name, "left")


def not_known(rows: DataFrame, targets: DataFrame, aliases: DataFrame, kind: str) -> DataFrame:
    """Rows whose canonical_name is neither a live target's nor an alias."""
    known = live_targets(targets, kind).select("canonical_name")
    other = aliases.where(F.col("entity_type") == kind).select(F.col("alias_normalized").alias("canonical_name"))
    return rows.join(known, "canonical_name", "left_anti").join(other, "canonical_name", "left_anti")


def not_in_by_id(rows: DataFrame, targets: DataFrame, column: str = "wikidata_id") -> DataFrame:
    """Rows whose external id no target carries."""
    known = targets.where(F.col(column).isNotNull()).select(column)
    return rows.join(known, column, "left_anti")


def name_outcomes(
    names: DataFrame, targets: DataFrame, aliases: DataFrame, kind: str, trigram: bool = True,
    follow_merges: bool = False, index: SimilarityIndex | None = None,
) -> DataFrame:
    """Per distinct `normalized`: stage, matched id and similarity against what is known.

    Cheap equality stages come first; the similarity join sees what they left. With `index`, a stored
    index of the live targets' names, they are met there and not prepared anew.
    """
    staged = match_alias(
        match_exact(names.select("normalized").distinct(), targets, kind), aliases, kind,
        merges=targets if follow_merges and kind == "firm" else None)
    if not trigram:
        return _outcome(staged.withColumn("near_id", F.lit(None).cast(targets.schema["id"].dataType)).withColumn(
            "sim", F.lit(None).cast("double")))
    # Written, for each tier and the result read it.
    staged = write_once(staged)
    open_names = staged.where(F.col("exact_id").isNull() & F.col("alias_id").isNull()).select("normalized")
    live = live_targets(targets, kind)
    if index is None:
        near = best_match(open_names, live, "normalized", (AUTO, REVIEW))
    else:
        near = index.best(open_names, "normalized", live, (AUTO, REVIEW))
    near = near.withColumnRenamed("id", "near_id")
    return _outcome(staged.join(near, "normalized", "left"))


def _outcome(staged: DataFrame) -> DataFrame:
    stage = (
        F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("alias_id").isNotNull(), "alias")
        .when(F.col("sim") >= AUTO, "trigram").when(F.col("sim") >= REVIEW, "review").otherwise("new")
    )
    return staged.select(
        "normalized", stage.alias("match_type"), F.coalesce("exact_id", "alias_id", "near_id").alias("target_id"), "sim")


def _finished(rows: DataFrame, kind: str, keep: list[str]) -> DataFrame:
    """Result columns from match_type, target_id (string) and sim."""
    stage = F.col("match_type")
    matched = stage.isin("wikidata", "exact", "alias", "trigram")
    minted = entity_id(kind, slug_of("normalized"))
    confidence = F.when(stage.isin("trigram", "review"), F.col("sim")).when(stage == "new", F.lit(0.0)).otherwise(F.lit(1.0))
    return rows.select(
        *keep, "normalized", "match_type", confidence.alias("confidence"),
        F.when(matched, F.col("target_id")).when(stage == "new", minted).alias("entity_id"),
        F.when(stage == "review", F.col("target_id")).alias("suggested_id"))


def _named(candidates: DataFrame) -> DataFrame:
    """Candidates with `normalized`, written. Names are dear to normalise and several plans read them; each is normalised
    once, and they are dealt over all tasks, for many names are a small file that few tasks would read."""
    names = write_once(dealt_out(candidates.select("name").distinct(), "name").withColumn("normalized", normalize_name("name")))
    return write_once(candidates.drop("normalized").join(names, "name", "left"))


def resolve(
    candidates: DataFrame, targets: DataFrame, aliases: DataFrame, kind: str, trigram: bool = True,
    id_column: str | None = None, follow_merges: bool = False, index: SimilarityIndex | None = None,
) -> DataFrame:
    """Resolve `candidates` (with `name`) against known targets and aliases, all rows at once.

    Adds normalized, match_type (wikidata, exact, alias, trigram, review or new), confidence,
    entity_id and suggested_id. Equal names get equal outcomes; `resolve_batch` also lets later
    names see entities that earlier names of the batch create.
    """
    keep = candidates.columns
    named = _named(candidates)
    if id_column:
        named = match_id(named, targets, id_column)
        open_rows = named.where(F.col("matched_id").isNull())
    else:
        open_rows = named
    outcomes = name_outcomes(open_rows, targets, aliases, kind, trigram, follow_merges, index)
    joined = named.join(outcomes, "normalized", "left")
    if id_column:
        by_id = F.col("matched_id").isNotNull()
        joined = joined.withColumn("match_type", F.when(by_id, F.lit("wikidata")).otherwise(F.col("match_type"))).withColumn(
            "target_id", F.coalesce("matched_id", "target_id"))
    return _finished(joined.withColumn("target_id", F.col("target_id").cast("string")), kind, keep)


def resolve_simple(candidates: DataFrame, targets: DataFrame, aliases: DataFrame, kind: str) -> DataFrame:
    """Exact, then alias, then new: no similarity and no review."""
    return resolve(candidates, targets, aliases, kind, trigram=False)


def to_review(resolved: DataFrame, kind: str) -> DataFrame:
    """Review-queue rows of the ambiguous results."""
    return resolved.where(F.col("match_type") == "review").select(
        F.col("name").alias("candidate_name"), F.lit(kind).alias("entity_type"),
        F.col("suggested_id").alias("suggested_entity_id"), "confidence", F.lit("trigram").alias("match_type"),
        F.lit("pending").alias("status"))


def creators(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Names that create an entity: those without an earlier creator among their neighbours.

    `nodes` has `normalized`; `edges` has (later, earlier) between nodes. In each round the names that
    no undecided earlier neighbour blocks absorb their later neighbours; what is absorbed blocks nobody
    and leaves with its edges. Only the edges and the absorbed names are kept, both written, so the
    plan stays short and survives lost executors.
    """
    waiting = write_once(edges.select("later", "earlier").distinct())
    absorbed = None
    while not waiting.isEmpty():
        blocked = waiting.select(F.col("later").alias("earlier")).distinct()
        met = write_once(waiting.join(blocked, "earlier", "left_anti").select(F.col("later").alias("normalized")).distinct())
        absorbed = met if absorbed is None else absorbed.unionByName(met)
        waiting = write_once(
            waiting.join(blocked, "earlier", "left_semi")
            .join(met.withColumnRenamed("normalized", "later"), "later", "left_anti")
            .join(met.withColumnRenamed("normalized", "earlier"), "earlier", "left_anti"))
    left = nodes.select("normalized")
    return left if absorbed is None else left.join(absorbed, "normalized", "left_anti")


#: Names whose pairs are one edge list; all pairs of them may be near. Each further block is larger by GROWTH.
BLOCK, GROWTH = 1024, 4


def _called(names: DataFrame) -> DataFrame:
    """(seen, seer): the other names by which a created entity can be met, from its aliases."""
    forms = names.select(F.col("normalized").alias("seen"), F.explode(name_aliases("normalized")).alias("alias"))
    return forms.select("seen", normalize_name("alias").alias("seer")).where(
        (F.length("seer") > 0) & (F.col("seer") != F.col("seen"))).distinct()


def _seen_by(names: DataFrame, entities: DataFrame, called: DataFrame, trigram: bool) -> DataFrame:
    """(seer, seen, sim) of `names` that meet `entities` by alias (no sim) or by similarity; `called` has the aliases
    of these entities and maybe of others."""
    own = called.join(entities.select(F.col("normalized").alias("seen")), "seen", "left_semi")
    links = own.join(names.select(F.col("normalized").alias("seer")), "seer", "left_semi").select(
        "seer", "seen", F.lit(None).cast("double").alias("sim"))
    if trigram:
        near = similar_pairs(names, entities, REVIEW, "normalized", "normalized", inclusive=True)
        near = near.where(F.col("left_name") != F.col("right_name"))
        links = links.unionByName(near.select(F.col("left_name").alias("seer"), F.col("right_name").alias("seen"), "sim"))
    return links


def _edges_within(names: DataFrame, called: DataFrame, trigram: bool) -> DataFrame:
    """(later, earlier) between names of one block; `names` has `normalized` and its `first` row."""
    met = called.select("seen", "seer")
    if trigram:
        near = similar_pairs_within(names, REVIEW, "normalized", inclusive=True)
        # Both directions from one pass over the pairs.
        way = lambda a, b: F.struct(F.col(a).alias("seen"), F.col(b).alias("seer"))
        ways = F.array(way("left_name", "right_name"), way("right_name", "left_name"))
        met = met.unionByName(near.select(F.explode(ways).alias("w")).select("w.seen", "w.seer"))
    earlier = names.select(F.col("normalized").alias("seen"), F.col("first").alias("seen_first"))
    later = names.select(F.col("normalized").alias("seer"), F.col("first").alias("seer_first"))
    return met.join(earlier, "seen").join(later, "seer").where(F.col("seen_first") < F.col("seer_first")).select(
        F.col("seer").alias("later"), F.col("seen").alias("earlier"))


def batch_creators(fresh: DataFrame, trigram: bool = True, block: int = BLOCK, called: DataFrame | None = None) -> DataFrame:
    """(normalized, first) of the names of a batch that create an entity.

    Up to `block` names are one edge list. More are taken in blocks that grow in size: a block first meets the creators found so far,
    which absorb the copies of names seen before, and only what is left is compared with itself.
    A name with very many near-copies thus costs one match per copy, not one per pair of copies. `called` are
    the aliases of the names, which are dear to make: each name's are made once.
    """
    called = write_once(_called(dealt_out(fresh, "normalized"))) if called is None else called
    numbered = write_once(number_rows(fresh, [F.asc("first")], "_no").withColumn(
        "_block", F.ceil(F.log(F.greatest(F.col("_no") / F.lit(block), F.lit(1.0))) / F.lit(math.log(GROWTH)) - 1e-9).cast("int")))
    last = numbered.agg(F.max("_block")).first()[0]
    found = None
    for number in range((last if last is not None else -1) + 1):
        names = numbered.where(F.col("_block") == number).select("normalized", "first")
        if found is not None:
            absorbed = _seen_by(names, found, called, trigram).select(F.col("seer").alias("normalized")).distinct()
            names = write_once(names.join(absorbed, "normalized", "left_anti"))
        made = write_once(creators(names, _edges_within(names, called, trigram)).join(names, "normalized"))
        found = made if found is None else found.unionByName(made)
    return fresh.limit(0) if found is None else found.select("normalized", "first")


def resolve_batch(
    candidates: DataFrame, targets: DataFrame, aliases: DataFrame, kind: str, order: str = "pos", trigram: bool = True,
    block: int = BLOCK,
) -> DataFrame:
    """`resolve` with the result of taking the rows one by one in `order`, which has no repeats.

    A name that creates an entity is seen by later rows: by canonical name, by its aliases, and by
    similarity. Only creators are seen, so the batch reduces to finding them (`batch_creators`);
    every other row then takes the best of the known target and the creators before it.
    """
    keep = candidates.columns
    named = _named(candidates)
    outcomes = write_once(name_outcomes(named, targets, aliases, kind, trigram).withColumn(
        "target_id", F.col("target_id").cast("string")))
    first = named.groupBy("normalized").agg(F.min(order).alias("first"))
    open_names = write_once(
        outcomes.where(F.col("match_type").isin("trigram", "review", "new")).join(first, "normalized"))
    fresh = open_names.where(F.col("match_type") == "new").select("normalized", "first")
    called = write_once(_called(dealt_out(fresh, "normalized")))
    made = write_once(dealt_out(batch_creators(fresh, trigram, block, called), "normalized").withColumn(
        "made_id", entity_id(kind, slug_of("normalized"))))

    spans = _spans(_options(_seen_by(open_names, made, called, trigram), made, open_names))
    is_made = made.select("normalized", F.col("first").alias("made_at"), "made_id")
    settled = outcomes.where(F.col("match_type").isin("exact", "alias"))
    placed = named.join(settled, "normalized", "left").join(is_made, "normalized", "left")
    direct = placed.where(F.col("match_type").isNotNull() | F.col("made_at").isNotNull())
    stage = F.when(F.col("made_at").isNull(), F.col("match_type")).when(
        F.col("made_at") == F.col(order), F.lit("new")).otherwise(F.lit("exact"))
    target = F.when(F.col("made_at").isNull(), F.col("target_id")).otherwise(F.col("made_id"))
    direct = direct.withColumn("match_type", stage).withColumn("target_id", target)
    rest = placed.where(F.col("match_type").isNull() & F.col("made_at").isNull()).drop("match_type", "target_id", "sim", "made_id")
    seen = rest.join(spans, "normalized").where(
        (F.col(order) > F.col("since")) & (F.col("until").isNull() | (F.col(order) <= F.col("until"))))
    stage = F.when(F.col("by_alias"), F.lit("alias")).when(F.col("sim") >= AUTO, F.lit("trigram")).otherwise(F.lit("review"))
    seen = seen.withColumn("match_type", stage)
    columns = [*keep, "normalized", "match_type", "target_id", "sim"]
    return _finished(direct.select(*columns).unionByName(seen.select(*columns)), kind, keep)


def _options(links: DataFrame, made: DataFrame, open_names: DataFrame) -> DataFrame:
    """(normalized, since, by_alias, sim, target_id): what each name may match, and from which row on."""
    visible = made.select(F.col("normalized").alias("seen"), F.col("first").alias("since"), F.col("made_id").alias("target_id"))
    from_batch = links.join(visible, "seen").select(
        F.col("seer").alias("normalized"), "since", F.col("sim").isNull().alias("by_alias"), "sim", "target_id")
    known = open_names.where(F.col("target_id").isNotNull()).select(
        "normalized", F.lit(None).cast("long").alias("since"), F.lit(False).alias("by_alias"), "sim", "target_id")
    return from_batch.unionByName(known.withColumn("since", F.lit(-(2**62)).cast("long")))


def _spans(options: DataFrame) -> DataFrame:
    """Best option of each name over row ranges (since, until]: alias before similarity, first alias
    owner first, highest similarity, lowest id."""
    merit = F.struct(
        F.when(F.col("by_alias"), 0).otherwise(1).alias("kind"),
        F.when(F.col("by_alias"), F.col("since").cast("double")).otherwise(-F.col("sim")).alias("rank"),
        F.col("target_id").alias("target_id"), F.col("sim").alias("sim"))
    per_row = options.groupBy("normalized", "since").agg(F.min(merit).alias("merit"))
    upto = Window.partitionBy("normalized").orderBy("since").rowsBetween(Window.unboundedPreceding, 0)
    running = per_row.withColumn("best", F.min("merit").over(upto))
    ahead = Window.partitionBy("normalized").orderBy("since")
    return running.select(
        "normalized", "since", F.lead("since").over(ahead).alias("until"),
        (F.col("best.kind") == 0).alias("by_alias"), F.col("best.target_id").alias("target_id"),
        F.col("best.sim").alias("sim"))
