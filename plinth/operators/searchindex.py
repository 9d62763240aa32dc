"""A stored search index, and top-k search that stops at the bounds of its blocks.

`build` writes the searchable entities, similarity indexes of their names, of aliases and of tag slugs
(`simindex`), and an inverted index of the words of their texts: the postings of a word, by entity type, in
the order of their impact (how often the word occurs) and cut into blocks of BLOCK, each with the greatest
impact it holds. The cut follows the global order of (type, word, impact), so a word that a third of all
texts hold becomes many blocks in many tasks.

A search first ranks what names and aliases admit. The k-th best of these bounds the k-th best of all from
below, so of the other ways only tags and blocks that may still reach it are read: a text counts at most
0.1 x words x impact, and whoever is admitted by tag or text alone has a name and aliases at or below the
threshold. The result equals `search`.

`extend` adds segments for entities that are not in the index; their words add up with those there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions.fulltext import fts_match, fts_rank
from plinth.functions.similarity import jaccard
from plinth.operators import simindex
from plinth.operators.ranking import top_n
from plinth.operators.search import ALIAS, NAME, PAIR, _best, _best_named, _filtered, alias_best_sim, holders, prepared
from plinth.session import write_once
from plinth.sources.segments import Segments

BLOCK = 128
#: Weight of one cover of all words, and the rank of a tag.
COVER, TAG = 0.1, 0.4
#: The lowest similarity that any search asks for.
FLOOR = 0.2


def blocked_postings(entities: DataFrame) -> DataFrame:
    """entity_type, word, block, n, most, entries (id, impact): the postings of each word, greatest impact first."""
    words = F.transform("text_lexemes", lambda t: t["word"])
    impacts = entities.select("entity_type", "id", F.explode(words).alias("word")).groupBy("entity_type", "id", "word").agg(F.count("*").cast("int").alias("impact"))
    order = [F.asc("entity_type"), F.asc("word"), F.desc("impact"), F.asc("id")]
    placed = impacts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return placed.groupBy("entity_type", "word", F.floor(F.col("_at") / BLOCK).alias("block")).agg(
        F.count("*").alias("n"), F.max("impact").alias("most"), F.collect_list(F.struct("id", "impact")).alias("entries"))


@dataclass(frozen=True)
class SearchIndex:
    """The parts of a search index: segments of `entities`, `postings` and `words`, and three similarity indexes."""

    parts: Segments

    def entities(self) -> DataFrame:
        return self.parts.listed("entities")

    def postings(self) -> DataFrame:
        return self.parts.listed("postings")

    def words(self) -> DataFrame:
        """entity_type, word, n: in how many texts; summed over the segments."""
        return self.parts.listed("words").groupBy("entity_type", "word").agg(F.sum("n").alias("n"))

    def _names(self, part: str) -> simindex.SimilarityIndex:
        return simindex.SimilarityIndex(Segments(self.parts.spark, f"{self.parts.path}/{part}"))

    def append(self, entities: DataFrame) -> None:
        segment = Segments.new()
        stored = self.parts.put(segment, "entities", entities)
        blocks = self.parts.put(segment, "postings", blocked_postings(stored))
        self.parts.put(segment, "words", blocks.groupBy("entity_type", "word").agg(F.sum("n").alias("n")))
        self.parts.commit(segment)

    def extend(self, entities: DataFrame, aliases: DataFrame | None = None, tags: DataFrame | None = None) -> None:
        """Entities, aliases and tags that are not in the index yet. A repeated call adds nothing."""
        fresh = entities.join(self.entities().select("entity_type", "id"), ["entity_type", "id"], "left_anti")
        self.append(write_once(fresh.select(*self.entities().columns)))
        self._names("names").extend(entities, "canonical_name")
        for part, table, column in (("aliases", aliases, "alias_normalized"), ("tags", tags, "slug")):
            if table is not None:
                self._names(part).extend(table, column)

    def _hits(self, asked: DataFrame, part: str, names: DataFrame, column: str, threshold: float) -> DataFrame:
        """query_id, entity_type, id of names like the query; `names` has entity_type, id and the column."""
        near = self._names(part).pairs(asked, "q", threshold).select(F.col("left_name").alias("q"), F.col("right_name").alias(column))
        return near.join(asked.select("query_id", "q"), "q").join(names, column).select("query_id", "entity_type", "id")

    def _tag_hits(self, open_pairs: DataFrame, asked: DataFrame, tags: DataFrame, entity_tags: DataFrame, threshold: float) -> DataFrame:
        near = self._names("tags").pairs(asked, "q", threshold).select(F.col("left_name").alias("q"), F.col("right_name").alias("slug"))
        meant = near.join(asked.select("query_id", "q"), "q").join(tags.select(F.col("id").alias("tag_id"), "slug"), "slug").select("query_id", "tag_id").distinct()
        wanted = write_once(meant.join(open_pairs, "query_id"))
        return wanted.join(holders(wanted, entity_tags), ["tag_id", "entity_type"]).select("query_id", "entity_type", F.col("entity_id").alias("id")).distinct()

    def _text_hits(self, asked: DataFrame, bounds: DataFrame, other: float) -> DataFrame:
        """query_id, entity_type, id from the blocks of each query's rarest word that may reach its bound.

        `bounds` has query_id, entity_type and least, NULL where every block counts.
        """
        sought = asked.select("query_id", F.size("q_words").alias("_words"), F.explode("q_words").alias("word")).join(bounds, "query_id")
        known = sought.join(self.words(), ["entity_type", "word"], "left")
        rarest = known.groupBy("query_id", "entity_type", "_words", "least").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("m"))
        rarest = rarest.where("m.n > 0").select("query_id", "entity_type", "_words", "least", F.col("m.word").alias("word"))
        reach = F.greatest(F.lit(COVER) * F.col("_words") * F.col("most"), F.lit(other))
        met = rarest.join(self.postings(), ["entity_type", "word"]).where(F.col("least").isNull() | (reach >= F.col("least")))
        return met.select("query_id", "entity_type", F.explode("entries.id").alias("id"))

    def search(
        self, queries: DataFrame, aliases: DataFrame, tags: DataFrame, entity_tags: DataFrame,
        k: int = 12, threshold: float = 0.35, tag_threshold: float = 0.3, stem: bool = False,
    ) -> DataFrame:
        """The k best entities of each type per query, with rank and place, as `search.search` gives them."""
        asked = write_once(prepared(queries, stem))
        entities = self.entities()
        alias_names = aliases.select("entity_type", F.col("entity_id").alias("id"), "alias_normalized")
        # Of the names only the k best of each query: others can be among the k best of all by text or alias only, and are met there.
        near = self._names("names").pairs(asked, "q", threshold)
        named = _best_named(asked, entities, near, k).select(*PAIR).unionByName(
            self._hits(asked, "aliases", alias_names, "alias_normalized", threshold)).distinct()
        first = write_once(self._ranked(named.withColumn("by_tag", F.lit(False)), asked, entities, aliases))
        # Whoever comes by tag or text alone has at most this rank, but for its text.
        other = max(NAME * threshold, ALIAS * threshold, TAG)
        # An alias at the threshold must outrank a tag, or tags of the named would count.
        may_bound = min(NAME, ALIAS) * threshold >= TAG
        best = top_n(first, ["query_id", "entity_type"], [F.desc("rank"), F.asc("id")], k) if may_bound else None
        bounds = self._bounds(asked, best, k)
        still = bounds.where(F.col("least").isNull() | (F.col("least") <= other)).select("query_id", "entity_type")
        tagged = self._tag_hits(still, asked, tags, entity_tags, tag_threshold).withColumn("by_tag", F.lit(True))
        texts = self._text_hits(asked, bounds, other).withColumn("by_tag", F.lit(False))
        found = first.select("query_id", "entity_type", "id").withColumn("by_tag", F.lit(False)).unionByName(tagged).unionByName(texts)
        pairs = found.groupBy("query_id", "entity_type", "id").agg(F.bool_or("by_tag").alias("by_tag"))
        named_pairs = first.select("query_id", "entity_type", "id", F.lit(True).alias("_named"))
        return _best(self._ranked(pairs.join(named_pairs, ["query_id", "entity_type", "id"], "left"), asked, entities, aliases), k)

    @staticmethod
    def _bounds(asked: DataFrame, best: DataFrame | None, k: int) -> DataFrame:
        """query_id, entity_type, least: the k-th best rank so far, NULL where fewer are known."""
        kinds = F.explode(F.array(F.lit("firm"), F.lit("person")))
        every = asked.select("query_id", kinds.alias("entity_type"))
        if best is None:
            return every.withColumn("least", F.lit(None).cast("double"))
        least = best.groupBy("query_id", "entity_type").agg(F.when(F.count("*") >= k, F.min("rank")).alias("least"))
        return write_once(every.join(least, ["query_id", "entity_type"], "left"))

    @staticmethod
    def _ranked(pairs: DataFrame, asked: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
        """Pairs (with by_tag, and _named where names or aliases admitted them) that pass the filters, with their rank."""
        held = _filtered(pairs.join(asked, "query_id").join(entities, ["entity_type", "id"]))
        by_text = fts_match(F.col("text_lexemes"), F.col("q_words"))
        if "_named" in pairs.columns:
            # Blocks hold one word of the query; the others must be there too.
            held = held.where(F.coalesce(F.col("_named"), F.lit(False)) | F.col("by_tag") | by_text)
        held = write_once(held)
        full = held.join(alias_best_sim(held, aliases), ["query_id", "entity_type", "id"], "left")
        text = F.when(by_text, fts_rank(F.col("text_lexemes"), F.col("q_words"))).otherwise(F.lit(0.0))
        rank = F.greatest(
            jaccard("name_grams", "q_grams") * NAME, F.coalesce(F.col("alias_sim") * ALIAS, F.lit(0.0)), text,
            F.when(F.col("by_tag"), F.lit(TAG)).otherwise(F.lit(0.0)))
        return full.withColumn("rank", rank)


def build(entities: DataFrame, aliases: DataFrame, tags: DataFrame, path: str) -> SearchIndex:
    """A search index of `search.searchable` entities, aliases and tags."""
    index = SearchIndex(Segments(entities.sparkSession, path))
    index.append(entities)
    simindex.build(index.entities(), "canonical_name", f"{path}/names", FLOOR)
    simindex.build(aliases, "alias_normalized", f"{path}/aliases", FLOOR)
    simindex.build(tags, "slug", f"{path}/tags", FLOOR)
    return index
