"""A stored similarity index: names met once, asked by many batches.

`build` writes, under one folder, the order of the grams (a fixed-length array of frequencies) and, for
every distinct name, its set with signatures and one posting for each gram that any threshold from `floor`
up may look under. A batch then orders its own grams by the stored array and meets the postings; the known
names are neither cut into grams nor counted again. Any order that both sides share gives exact results,
so `extend` files new names by the same array as a further segment; `compact` writes the segments anew with
fresh frequencies once the order has aged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions.similarity import trigram_codes
from plinth.operators.ranking import top_n
from plinth.operators.simjoin import gram_frequencies, join_prefixes, prefix_postings, rare_first, signatures, spread
from plinth.session import write_once
from plinth.sources.segments import Segments


@dataclass(frozen=True)
class SimilarityIndex:
    """The parts of an index: `order`, and segments of `names` and `postings`."""

    parts: Segments

    def _order(self) -> DataFrame:
        return self.parts.spark.read.parquet(f"{self.parts.path}/order")

    def floor(self) -> float:
        """The lowest threshold that the postings serve."""
        return self._order().first()["floor"]

    def names(self) -> DataFrame:
        """Distinct names: `_name`, `_grams` in stored order, signatures."""
        return self.parts.listed("names")

    def postings(self) -> DataFrame:
        """A row for each gram a name is filed under, with its place in the order and the whole set."""
        return self.parts.listed("postings")

    def ordered(self, names: DataFrame, column: str) -> DataFrame:
        """Distinct names of a batch with their grams in the stored order, and signatures."""
        distinct = names.select(F.col(column).alias("_name")).distinct().where(F.col("_name").isNotNull())
        sets = spread(distinct, "_name").withColumn("_grams", trigram_codes("_name")).select("_name", "_grams", *signatures("_grams"))
        return rare_first(sets, "_grams", self._order().select("frequencies"))

    def append(self, sets: DataFrame, floor: float) -> None:
        segment = Segments.new()
        stored = self.parts.put(segment, "names", sets)
        # Neighbouring grams lie together, so a scan can pass over row groups that hold none of those asked for.
        filed = prefix_postings(stored, "right", floor).repartitionByRange("_gram").sortWithinPartitions("_gram", "right_size")
        self.parts.put(segment, "postings", filed)
        self.parts.commit(segment)

    def extend(self, names: DataFrame, column: str) -> None:
        """Names that the index does not hold yet, filed by the stored order. A repeated call adds nothing."""
        fresh = names.select(F.col(column).alias("_name")).join(self.names().select("_name"), "_name", "left_anti")
        self.append(self.ordered(fresh, "_name"), self.floor())

    def pairs(self, names: DataFrame, column: str, threshold: float, inclusive: bool = False) -> DataFrame:
        """(left_name, right_name, sim) of a batch's distinct names and the indexed names above the threshold."""
        return self._pairs(self.ordered(names, column), threshold, inclusive)

    def _pairs(self, ordered: DataFrame, threshold: float, inclusive: bool) -> DataFrame:
        if threshold < self.floor():
            raise ValueError(f"the index serves thresholds from {self.floor()} up")
        size, place = F.col("right_size"), F.col("right_at")
        near = self.postings().where(place <= F.greatest(size - F.ceil(F.lit(threshold) * size - 1e-9).cast("int"), F.lit(0)))
        return join_prefixes(prefix_postings(ordered, "left", threshold), near, threshold, inclusive)

    def best(self, names: DataFrame, column: str, targets: DataFrame, tiers: tuple[float, ...] = (0.85, 0.6)) -> DataFrame:
        """(column, id, sim): the best of `targets` (id, canonical_name, indexed) for each name, at or above the last tier.

        Names with a match in one tier leave before the next, where prefixes are longer.
        """
        lowest = top_n(targets.select("id", F.col("canonical_name").alias("right_name")), ["right_name"], [F.asc("id")], 1)
        left, found = write_once(self.ordered(names, column)), None
        for tier in tiers:
            met = self._pairs(left, tier, True).join(lowest, "right_name")
            best = F.min(F.struct((-F.col("sim")).alias("d"), "id"))
            hit = write_once(met.groupBy("left_name").agg(best.alias("b")).select(
                F.col("left_name").alias(column), F.col("b.id").alias("id"), (-F.col("b.d")).alias("sim")))
            found = hit if found is None else found.unionByName(hit)
            left = left.join(hit.select(F.col(column).alias("_name")), "_name", "left_anti")
        return found

    def compact(self, path: str) -> SimilarityIndex:
        """All segments as one in a new folder, with frequencies counted anew."""
        return build(self.names(), "_name", path, self.floor())


def build(names: DataFrame, column: str, path: str, floor: float = 0.3) -> SimilarityIndex:
    """An index of the distinct names of a column for thresholds from `floor` up."""
    index = SimilarityIndex(Segments(names.sparkSession, path))
    distinct = names.select(F.col(column).alias("_name")).distinct().where(F.col("_name").isNotNull())
    sets = spread(distinct, "_name").select("_name", trigram_codes("_name").alias("_grams"))
    order = gram_frequencies(sets, "_grams").select("frequencies", F.lit(floor).alias("floor"))
    order.write.parquet(f"{path}/order")
    index.append(index.ordered(names, column), floor)
    return index
