"""Exact similarity and containment joins that never compare all pairs.

Trigram Jaccard uses prefix filtering (Bayardo et al. 2007; Xiao et al. 2008): with the grams of
every set in one global order, two sets whose Jaccard reaches t must share a gram among the first
k - ceil(t k) + 1 of each. The order puts rare grams first, so grams that a large share of all
names hold stay out of the prefixes.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.similarity import grams, jaccard, trigram_codes
from plinth.operators.ranking import top_n
from plinth.session import write_once

BUCKETS = 16384
#: Sizes of a band differ by up to this factor.
BAND = 1.2
#: Sets and grams of a block at most; pairs of a block, of which there are up to BLOCK_PAIRS if the work is large.
BLOCK_ROWS, BLOCK_GRAMS, PAIRS_OF_A_BLOCK, BLOCK_PAIRS = 262_144, 8_000_000, 20_000_000, 64
#: Words of 64 sets that a gram has bits in at a time, bytes of these bits at most, words summed at once, rows of a batch.
BITS_WORDS, BITS_BYTES, BATCH_WORDS, PAIRS_OF_A_BATCH = 256, 64 << 20, 16384, 4096
#: Pairs for each set that are compared without asking which way is cheaper, and what a meeting in a prefix costs in pairs.
FEW_PAIRS, MEETING_COST = 125_000, 100
#: Words of 64 bits that mark the grams that names are filed under: a fixed 512 KB, fine enough to drop most other grams
#: of a million names too.
FILED_WORDS = 65536
#: Characters of the runs that titles are cut into, and that names are filed under.
LONGEST = 8
#: What parts the words of a text; a name without it stands inside one word.
SPACE = "[ \\n]"


def _bucket(gram: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def gram_frequencies(df: DataFrame, grams_column: str, buckets: int = BUCKETS) -> DataFrame:
    """One row with an array of `buckets` counts: how often grams of each hash bucket occur.

    The array has a fixed length whatever the data, so it can travel to every task.
    """
    counted = df.select(F.explode_outer(grams_column).alias("_gram")).where(F.col("_gram").isNotNull()).groupBy(
        _bucket(F.col("_gram"), buckets).alias("_bucket")).agg(F.count("*").alias("_n"))
    slots = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("_bucket"))
    filled = slots.join(counted, "_bucket", "left").select(
        F.struct("_bucket", F.coalesce("_n", F.lit(0)).alias("_n")).alias("slot"))
    listed = filled.agg(F.sort_array(F.collect_list("slot")).alias("slots"))
    return listed.select(F.transform("slots", lambda s: s["_n"]).alias("frequencies"))


def filed_bits(grams_of: DataFrame, words: int = FILED_WORDS) -> DataFrame:
    """One row with an array of `words` longs, in which the bit of each `_gram` is set by hash. Of a fixed length, too."""
    bucket = _bucket(F.col("_gram"), 64 * words)
    marked = grams_of.select(F.floor(bucket / 64).cast("int").alias("_at"), F.pmod(bucket, F.lit(64)).alias("_bit")).groupBy("_at").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit"))).alias("_bits"))
    slots = grams_of.sparkSession.range(words).select(F.col("id").cast("int").alias("_at"))
    filled = slots.join(marked, "_at", "left").select(F.struct("_at", F.coalesce("_bits", F.lit(0).cast("long")).alias("_bits")).alias("slot"))
    return filled.agg(F.sort_array(F.collect_list("slot")).alias("slots")).select(F.transform("slots", lambda s: s["_bits"]).alias("bits"))


def maybe_filed(gram: Column, bits: Column, words: int = FILED_WORDS) -> Column:
    """Whether the bit of a gram is set: never false for a filed one."""
    bucket = _bucket(gram, 64 * words)
    return F.getbit(F.get(bits, F.shiftright(bucket, 6)), F.pmod(bucket, F.lit(64))) == 1


def rare_first(df: DataFrame, grams_column: str, frequencies: DataFrame) -> DataFrame:
    """Sort each gram array by bucket frequency, then by gram: the same total order everywhere."""
    with_counts = df.withColumn("_freq", frequencies.scalar())
    ranked = F.transform(grams_column, lambda g: F.struct(F.get(F.col("_freq"), _bucket(g)).alias("n"), g.alias("g")))
    ordered = F.transform(F.sort_array(ranked), lambda s: s["g"])
    return with_counts.withColumn(grams_column, ordered).drop("_freq")


def signatures(grams_column: str) -> list[Column]:
    """Four 64-bit words with one bit set per gram, by hash."""
    def word(number: int) -> Column:
        def add(bits: Column, gram: Column) -> Column:
            slot = F.pmod(F.xxhash64(gram), F.lit(256))
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
            mine = (slot >= 64 * number) & (slot < 64 * (number + 1))
            return bits.bitwiseOR(F.when(mine, bit).otherwise(F.lit(0).cast("long")))

        return F.aggregate(grams_column, F.lit(0).cast("long"), add)

    return [word(number).alias(f"_sig{number}") for number in range(4)]


def _missing(mine: str, theirs: str) -> Column:
    """A lower bound on the grams of one set that the other lacks: signature bits it does not have."""
    lacking = [F.bit_count(F.col(f"{mine}_sig{n}").bitwiseAND(F.bitwise_not(F.col(f"{theirs}_sig{n}")))) for n in range(4)]
    return lacking[0] + lacking[1] + lacking[2] + lacking[3]


def prefix_postings(df: DataFrame, side: str, threshold: float) -> DataFrame:
    """One row per prefix gram, with its place, the set, its size and signature.

    The outer form of explode keeps the optimizer from deriving a filter on the set, which would
    build every set a second time below.
    """
    size = F.size("_grams")
    length = size - F.ceil(F.lit(threshold) * size - 1e-9).cast("int") + 1
    exploded = df.select(
        F.col("_name").alias(f"{side}_name"), F.col("_grams").alias(f"{side}_grams"), size.alias(f"{side}_size"),
        *[F.col(f"_sig{n}").alias(f"{side}_sig{n}") for n in range(4)],
        F.posexplode_outer(F.slice("_grams", 1, F.greatest(length, F.lit(1)))).alias(f"{side}_at", "_gram"))
    return exploded.where(F.col("_gram").isNotNull())


def join_prefixes(a: DataFrame, b: DataFrame, threshold: float, inclusive: bool, within: bool = False) -> DataFrame:
    """(left_name, right_name, sim) of two tables of postings that meet above the threshold."""
    la, lb, pa, pb = F.col("left_size"), F.col("right_size"), F.col("left_at") + 1, F.col("right_at") + 1
    sizes = (F.lit(threshold) * la <= lb + 1e-9) & (F.lit(threshold) * lb <= la + 1e-9)
    # Two upper bounds on the shared grams: by place in the order (the smaller place so far plus the
    # smaller rest), and by signature.
    needed = F.lit(threshold / (1.0 + threshold)) * (la + lb) - 1e-9
    by_place = F.least(pa, pb) + F.least(la - pa, lb - pb) >= needed
    by_signature = F.least(la - _missing("left", "right"), lb - _missing("right", "left")) >= needed
    # A pair that shares several prefix grams is met once, at the first of them.
    met_before = F.arrays_overlap(F.slice("left_grams", 1, F.col("left_at")), F.slice("right_grams", 1, F.col("right_at")))
    sim = jaccard("left_grams", "right_grams")
    close = sim >= threshold if inclusive else sim > threshold
    # Cheap tests stand before dear ones: the condition is evaluated from left to right.
    condition = (a["_gram"] == b["_gram"]) & sizes & by_place & by_signature
    if within:
        condition = condition & (F.col("left_name") < F.col("right_name"))
    met = a.join(b, condition & close & ~met_before)
    return met.select("left_name", "right_name", sim.alias("sim"))


def dealt_out(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt over all shuffle partitions. Names are small but dear to compare, and by size alone
    the adaptive planner would put them into few tasks."""
    wanted = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    if wanted.isdigit():
        return df.repartition(int(wanted), *columns)
    return df.repartition(*(columns or [df.sparkSession.sparkContext.defaultParallelism]))


def spread(df: DataFrame, column: str) -> DataFrame:
    return dealt_out(df, column)


def _numbered(names: DataFrame, column: str) -> DataFrame:
    """Distinct names with their grams, a size and a number each, written, so that pairs can name a set by its number."""
    distinct = names.select(F.col(column).alias("_name")).distinct().where(F.col("_name").isNotNull())
    sets = spread(distinct, "_name").withColumn("_grams", trigram_codes("_name"))
    # Sets without grams leave after the writing: before it the optimizer would cut each name for the test too.
    return write_once(sets.withColumns({"_id": F.monotonically_increasing_id(), "_size": F.size("_grams")})).where("_size > 0")


def _band(size: Column) -> Column:
    """Number of the size band, which rises with the size."""
    return F.floor(F.log(F.greatest(size, F.lit(1.0))) / F.lit(math.log(BAND)) + 1e-9).cast("int")


def _filed(sets: DataFrame, side: str, length: Column, frequencies: DataFrame, band: Column) -> DataFrame:
    """Postings of a side: numbers only, for grams that the other side may have."""
    marks = [F.col(c).alias(f"{side}{c}") for c in ("_id", "_size", *[f"_sig{n}" for n in range(4)])]
    placed = sets.withColumn("_freq", frequencies.scalar()).select(
        band.alias("_band"), *marks, "_freq", F.posexplode_outer(F.slice("_grams", 1, length)).alias(f"{side}_at", "_gram"))
    return placed.where(F.get(F.col("_freq"), _bucket(F.col("_gram"))) > 0).drop("_freq")


def _postings(
    left: DataFrame, right: DataFrame, threshold: float, within: bool, left_counts: DataFrame, right_counts: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Postings of numbered sets, to be met by `_band` and `_gram`.

    Two sets that are close share a share of both sizes, so of a set that meets much larger ones only few grams
    can be the first shared one. A left set is filed in the band of its size, a right set in each band it may
    meet, there under as many grams as the smallest size of the band leaves. Postings hold numbers, and a
    pair that passes the bounds is met with its grams afterwards.
    """
    share = threshold / (1.0 + threshold)
    size = F.col("_size")

    def bounds(sets: DataFrame) -> DataFrame:
        return sets.agg(F.struct(F.min("_size").cast("double").alias("lo"), F.max("_size").cast("double").alias("hi")).alias("b"))

    def length(other: Column) -> Column:
        return (size - F.ceil(F.lit(share) * (size + other) - 1e-6) + 1).cast("int")

    low, high = F.lit(threshold) * size - 1e-6, size / F.lit(threshold) + 1e-6
    lowest = lambda number: F.pow(F.lit(BAND), number) - 1e-3
    own = _band(size.cast("double"))
    met = left.withColumn("_b", bounds(right).scalar()).where((low <= F.col("_b.hi")) & (high >= F.col("_b.lo")))
    smallest = lowest(own) if within else F.greatest(low, F.col("_b.lo"))
    first = _filed(met, "left", F.least(size, F.greatest(length(smallest), F.lit(1))), right_counts, own)
    range_of = right.withColumn("_b", bounds(left).scalar())
    top = own if within else _band(F.least(high, F.col("_b.hi")))
    bands = F.when((low <= F.col("_b.hi")) & (high >= F.col("_b.lo")), F.sequence(_band(F.greatest(low, F.col("_b.lo"))), top))
    dealt = range_of.withColumn("_to", F.explode(bands))
    needed_here = F.least(size, F.greatest(length(F.greatest(low, F.col("_b.lo"), lowest(F.col("_to")))), F.lit(1)))
    second = _filed(dealt, "right", needed_here, left_counts, F.col("_to"))

    return first, second


def _met(first: DataFrame, second: DataFrame, left: DataFrame, right: DataFrame, threshold: float, inclusive: bool, within: bool) -> DataFrame:
    """(left_id, right_id, sim) of the sets whose postings meet."""
    la, lb, pa, pb = F.col("left_size"), F.col("right_size"), F.col("left_at") + 1, F.col("right_at") + 1
    needed = F.lit(threshold / (1.0 + threshold)) * (la + lb) - 1e-6
    sizes = (F.lit(threshold) * la <= lb + 1e-6) & (F.lit(threshold) * lb <= la + 1e-6)
    by_place = F.least(pa, pb) + F.least(la - pa, lb - pb) >= needed
    by_signature = (la - _missing("left", "right") >= needed) & (lb - _missing("right", "left") >= needed)
    a, b = dealt_out(first, "_band", "_gram"), dealt_out(second, "_band", "_gram")
    condition = (a["_band"] == b["_band"]) & (a["_gram"] == b["_gram"]) & sizes & by_place
    if within:
        # Sets of one band meet there in both orders, sets of two bands in one.
        condition = condition & ((_band(lb.cast("double")) > a["_band"]) | (F.col("left_id") < F.col("right_id")))
    pairs = a.join(b, condition & by_signature).select("left_id", "right_id").distinct()
    whole = lambda sets, side: sets.select(F.col("_id").alias(f"{side}_id"), F.col("_grams").alias(f"{side}_grams"))
    full = pairs.join(whole(right, "right"), "right_id").join(whole(left, "left"), "left_id").withColumn("sim", jaccard("left_grams", "right_grams"))
    return full.where(F.col("sim") >= threshold if inclusive else F.col("sim") > threshold).select("left_id", "right_id", "sim")


def _arranged(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A block of sets by size: the rows, their sizes, all their grams and where those of each set begin."""
    table = table.sort_by([("_size", "ascending"), ("_id", "ascending")]).combine_chunks()
    sizes = table["_size"].to_numpy().astype(np.int64)
    codes = table["_grams"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return table.drop_columns("_grams"), sizes, codes, np.concatenate([[0], np.cumsum(sizes)])


def _summed(rows: Iterator[np.ndarray]) -> list[np.ndarray]:
    """How many rows have each bit set, as bit planes with the lowest first: 64 counts a word, by full adders."""
    waiting: list[list[np.ndarray]] = [[]]

    def add(level: int, row: np.ndarray) -> None:
        while True:
            if level == len(waiting):
                waiting.append([])
            waiting[level].append(row)
            if len(waiting[level]) < 3:
                return
            a, b, c = waiting[level]
            odd = a ^ b
            waiting[level] = [odd ^ c]
            odd &= c
            a &= b
            a |= odd
            row, level = a, level + 1

    for row in rows:
        add(0, row)
    planes = []
    for level in itertools.count():
        if level == len(waiting):
            return planes
        if len(waiting[level]) == 2:
            a, b = waiting[level]
            waiting[level] = [a ^ b]
            add(level + 1, a & b)
        planes.append(waiting[level][0] if waiting[level] else np.zeros_like(planes[0]))


def _below(planes: list[np.ndarray], needed: np.ndarray) -> np.ndarray:
    """Bits of the counts that are smaller than the number needed in their place."""
    below = np.zeros_like(planes[0])
    for place in range(max(len(planes), int(needed.max()).bit_length())):
        wanted = np.packbits((needed >> place & 1).astype(bool), bitorder="little").view(np.uint64)
        lacks = ~planes[place] if place < len(planes) else np.full_like(below, ~np.uint64(0))
        below = (lacks & (wanted | below)) | (wanted & below)
    return below


def _shared(asked: tuple, held: tuple, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in `asked`, place in `held`, shared grams) of all pairs of two blocks that may reach the threshold.

    For each gram of `asked` the sets of `held` that hold it are a row of bits, one bit a set. The rows of the grams
    of a set are summed bit by bit, which counts the shared grams of 64 pairs a word, exactly.
    """
    _, sizes, codes, starts = asked
    _, held_sizes, held_codes, held_starts = held
    values, rows_of = np.unique(codes, return_inverse=True)
    if not len(values) or not len(held_sizes):
        return
    place = np.minimum(np.searchsorted(values, held_codes), len(values) - 1)
    known = values[place] == held_codes
    words = max(1, min(BITS_WORDS, BITS_BYTES // (8 * len(values)), -(-len(held_sizes) // 64)))
    distinct, firsts = np.unique(sizes, return_index=True)
    for a in range(0, len(held_sizes), 64 * words):
        b = min(a + 64 * words, len(held_sizes))
        here = slice(held_starts[a], held_starts[b])
        which = np.repeat(np.arange(b - a), held_sizes[a:b])[known[here]]
        bits = np.zeros((len(values), words), np.uint64)
        np.bitwise_or.at(bits.reshape(-1), place[here][known[here]] * words + (which >> 6), np.uint64(1) << (which & 63).astype(np.uint64))
        for size, first, last in zip(distinct, firsts, [*firsts[1:], len(sizes)]):
            if threshold * size > held_sizes[b - 1] + 1e-6 or threshold * held_sizes[a] > size + 1e-6:
                continue
            needed = np.full(64 * words, size + 1)
            needed[:b - a] = np.minimum(np.ceil(threshold / (1.0 + threshold) * (size + held_sizes[a:b]) - 1e-6), size + 1)
            step = max(1, BATCH_WORDS // words)
            for c in range(first, last, step):
                d = min(c + step, last)
                grams_of = rows_of[starts[c]:starts[d]].reshape(d - c, size)
                planes = _summed(bits.take(grams_of[:, k], axis=0) for k in range(size))
                passed = ~_below(planes, needed).reshape(-1)
                found = np.flatnonzero(passed)
                word, bit = np.nonzero(np.unpackbits(passed[found].view(np.uint8), bitorder="little").reshape(-1, 64))
                at = found[word]
                count = np.zeros(len(at), np.int64)
                for p, plane in enumerate(planes):
                    count |= (plane.reshape(-1)[at] >> bit.astype(np.uint64) & np.uint64(1)).astype(np.int64) << p
                if len(at):
                    yield c + at // words, a + at % words * 64 + bit, count


def _compared(left: pa.Table, right: pa.Table, threshold: float, inclusive: bool, once: bool) -> Iterator[pa.RecordBatch]:
    """Close pairs of two blocks of sets with their names; `once` leaves one of both orders of a block with itself."""
    if not left.num_rows or not right.num_rows:
        return
    mine, theirs = _arranged(left), _arranged(right)
    # The work grows with the grams of the sets that are asked for.
    turned = len(mine[2]) * len(theirs[1]) > len(theirs[2]) * len(mine[1])
    asked, held = (theirs, mine) if turned else (mine, theirs)
    for x, y, count in _shared(asked, held, threshold):
        sim = count / (asked[1][x] + held[1][y] - count)
        x, y = (y, x) if turned else (x, y)
        good = sim >= threshold if inclusive else sim > threshold
        if once:
            good &= mine[0]["_id"].to_numpy()[x] < theirs[0]["_id"].to_numpy()[y]
        x, y, sim = x[good], y[good], sim[good]
        for k in range(0, len(sim), PAIRS_OF_A_BATCH):
            part = slice(k, k + PAIRS_OF_A_BATCH)
            named = [side[0]["_name"].take(pa.array(at[part])).combine_chunks() for side, at in ((mine, x), (theirs, y))]
            yield pa.RecordBatch.from_arrays([*named, pa.array(sim[part])], ["left_name", "right_name", "sim"])


def _in_blocks(left: DataFrame, right: DataFrame, sides: list[tuple[int, int]], threshold: float, inclusive: bool, within: bool) -> DataFrame:
    """(left_name, right_name, sim) by comparing all sets, block by block, in any number of tasks of bounded memory.

    `sides` are the sets and grams of each side. Names travel with the sets, once a block, not with each pair.
    """
    def least(rows: int, grams_of: int) -> int:
        return max(math.ceil(rows / BLOCK_ROWS), math.ceil(grams_of / BLOCK_GRAMS), 1)

    (n_left, grams_left), (n_right, grams_right) = sides
    nl, nr = least(n_left, grams_left), least(n_right, grams_right)
    wanted = min(BLOCK_PAIRS, math.ceil(n_left * n_right / PAIRS_OF_A_BLOCK))
    if within:
        nl = nr = max(nl, math.isqrt(2 * wanted))
    while not within and nl * nr < wanted:
        # What is split sends the other side once more.
        nl, nr = (2 * nl, nr) if nl * grams_right <= nr * grams_left else (nl, 2 * nr)
    mine = lambda n: F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kept = ("_i", "_j", "_side", "_id", "_size", "_name", "_grams")
    a = left.withColumns({"_i": mine(nl), "_side": F.lit(0)}).withColumn("_j", every(nr)).select(*kept)
    b = right.withColumns({"_j": mine(nr), "_side": F.lit(1)}).withColumn("_i", every(nl)).select(*kept)
    both = a.unionByName(b)
    if within:
        both = both.where("_i <= _j")

    def met(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        first, second = (table.filter(pc.equal(table["_side"], side)) for side in (0, 1))
        yield from _compared(first, second, threshold, inclusive, within and key[0].as_py() == key[1].as_py())

    return dealt_out(both, "_i", "_j").groupBy("_i", "_j").applyInArrow(met, "left_name string, right_name string, sim double")


def _close(left: DataFrame, right: DataFrame, threshold: float, inclusive: bool, within: bool) -> DataFrame:
    """(left_name, right_name, sim) of numbered sets, by the cheaper of two exact ways.

    Prefixes are the cheaper way where names share few grams. Where grams are common to many names, as at low
    thresholds, most pairs meet in a prefix; then it is cheaper to compare all sets in blocks.
    """
    def measured(sets: DataFrame, other: tuple[int, int] | None) -> tuple[tuple[int, int], tuple[int, int], DataFrame]:
        """Sets and grams, and the least and greatest size, of the sets that a size of the other side allows."""
        if other:
            sets = sets.where((F.col("_size") >= threshold * other[0] - 1e-6) & (F.lit(threshold) * F.col("_size") <= other[1] + 1e-6))
        row = sets.agg(F.count("*"), F.sum("_size"), F.min("_size"), F.max("_size")).first()
        return (row[0], row[1] or 0), (row[2] or 0, row[3] or 0), sets

    right_side, bounds, right = measured(right, None)
    left_side, bounds, left = (right_side, bounds, right) if within else measured(left, bounds)
    if not within:
        right_side, _, right = measured(right, bounds)
    n_left, n_right = left_side[0], right_side[0]
    pairs = n_left * n_right / (2 if within else 1)
    if pairs > FEW_PAIRS * (n_left + n_right):
        left_counts = write_once(gram_frequencies(left, "_grams"))
        right_counts = left_counts if within else write_once(gram_frequencies(right, "_grams"))
        ordered = lambda sets: rare_first(sets, "_grams", right_counts).select("*", *signatures("_grams"))
        plain = _postings(*[s.select("*", *[F.lit(0).cast("long").alias(f"_sig{n}") for n in range(4)]) for s in (
            rare_first(left, "_grams", right_counts), rare_first(right, "_grams", right_counts))], threshold, within, left_counts, right_counts)
        sizes = [p.groupBy("_band", "_gram").agg(F.count("*").alias(f"n{k}")) for k, p in enumerate(plain)]
        meetings = sizes[0].join(sizes[1], ["_band", "_gram"]).agg(F.sum(F.col("n0").cast("double") * F.col("n1"))).first()[0] or 0.0
        if meetings * MEETING_COST < pairs:
            one = write_once(ordered(left))
            other = one if within else write_once(ordered(right))
            first, second = _postings(one, other, threshold, within, left_counts, right_counts)
            met = _met(first, second, one, other, threshold, inclusive, within)
            named = lambda sets, side: sets.select(F.col("_id").alias(f"{side}_id"), F.col("_name").alias(f"{side}_name"))
            full = met.join(named(left, "left"), "left_id").join(named(right, "right"), "right_id")
            return _in_order(full, within)
    return _in_order(_in_blocks(left, right, [left_side, right_side], threshold, inclusive, within), within)


def _in_order(pairs: DataFrame, within: bool) -> DataFrame:
    if within:
        return pairs.select(F.least("left_name", "right_name").alias("left_name"), F.greatest("left_name", "right_name").alias("right_name"), "sim")
    return pairs.select("left_name", "right_name", "sim")


def similar_pairs(
    left: DataFrame, right: DataFrame, threshold: float, left_on: str, right_on: str, inclusive: bool = False,
) -> DataFrame:
    """(left_name, right_name, sim) of all distinct names whose trigram Jaccard is above the threshold."""
    return _close(_numbered(left, left_on), _numbered(right, right_on), threshold, inclusive, False)


def similar_pairs_within(names: DataFrame, threshold: float, on: str, inclusive: bool = False) -> DataFrame:
    """(left_name, right_name, sim) with left_name < right_name among the distinct names of one table."""
    sets = _numbered(names, on)
    return _close(sets, sets, threshold, inclusive, True)


def match_trigram(
    names: DataFrame, targets: DataFrame, name: str, threshold: float = 0.5, k: int = 5, inclusive: bool = False,
) -> DataFrame:
    """(name, id, canonical_name, sim, place): the k targets (id, canonical_name) most like each distinct name."""
    pairs = similar_pairs(names, targets, threshold, name, "canonical_name", inclusive)
    # Of equal target names only the k lowest ids can be among the best k.
    lowest = top_n(targets.select("id", "canonical_name"), ["canonical_name"], [F.asc("id")], k)
    full = pairs.withColumnRenamed("right_name", "canonical_name").join(lowest, "canonical_name")
    ranked = top_n(full, ["left_name"], [F.desc("sim"), F.asc("id")], k, rank="place")
    return ranked.select(F.col("left_name").alias(name), "id", "canonical_name", "sim", "place")


def best_match(
    names: DataFrame, targets: DataFrame, name: str, tiers: tuple[float, ...] = (0.85, 0.6),
) -> DataFrame:
    """(name, id, sim): the best target of each name at or above the last tier.

    Tiers fall: a name with a match in one tier has its best match there, so it leaves before the
    next, where prefixes are longer and candidates more.
    """
    left = names.select(name).distinct()
    # Of equal target names only the lowest id can be the best; written, for every tier reads them.
    targets = write_once(top_n(targets.select("id", "canonical_name"), ["canonical_name"], [F.asc("id")], 1))
    found = None
    for tier in tiers:
        # Written, for it is read twice: as a result and to take its names out.
        hit = write_once(match_trigram(left, targets, name, tier, 1, inclusive=True).select(name, "id", "sim"))
        found = hit if found is None else found.unionByName(hit)
        left = left.join(hit.select(name), name, "left_anti")
    return found


def _held(lowered: DataFrame, key: str, names: DataFrame, shortest: int) -> DataFrame:
    """(key, canonical_name, id) of the names found anywhere in each `_title`.

    A name of up to LONGEST characters is filed whole, a longer one under the rarest of its grams of that
    length. A title is cut once into its runs of LONGEST characters, and the beginnings of a run that share a
    bit with some name that is filed leave the task, with the key alone. A whole name that is met is found;
    for longer names the text is met again. The joins are merges: both sides grow, and small files of many
    rows would else be taken for small tables and gathered by the driver.
    """
    long = names.where(F.length("canonical_name") > LONGEST).withColumn("_grams", grams("canonical_name", LONGEST))
    ordered = rare_first(long, "_grams", gram_frequencies(long, "_grams"))
    filed = names.where(F.length("canonical_name") <= LONGEST).select("canonical_name", "id", F.col("canonical_name").alias("_gram")).unionByName(
        ordered.select("canonical_name", "id", F.get("_grams", F.lit(0)).alias("_gram")))
    bits = filed_bits(filed).scalar()
    runs = F.array_distinct(F.regexp_extract_all("_title", F.lit(f"(?s)(?=(.{{{shortest},{LONGEST}}}))"), F.lit(1)))
    starts = [F.substring("_run", 1, n) for n in range(shortest, LONGEST + 1)]
    likely = F.array(*[F.when(maybe_filed(g, bits), g) for g in starts])
    title_grams = lowered.select(key, F.explode(runs).alias("_run")).select(key, F.explode(likely).alias("_gram")).where(F.col("_gram").isNotNull())
    # Written, for it is read twice and dear to make.
    candidates = write_once(title_grams.hint("merge").join(filed, "_gram").select(key, "canonical_name", "id"))
    whole = candidates.where(F.length("canonical_name") <= LONGEST)
    longer = candidates.where(F.length("canonical_name") > LONGEST).hint("merge").join(lowered, key).where(F.col("_title").contains(F.col("canonical_name")))
    return whole.unionByName(longer.select(key, "canonical_name", "id"))


def match_mentions(
    titles: DataFrame, firms: DataFrame, key: str, title: str, min_length: int = 5, best: bool = False,
) -> DataFrame:
    """(key, id, canonical_name): every firm name found anywhere in each title, by its lowest id.

    `best` keeps the longest name of each title, the first on ties.

    A name without a space stands inside one word of a text, so such names are looked for in each distinct word
    of all texts once, and texts meet names by their words. Names that hold a space are looked for in the texts.
    """
    shortest = max(1, min(min_length, LONGEST))
    lowered = titles.select(key, F.lower(title).alias("_title"))
    named = write_once(firms.where(F.length("canonical_name") >= min_length).groupBy("canonical_name").agg(F.min("id").alias("id")))
    spaced = F.col("canonical_name").rlike(SPACE)
    ways = []
    if not named.where(~spaced).isEmpty():
        words = lowered.select(key, F.explode(F.array_distinct(F.split("_title", SPACE))).alias("_word")).where(F.length("_word") >= shortest)
        vocabulary = write_once(words.select("_word").distinct())
        found = write_once(_held(vocabulary.withColumn("_title", F.col("_word")), "_word", named.where(~spaced), shortest))
        ways.append(words.hint("merge").join(found, "_word").select(key, "canonical_name", "id"))
    if not named.where(spaced).isEmpty() or not ways:
        ways.append(_held(lowered, key, named.where(spaced), shortest))
    met = reduce(DataFrame.unionByName, ways)
    if not best:
        return met.select(key, "id", "canonical_name").distinct()
    first = F.min(F.struct((-F.length("canonical_name")).alias("l"), F.col("canonical_name").alias("n"), F.col("id").alias("id")))
    return met.groupBy(key).agg(first.alias("m")).select(
        key, F.col("m.id").alias("id"), F.col("m.n").alias("canonical_name"))
