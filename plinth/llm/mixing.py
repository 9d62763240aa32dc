"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Every source gets a share of all words by its weight. A source that would exceed `max_epochs`
times its size stops there and its excess is shared among the others by weight, until none is
above. Sources and weights stay a table: each round sends two sums to the driver.

A source is taken in whole passes and one partial pass. The partial pass takes the documents in
the order of a seeded hash up to the place nearest the target. Hashes are summed in HASH_BUCKETS
ranges first; only the range where the target falls is looked at by hash, so a source that holds
a third of all rows is neither sorted nor gathered. A source's decision is one row.

Defined cases: a NULL or empty text has size 0 and adds nothing; a NULL source is a source and
comes last; rows equal in id and text share their hash and so their fate; without words all
targets are 0; an empty table gives no rows; of other columns only the listed ones are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import written
from plinth.operators.ranking import number_rows

SEED = "mix-1"
WEIGHTS = [1, 2, 3]
MAX_EPOCHS = 3
#: Leading hexadecimal digits of the hash that make a range: 16^3 ranges.
BUCKET_DIGITS = 3
#: Most sources for which the decisions are sent to all tasks; beyond, the join is salted.
BROADCAST_SOURCES = 100_000
SALTS = 64


def size_of(text: str) -> Column:
    """Words of a text: each run becomes one letter, then white space goes; no list is built."""
    runs = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(runs, " \t\n\x0b\x0c\r", "")).cast("long")


def hash_of(doc_id: str, text: str, seed: str) -> Column:
    """16 hexadecimal digits whose order is the sampling order."""
    value = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))
    return F.substring(F.md5(value.cast("binary")), 1, 16)


def _bucket() -> Column:
    return F.substring("hash", 1, BUCKET_DIGITS)


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """`sources` (source_size, weight) with `target`. Sums are exact; a round clamps one source or more."""
    cap = (F.col("source_size") * max_epochs).cast("decimal(38,0)")
    weight = F.col("weight").cast("decimal(38,0)")
    whole = sources.agg(F.sum("source_size"), F.sum("weight"), F.count("*")).first()
    total, weights = int(whole[0] or 0), int(whole[1] or 0)
    clamped, rest, left = -1, total, weights
    while True:
        # cap / weight below the level rest / left, without a division
        above = cap * F.lit(left).cast("decimal(18,0)") < weight * F.lit(rest).cast("decimal(18,0)")
        row = sources.where(above).agg(F.count("*"), F.sum("source_size"), F.sum("weight")).first()
        if int(row[0]) <= clamped or int(row[0]) == int(whole[2]):
            break
        clamped, rest, left = int(row[0]), total - max_epochs * int(row[1] or 0), weights - int(row[2] or 0)
    level = F.col("weight").cast("double") * F.lit(float(rest)) / F.lit(float(max(left, 1)))
    return sources.withColumn("target", F.when(above, F.col("source_size").cast("double") * max_epochs).otherwise(level))


def plan(sized: DataFrame, max_epochs: int = MAX_EPOCHS, weights: list[int] | None = None) -> DataFrame:
    """One row per source: source_size, target, whole passes, and the last hash of the partial pass."""
    chosen = F.array(*map(F.lit, weights or WEIGHTS))
    totals = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    ranked = number_rows(totals, [F.col("source").asc_nulls_last()], "_n")
    weighted = ranked.withColumn("weight", F.element_at(chosen, (F.pmod(F.col("_n") - 1, F.size(chosen)) + 1).cast("int"))).drop("_n")
    filled = water_fill(written(weighted), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    whole = F.least(whole, F.lit(max_epochs)).cast("long")
    targets = written(filled.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")))
    ranges = sized.groupBy("source", _bucket().alias("bucket")).agg(F.sum("size").alias("in_range"))
    so_far = F.sum("in_range").over(_by("bucket"))
    crossing = (
        ranges.withColumn("upto", so_far)
        .join(targets.select(F.col("source").alias("_s"), "need"), F.col("source").eqNullSafe(F.col("_s")))
        .where((F.col("upto") > F.col("need")) & (F.col("upto") - F.col("in_range") <= F.col("need")))
        .select("_s", "need", F.col("bucket").alias("_b"), (F.col("upto") - F.col("in_range")).alias("before"))
    )
    fine = (
        sized.withColumn("bucket", _bucket())
        .join(crossing, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
        .groupBy("source", "hash").agg(F.sum("size").alias("size"), F.first("need").alias("need"), F.first("before").alias("before"))
        .withColumn("upto", F.col("before") + F.sum("size").over(_by("hash")))
    )
    gap = F.struct(F.abs(F.col("upto") - F.col("need")), F.col("upto"))
    best = fine.groupBy(F.col("source").alias("_s")).agg(
        F.min_by("hash", gap).alias("_last"), F.min(gap).alias("_gap"), F.first(F.col("need") - F.col("before")).alias("_none")
    )
    # Stopping before the range is a choice too; no hash of it is below its first digits.
    last = F.when(F.col("_none") > F.col("_gap.col1"), F.col("_last")).otherwise(F.substring("_last", 1, BUCKET_DIGITS))
    chosen_last = best.select("_s", last.alias("last"))
    return (
        targets.join(chosen_last, F.col("source").eqNullSafe(F.col("_s")), "left")
        .select("source", "source_size", "target", "whole", F.coalesce("last", F.lit("")).alias("last"))
    )


def _by(order: str):
    from pyspark.sql import Window

    return Window.partitionBy("source").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def with_plan(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """`rows` (source, hash) with the decisions of their source."""
    named = decisions.withColumnRenamed("source", "_s")
    if decisions.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    salted = named.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64("hash"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_deal") == F.col("_salt"))).drop("_s", "_salt", "_deal")


def copies() -> Column:
    return F.col("whole") + (F.col("hash") <= F.col("last")).cast("long")


def sized_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(text).alias("size"), hash_of(doc_id, text, seed).alias("hash"))


def allocation(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, max_epochs: int = MAX_EPOCHS, weights: list[int] | None = None) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every document."""
    sized = written(sized_rows(docs, doc_id, text, source, seed))
    decisions = written(plan(sized, max_epochs, weights))
    return with_plan(sized, decisions).select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, max_epochs: int = MAX_EPOCHS, weights: list[int] | None = None) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of `docs`."""
    decisions = written(plan(written(sized_rows(docs, doc_id, text, source, seed)), max_epochs, weights))
    whole_row = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(source).alias("source"), hash_of(doc_id, text, seed).alias("hash"))
    taken = with_plan(whole_row, decisions).withColumn("_copies", copies()).where("_copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy")).select("_row.*")
