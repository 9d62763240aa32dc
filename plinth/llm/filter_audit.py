"""How filters interact: every order of a set of filters, from path counts over the lattice of their subsets.

A state is the set of filters already applied; an edge applies one more. A document is still there
in a state if it fails none of its filters, so all that an edge removes or keeps follows from how
many documents fail which set of filters: one grouping of the corpus, at most 2^n rows a part.
Orders that reach a state are counted forward from the empty set, orders that leave it backward
from the full one. An edge lies on (orders reaching its start) x (orders leaving its end) orders,
which weighs its removals for the Shapley value; a step of a given order is read from its edge.

Defined cases of `five_filters`: NULL and empty texts have no words (A fails, B to D do not) and are
each other's copies; very long texts are measured whole, one at a time; rows that share a doc_id are
separate documents, none smaller than the other; a NULL doc_id is smaller than none and has none
smaller; a NULL source is the part ''. Several labels of a document count as one: good or toxic if
any says so. An empty table gives no rows. Other columns are not read, so they never clash.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.common import map_arrow, over_equals, written

LETTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_UPPER_PERCENT = 2
_SYMBOL = re.compile(rb"[#$%&*|]")
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUATION = bytes(range(0x80, 0xC0))
#: All orders are listed, n! of them.
MOST_FILTERS = 7


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """Per state of n filters, a bit each: orders of its filters that reach it, orders of the others that leave it."""
    full = (1 << n) - 1
    forward, backward = [0] * (full + 1), [0] * (full + 1)
    forward[0] = backward[full] = 1
    for state in range(full + 1):
        for f in range(n):
            if not state >> f & 1:
                forward[state | 1 << f] += forward[state]
    for state in range(full, -1, -1):
        for f in range(n):
            if state >> f & 1:
                backward[state ^ 1 << f] += backward[state]
    return forward, backward


def _bit(number: Column, place: Column) -> Column:
    return F.call_function("shiftright", number, place).bitwiseAND(F.lit(1)) == 1


def edges(judged: DataFrame, n: int, part: str = "part", fails: str = "fails", losses: tuple[str, ...] = ()) -> DataFrame:
    """Per part, `state` and `filter` (its number): documents removed, kept, redundant and failing only this
    filter, the boolean columns `losses` among the removed, and the `paths` over this edge.

    `fails` has a bit for each filter that a document fails.
    """
    counted = judged.groupBy(F.col(part).alias("part"), F.col(fails).cast("int").alias("_fails")).agg(
        F.count("*").alias("_n"), *(F.sum(F.when(F.col(c), 1).otherwise(0)).alias(f"_{c}") for c in losses)
    )
    forward, backward = path_counts(n)
    spread = (
        counted.withColumn("state", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))))
        .withColumn("filter", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .where(~_bit(F.col("state"), F.col("filter")))
    )
    failing = _bit(F.col("_fails"), F.col("filter"))
    there = F.col("_fails").bitwiseAND(F.col("state")) == 0
    total = lambda condition, of="_n": F.sum(F.when(condition, F.col(of)).otherwise(F.lit(0).cast("long")))
    summed = spread.groupBy("part", "state", "filter").agg(
        total(there & ~failing).alias("kept"),
        total(there & failing).alias("removed"),
        total(failing & ~there).alias("redundant"),
        total(F.col("_fails") == F.call_function("shiftleft", F.lit(1), F.col("filter"))).alias("unique_fails"),
        *(total(there & failing, f"_{c}").alias(f"{c}_lost") for c in losses),
    )
    reach = lambda counts, state: F.element_at(F.array(*map(F.lit, counts)), (state + 1).cast("int")).cast("long")
    after = F.col("state").bitwiseOR(F.call_function("shiftleft", F.lit(1), F.col("filter")))
    return summed.withColumn("paths", reach(forward, F.col("state")) * reach(backward, after))


def audit(judged: DataFrame, letters: str, part: str = "part", fails: str = "fails", losses: tuple[str, ...] = ()) -> DataFrame:
    """Per part, filter_order (all orders of the letters) and step: the counts of its edge, and `shapley`, the
    removals of its filter summed over all orders at any step."""
    n = len(letters)
    if not 0 < n <= MOST_FILTERS or len(set(letters)) != n:
        raise ValueError(f"1 to {MOST_FILTERS} different letters, a letter for each filter")
    found = edges(judged, n, part, fails, losses)
    valued = found.withColumn("shapley", F.sum(F.col("removed") * F.col("paths")).over(Window.partitionBy("part", "filter")))
    steps = [
        ("".join(letters[f] for f in order), step + 1, sum(1 << f for f in order[:step]), order[step])
        for order in permutations(range(n))
        for step in range(n)
    ]
    # n! x n rows, whatever the corpus.
    table = judged.sparkSession.createDataFrame(steps, "filter_order string, step int, _state int, _filter int")
    at = (F.col("state") == F.col("_state")) & (F.col("filter") == F.col("_filter"))
    return valued.join(F.broadcast(table), at).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *(f"{c}_lost" for c in losses), "shapley"
    )


def text_fails(text: bytes | None) -> int:
    """Bits of the filters A to D that a text fails: few words, few distinct words, many capitals, symbols."""
    text = text or b""
    words = text.split()
    letters = len(text.translate(None, _CONTINUATION))
    upper = len(text) - len(text.translate(None, _UPPER))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words)) << 1
        | (100 * upper > MOST_UPPER_PERCENT * letters) << 2
        | (_SYMBOL.search(text) is not None) << 3
    )


def five_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (A to E as bits 0 to 4), good, toxic of every document."""
    source = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("part"), F.col("text").cast("binary").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        texts = rows["text"].to_pylist()
        fails = pa.array(map(text_fails, texts), pa.int32())
        keys = pa.array((blake2b(t or b"", digest_size=16).digest() for t in texts), pa.binary())
        return rows.select(["doc_id", "part"]).append_column("fails", fails).append_column("text_key", keys)

    measured = written(map_arrow(source, run, f"doc_id {kind}, part string, fails int, text_key binary"))
    copies = over_equals(measured, "text_key", "doc_id", least=(F.min, "doc_id"))
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    marks = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return copies.join(marks, F.col("doc_id") == F.col("_id"), "left").select(
        "part", F.col("fails").bitwiseOR(F.when(later, 16).otherwise(0)).alias("fails"),
        *(F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")),
    )
