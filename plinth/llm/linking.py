"""From buckets of similar items to verified links and connected components.

Classes need only enough links to hold their members together. So a bucket first links its members
to one of them, and one of more than SMALL_BUCKET members then to CENTRES others. In each bucket
that still holds several components, all pairs between different components are then tried: its
members are dealt into blocks, a task compares block with block and gives only the links that join
components. Pairs inside the largest component of a bucket are not compared. No bucket is gathered
in one task, no pair table is made of it, and no pair between components is left untried.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import written


SMALL_BUCKET = 64
#: Members that those of a larger bucket are compared with before all are.
CENTRES = 8
#: Members of one block of a bucket whose pairs are all tried.
BLOCK = 256


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    moved = both.join(least, F.col("u") == F.col("_u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    named = least.withColumnRenamed("u", "_u")
    moved = links.join(named, F.col("u") == F.col("_u")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every u has one v and no v is a u: each component is a star around its least node."""
    one = links.groupBy(F.col("u").alias("_u")).agg(F.count("*").alias("n"))
    open_ = links.join(one, F.col("v") == F.col("_u"), "left_semi").select(F.lit(1)).unionAll(one.where("n > 1").select(F.lit(1)))
    return open_.count() == 0


def components(links: DataFrame) -> DataFrame:
    """`links` (u, v) as node and root, the least node of its component. Nodes without links are absent.

    After each round the links are written; rounds grow with the logarithm of the longest chain.
    A node with very many links is summed before it is shuffled.
    """
    now = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while not _settled(now):
        now = written(_small_star(_large_star(now)))
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """`roots` after more links between roots; a node that had no link is its own root."""
    moved = written(components(links))
    named = moved.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    old = roots.join(named, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
    first = moved.join(roots.select(F.col("node").alias("_n")), F.col("node") == F.col("_n"), "left_anti")
    return written(old.unionByName(first))


def paired(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs (u, v) with the other columns of `items` (node, ...) for both, as u_... and v_..."""
    side = lambda n: items.select(*(F.col(c).alias(f"_{n}" if c == "node" else f"{n}_{c}") for c in items.columns))
    return pairs.join(side("u"), F.col("u") == F.col("_u")).join(side("v"), F.col("v") == F.col("_v")).drop("_u", "_v")


def _around(members: DataFrame, step: int) -> DataFrame:
    """Every member of a bucket beside its least own member; in a later step, every member of one of
    its buckets beside CENTRES own members of that bucket."""
    keys = [F.xxhash64("node", F.lit(step * CENTRES + i)) for i in range(CENTRES)] if step else [F.col("node")]
    chosen = [F.min_by(F.struct("node", "root"), F.when(F.col("own"), key)) for key in keys]
    centres = members.groupBy(F.col("bucket").alias("_b")).agg(F.array_distinct(F.array(*chosen)).alias("centres"))
    if step:
        one = F.min_by(F.struct("bucket", "root"), F.xxhash64("bucket", F.lit(step)))
        members = members.groupBy("node").agg(one.alias("m")).select("node", "m.bucket", "m.root")
    beside = members.join(centres, F.col("bucket") == F.col("_b")).select("node", "root", F.explode("centres").alias("c"))
    return beside.select("node", "root", F.col("c.node").alias("other"), F.col("c.root").alias("other_root"))


def _pairs(rows: DataFrame) -> DataFrame:
    """Pairs (u, v) of different components with their roots, each once."""
    pair = F.struct("node", "root"), F.struct(F.col("other").alias("node"), F.col("other_root").alias("root"))
    named = rows.where("root <> other_root").select(F.greatest(*pair).alias("a"), F.least(*pair).alias("b"))
    return named.select(F.col("a.node").alias("u"), F.col("b.node").alias("v"), F.col("a.root").alias("u_root"), F.col("b.root").alias("v_root")).distinct()


def _unsettled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members, with their roots, of the buckets that hold several components; of buckets with the same members one.

    `n` is the number of members, `top` the component with most of them, `n_top` their number. Buckets
    of two are settled by the first step, which tries their only pair.
    """
    placed = members.join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("bucket", "node", "own", F.coalesce("root", "node").alias("root"))
    marks = [F.bit_xor(F.xxhash64("node", "own")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "own", "node")).alias("y")]
    parts = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"), *marks)
    whole = parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    one = whole.where("roots > 1 and n > 2").groupBy("n", "x", "y").agg(F.min(F.struct("bucket", "top")).alias("m"))
    several = one.select(F.col("m.bucket").alias("_b"), "n", F.col("m.top.root").alias("top"), F.col("m.top.n").alias("n_top"))
    return written(placed.join(several, F.col("bucket") == F.col("_b")).drop("_b"))


def _joining(group: pa.Table, near: Callable) -> pa.Table:
    """Links (u, v) between roots that join the components of each pair of blocks of a group."""
    roots, own = group["root"].to_pylist(), group["own"].to_numpy()
    low, high, side = (group[c].to_numpy() for c in ("low", "high", "block"))
    by_pair: dict[tuple, list[int]] = {}
    for i, bucket in enumerate(group["bucket"].to_pylist()):
        by_pair.setdefault((bucket, int(low[i]), int(high[i])), []).append(i)
    links = []
    for (_, a, b), rows in by_pair.items():
        index = np.array(rows)
        names: dict[bytes, int] = {}
        component = np.array([names.setdefault(roots[i], len(names)) for i in rows])
        if len(names) == 1:
            continue
        close, owned, block = near(group.take(pa.array(index))), own[index], side[index]
        right = np.flatnonzero(block == b)
        for i in np.flatnonzero(block == a):
            others = right[right > i] if a == b else right
            others = others[(component[others] != component[i]) & (owned[others] | owned[i])]
            for j in others[close(i, others)] if len(others) else others:
                if component[j] != component[i]:
                    links.append((roots[rows[i]], roots[rows[j]]))
                    component[component == component[j]] = component[i]
    return pa.table([pa.array([k[0] for k in links], pa.binary()), pa.array([k[1] for k in links], pa.binary())], names=["u", "v"])


def _in_blocks(left: DataFrame, items: DataFrame, near: Callable) -> DataFrame:
    """Links (u, v) between roots after all pairs of different components of the buckets `left` were tried.

    A bucket of more than BLOCK members has blocks of its largest component, numbered first, which
    meet only those of the others; the others meet all. Small buckets are one block and share groups.
    """
    divided = F.col("n") > BLOCK
    inner = divided & (F.col("root") == F.col("top"))
    many = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    sized = left.withColumn("_i", inner).withColumn("_a", F.when(divided, many(F.col("n_top"))).otherwise(0))
    sized = sized.withColumn("_m", F.col("_a") + F.when(divided, many(F.col("n") - F.col("n_top"))).otherwise(1))
    inside, outside = F.pmod(F.xxhash64("node"), F.col("_a")), F.col("_a") + F.pmod(F.xxhash64("node"), F.col("_m") - F.col("_a"))
    dealt = sized.withColumn("block", F.when(F.col("_i"), inside).otherwise(outside).cast("int"))
    spread = dealt.withColumn("_o", F.explode(F.sequence(F.when(F.col("_i"), F.col("_a")).otherwise(0), F.col("_m") - 1)))
    groups = max(BLOCK, left.count() // BLOCK)
    part = F.when(divided, F.xxhash64("bucket", F.least("block", "_o"), F.greatest("block", "_o"))).otherwise(F.pmod(F.xxhash64("bucket"), F.lit(groups)))
    pair = spread.select("bucket", "node", "own", "root", "block", F.least("block", "_o").alias("low"), F.greatest("block", "_o").alias("high"), part.alias("part"))
    held = pair.join(items.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n")).drop("node", "_n")
    return held.groupBy("part").applyInArrow(lambda group: _joining(group, near), "u binary, v binary")


def linked(buckets: DataFrame, items_of: Callable, similar: Callable, near: Callable) -> DataFrame:
    """Components (node, root) of the similar nodes among those that share buckets (bucket, node, own).

    A pair counts as a candidate if one of the two is in its own bucket; the other may be there
    by a probe. `items_of(nodes)` gives what nodes are compared by, `similar(paired)` the rows of
    pairs whose two sides are similar, with u_root and v_root; `near(items)` gives a function of a
    row and other rows of an Arrow table, by number, that says which of the others are similar to it.
    """
    shared = buckets.groupBy(F.col("bucket").alias("_b")).agg(F.count("*").alias("n"), F.max("own").alias("any")).where("n > 1 and any")
    members = written(buckets.join(shared, F.col("bucket") == F.col("_b")).select("bucket", "node", "own"))
    items = written(items_of(members.select("node").distinct()))
    named = lambda found: found.select(F.col("u_root").alias("u"), F.col("v_root").alias("v"))
    roots = written(components(named(similar(paired(_pairs(_around(members.withColumn("root", F.col("node")), 0)), items)))))
    left = _unsettled(members, roots)
    large = left.where(F.col("n") > SMALL_BUCKET).select("bucket", "node", "own", "root")
    if not large.isEmpty():
        roots = _joined(roots, named(similar(paired(_pairs(_around(large, 1)), items))))
        left = _unsettled(left.select("bucket", "node", "own"), roots)
    return roots if left.isEmpty() else _joined(roots, _in_blocks(left, items, near))
