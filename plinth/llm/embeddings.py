"""Near-duplicate embeddings by cross-polytope hashing after fast Hadamard rotations.

A rotation is three rounds of random signs and a Hadamard transform. Its hash is the axis of the
polytope nearest to the rotated vector; HASHES of them make the code of a table. A vector lies in
its own bucket of each table (`tables_for` says how many) and also in the PROBES buckets that its runner-up axes
make likeliest. Pairs of a bucket, one of them in its own, are verified by cosine.

Equal vectors are one node. Verified links give components; inside a component all pairs are then
counted exactly in blocks of bounded size, dealt over tasks, so no pair table is made.

Defined cases: vectors that are NULL, empty, zero or hold NULL or non-finite components link with
nothing; vectors of different lengths never link; a component is named by its least id, NULL
last; repeated rows are links like any other; an empty table gives no rows; other columns never clash.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import map_arrow, written
from plinth.llm.linking import linked

THRESHOLD = 0.9
#: The least tables; longer vectors get more, so that a pair at the threshold is missed once in MISSES.
TABLES, HASHES, PROBES = 12, 3, 16
MISSES = 70_000
#: Runner-up axes of each hash that probes are made of.
RUNNERS = 4
#: Nodes of one block of the exact count.
BLOCK = 1024
SEED = 20_240


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    half = 1
    while half < d:
        x = x.reshape(n, -1, 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        half *= 2
    return x / np.sqrt(d)


def codes(vectors: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> np.ndarray:
    """Buckets of unit vectors: for each table the own one first, then the probes, as 64-bit codes."""
    n, length = vectors.shape
    d = max(2, 1 << (length - 1).bit_length())
    padded = np.zeros((n, d))
    padded[:, :length] = vectors
    runners = min(RUNNERS, d)
    choices = np.array(list(product(range(runners), repeat=hashes)))
    out = np.zeros((n, tables, probes + 1), np.int64)
    for table in range(tables):
        axes, penalty = [], np.zeros((n, len(choices)))
        for k in range(hashes):
            signs = np.random.default_rng([SEED, length, table, k]).choice([-1.0, 1.0], size=(3, d))
            y = padded
            for row in signs:
                y = hadamard(y * row)
            top = np.argsort(-np.abs(y), 1, kind="stable")[:, :runners]
            value = np.take_along_axis(y, top, 1)
            axes.append(top * 2 + (value < 0))
            size = np.abs(value)
            penalty += ((size[:, :1] - size) ** 2)[:, choices[:, k]]
        best = np.argsort(penalty, 1, kind="stable")[:, : probes + 1]
        code = np.full(best.shape, length * tables + table, np.int64)
        for k in range(hashes):
            code = code * (2 * d) + np.take_along_axis(axes[k], choices[best, k], 1)
        out[:, table, : best.shape[1]] = code
        out[:, table, best.shape[1] :] = code[:, :1]
    return out


def found_share(length: int, threshold: float, hashes: int, probes: int, tables: int = 4, pairs: int = 512) -> float:
    """Share of random pairs at the threshold that one table finds, by a seeded simulation."""
    draw = np.random.default_rng([SEED, length])
    one, other = draw.normal(size=(2, pairs, length))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other -= (one * other).sum(1, keepdims=True) * one
    other *= np.sqrt(1 - threshold**2) / np.maximum(np.linalg.norm(other, axis=1, keepdims=True), 1e-300)
    a, b = (codes(x, tables, hashes, probes) for x in (one, threshold * one + other))
    return float(((a == b[:, :, :1]) | (b == a[:, :, :1])).any(2).mean())


@cache
def tables_for(length: int, threshold: float = THRESHOLD, hashes: int = HASHES, probes: int = PROBES) -> int:
    """Tables that miss one pair in MISSES at the threshold for vectors of a length, TABLES at least."""
    share = found_share(max(2, 1 << (length - 1).bit_length()), threshold, hashes, probes)
    return max(TABLES, int(np.ceil(np.log(MISSES) / -np.log1p(-min(max(share, 1e-3), 1 - 1e-9)))))


def _valid(vector: list | None) -> np.ndarray | None:
    if not vector or any(x is None for x in vector):
        return None
    row = np.array(vector, float)
    return row + 0.0 if np.isfinite(row).all() and row.any() and 0 < np.linalg.norm(row) < np.inf else None


def hashed(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, node (digest of the vector, NULL if it links with nothing) and its packed doubles."""
    source = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("_v"))
    kind = source.schema["vec_id"].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        packed = [None if v is None else v.tobytes() for v in map(_valid, rows["_v"].to_pylist())]
        nodes = [None if p is None else xxhash.xxh3_128_digest(p) for p in packed]
        return pa.table([rows["vec_id"], pa.array(nodes, pa.binary()), pa.array(packed, pa.binary())], names=["vec_id", "node", "vector"])

    return map_arrow(source, run, f"vec_id {kind}, node binary, vector binary")


def _units(packed: list[bytes]) -> np.ndarray:
    rows = np.frombuffer(b"".join(packed)).reshape(len(packed), -1)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def buckets(nodes: DataFrame, tables: int | None, hashes: int, probes: int, threshold: float) -> DataFrame:
    """bucket, node, own: where the vectors of `nodes` lie."""

    def run(rows: pa.Table) -> pa.Table:
        packed, names = rows["vector"].to_pylist(), rows["node"].to_pylist()
        parts = []
        for size in sorted({len(p) for p in packed}):
            chosen = [i for i, p in enumerate(packed) if len(p) == size]
            found = codes(_units([packed[i] for i in chosen]), tables or tables_for(size // 8, threshold, hashes, probes), hashes, probes)
            own = np.zeros(found.shape, bool)
            own[:, :, 0] = True
            each = found.shape[1] * found.shape[2]
            node = pa.array([names[i] for i in chosen], pa.binary()).take(pa.array(np.repeat(np.arange(len(chosen)), each)))
            parts.append(pa.table([pa.array(found.ravel()), node, pa.array(own.ravel())], names=["bucket", "node", "own"]))
        return pa.concat_tables(parts)

    entries = map_arrow(nodes.select("node", "vector"), run, "bucket bigint, node binary, own boolean")
    return entries.groupBy("bucket", "node").agg(F.max("own").alias("own"))


def _similar(both: DataFrame, threshold: float) -> DataFrame:
    def run(rows: pa.Table) -> pa.Table:
        u, v = rows["u_vector"].to_pylist(), rows["v_vector"].to_pylist()
        near = np.zeros(len(u), bool)
        for size in {len(p) for p in u}:
            chosen = [i for i in range(len(u)) if len(u[i]) == size == len(v[i])]
            if chosen:
                near[chosen] = (_units([u[i] for i in chosen]) * _units([v[i] for i in chosen])).sum(1) >= threshold
        return rows.select(["u_root", "v_root"]).filter(pa.array(near))

    return map_arrow(both, run, "u_root binary, v_root binary")


def _near(threshold: float) -> Callable:
    """For `linked`: which vectors reach the threshold with a vector, by one matrix product."""

    def prepared(rows: pa.Table) -> Callable:
        packed = rows["vector"].to_pylist()
        sizes = np.array([len(p) for p in packed])
        near = np.zeros((len(packed), len(packed)), bool)
        for size in np.unique(sizes):
            chosen = np.flatnonzero(sizes == size)
            unit = _units([packed[i] for i in chosen])
            near[np.ix_(chosen, chosen)] = unit @ unit.T >= threshold
        return lambda i, others: near[i, others]

    return prepared


def _counts(group: pa.Table, threshold: float) -> pa.Table:
    """Per node of the blocks of a group: rows of other nodes that it links with.

    A row stands once in each pair of blocks that holds its block; `side` is its block there, and
    in a pair of a block with itself all rows are one side.
    """
    names, roots = group["node"].to_pylist(), group["root"].to_pylist()
    low, high, side = (group[c].to_numpy() for c in ("low", "high", "block"))
    n = group["n"].to_numpy()
    packed = group["vector"].to_pylist()
    by_pair: dict[tuple, list[int]] = {}
    for i, root in enumerate(roots):
        by_pair.setdefault((root, int(low[i]), int(high[i])), []).append(i)
    total = np.zeros(len(names), np.int64)
    for (_, a, b), rows in by_pair.items():
        index = np.array(rows)
        unit = _units([packed[i] for i in rows])
        left, right = (side[index] == a), (side[index] == b)
        near = unit[left] @ unit[right].T >= threshold
        if a == b:
            np.fill_diagonal(near, False)
            total[index] += near @ n[index]
        else:
            total[index[left]] += near @ n[index[right]]
            total[index[right]] += near.T @ n[index[left]]
    return pa.table([group["node"], pa.array(total)], names=["node", "links"])


def link_counts(nodes: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """Rows that each node links with in its component (node, links), by blocks of bounded size."""
    placed = nodes.join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n")).select("node", "vector", "n", "root")
    sizes = roots.groupBy(F.col("root").alias("_r")).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = placed.join(sizes, F.col("root") == F.col("_r")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = spread.select("node", "vector", "n", "root", "block", F.least("block", "_o").alias("low"), F.greatest("block", "_o").alias("high"), "blocks")
    # Small components share groups; a pair of blocks of a large one is a group of its own.
    groups = max(1, roots.count() // BLOCK)
    small = F.pmod(F.xxhash64("root"), F.lit(groups))
    named = pair.withColumn("part", F.when(F.col("blocks") == 1, small).otherwise(F.xxhash64("root", "low", "high"))).drop("blocks")
    found = named.groupBy("part").applyInArrow(lambda group: _counts(group, threshold), "node binary, links bigint")
    return found.groupBy(F.col("node").alias("_n")).agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, tables: int | None = None, hashes: int = HASHES, probes: int = PROBES) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    rows = written(hashed(vectors, vec_id, embedding))
    first = F.struct(F.col("vec_id").isNull().alias("none"), F.col("vec_id").alias("vec_id"))
    nodes = written(rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.first("vector").alias("vector"), F.count("*").alias("n"), F.min(first).alias("first")))
    items = lambda wanted: nodes.select("node", "vector").join(wanted, "node", "left_semi")
    roots = linked(buckets(nodes, tables, hashes, probes, threshold), items, lambda both: _similar(both, threshold), _near(threshold))
    counted = link_counts(nodes, roots, threshold)
    placed = nodes.join(roots.withColumnRenamed("node", "_m"), F.col("node") == F.col("_m"), "left").select("node", "n", "first", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy(F.col("root").alias("_r")).agg(F.min("first").alias("least"))
    of_node = placed.join(least, F.col("root") == F.col("_r")).join(counted, F.col("node") == F.col("_n"), "left").select(
        F.col("node").alias("_node"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "least.vec_id"
    ).withColumnRenamed("vec_id", "least_id")
    out = rows.drop("vector").join(written(of_node), F.col("node") == F.col("_node"), "left")
    alone = F.col("_node").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("least_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
