"""Near-duplicates by ProbMinHash over weighted shingles, with banding and exact verification.

A text is a multiset of five-word shingles; the weight of a shingle is how often it occurs. Each
shingle sends points of a Poisson process at the rate of its weight to random components of the
signature, which keep the shingle of the earliest point. A shingle stops once its next point is
later than the latest component. Two signatures agree in a component with the probability
Jaccard of the texts, for equal weights the plain Jaccard. Bands of four components make
buckets; pairs of a bucket are verified by their exact probability Jaccard.

Texts of equal shingles are one node from the start, so copies are never compared. `linking` says
which pairs of a bucket are verified; no bucket is gathered in one task, and none is cut short.

Defined cases: NULL texts and texts without a word are like nothing, each a class of its own;
texts of one to four words are one shingle; a class is named by its least doc_id, NULL last; rows
equal in id and text are one row twice; an empty table gives no rows; other columns never clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.common import map_arrow, row_key, written
from plinth.llm.linking import linked

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
#: Word hashes that a worker remembers before it starts anew, about 150 bytes each.
MEMO = 50_000
#: Shingles that are signed at once; a longer text is signed alone.
SLICE = 100_000

_U = np.uint64
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _ODD[1]
    x = (x ^ (x >> _U(27))) * _ODD[2]
    return x ^ (x >> _U(31))


def shingles(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes of a text and how often each occurs."""
    words = (text or b"").split()
    if not words:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    if len(_WORDS) > MEMO:
        _WORDS.clear()
    hashes = np.fromiter(map(_WORDS.__getitem__, words), _U, len(words))
    width = min(WORDS, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, _U)
    for j in range(width):
        total = mixed(total * _ODD[0] + hashes[j : j + n])
    return np.unique(total, return_counts=True)


def signatures(items: list[tuple[np.ndarray, np.ndarray]], size: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash signatures of weighted sets, all at once: one row of `size` element hashes each."""
    counts = np.fromiter((len(e) for e, _ in items), np.int64, len(items))
    signature, earliest = np.zeros(len(items) * size, _U), np.full(len(items) * size, np.inf)
    if not counts.sum():
        return signature.reshape(len(items), size)
    element = np.concatenate([e for e, _ in items])
    rate = np.concatenate([w for _, w in items]).astype(float)
    owner = np.repeat(np.arange(len(items)), counts)
    time = np.zeros(len(element))
    step = 0
    while len(element):
        draw = mixed(element + _U((step * int(_ODD[3]) + int(_ODD[0])) % 2**64))
        time = time - np.log(((draw >> _U(11)).astype(float) + 1.0) * 2.0**-53) / rate
        place = owner * size + ((mixed(draw) >> _U(32)) * _U(size) >> _U(32)).astype(np.int64)
        early = np.flatnonzero(time < earliest[place])
        early = early[np.argsort(-time[early], kind="stable")]  # the earliest is assigned last
        earliest[place[early]] = time[early]
        signature[place[early]] = element[early]
        latest = earliest.reshape(len(items), size).max(1)
        going = time < latest[owner]
        element, rate, owner, time = element[going], rate[going], owner[going], time[going]
        step += 1
    return signature.reshape(len(items), size)


def bands(signature: np.ndarray) -> np.ndarray:
    """One bucket hash per band; the band number is part of it."""
    total = np.broadcast_to(np.arange(BANDS, dtype=_U), (len(signature), BANDS)).copy()
    for j in range(ROWS):
        total = mixed(total * _ODD[0] + signature[:, j::ROWS])
    return total.view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two weighted sets with sorted, distinct elements."""
    common, in_a, in_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = a[1][in_a].astype(float), b[1][in_b].astype(float)
    only_x, only_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    upto = np.searchsorted(ratio, ratio, "left")
    above = only_x + np.append(np.cumsum(x[::-1])[::-1], 0)[upto]
    below = only_y + np.append(0, np.cumsum(y))[upto]
    return float((1 / (above / x + below / y)).sum())


def _packed(sets: list[tuple[np.ndarray, np.ndarray]]) -> list[pa.Array]:
    return [pa.array([e.tobytes() for e, _ in sets], pa.binary()), pa.array([b"" if (w == 1).all() else w.astype(np.int64).tobytes() for _, w in sets], pa.binary())]


def _unpacked(elements: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    e = np.frombuffer(elements, _U)
    return e, np.frombuffer(weights, np.int64) if weights else np.ones(len(e), np.int64)


def sign(texts: Iterable[bytes | None]) -> tuple[list[bytes | None], np.ndarray]:
    """The node of each text and its buckets, one row a text; the shingles of SLICE are held at a time."""
    nodes: list[bytes | None] = []
    buckets = [np.zeros((0, BANDS), np.int64)]
    sets: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for text in texts:
        found = shingles(text)
        if sets and held + len(found[0]) > SLICE:
            buckets.append(bands(signatures(sets)))
            sets, held = [], 0
        sets.append(found)
        held += len(found[0])
        nodes.append(xxhash.xxh3_128_digest(found[0].tobytes() + found[1].tobytes()) if len(found[0]) else None)
    if sets:
        buckets.append(bands(signatures(sets)))
    return nodes, np.concatenate(buckets)


def signed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """key, doc_id, the node (digest of the weighted shingles, NULL without words) and the buckets of every row."""
    source = docs.select(row_key(doc_id, text).alias("key"), F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("_bytes"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        nodes, buckets = sign(value.as_py() for value in rows["_bytes"])
        ends = np.arange(len(nodes) + 1, dtype=np.int32) * BANDS
        listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(buckets.ravel()))
        return pa.table([rows["key"], rows["doc_id"], pa.array(nodes, pa.binary()), listed], names=["key", "doc_id", "node", "buckets"])

    return map_arrow(source, run, f"key binary, doc_id {kind}, node binary, buckets array<bigint>")


def _texts(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Shingles of the wanted nodes (node, key), each from one row that has them."""
    source = docs.select(row_key(doc_id, text).alias("_key"), F.col(text).cast("binary").alias("_bytes"))
    rows = source.join(wanted, F.col("_key") == F.col("key")).select("node", "_bytes")

    def run(rows: pa.Table) -> pa.Table:
        return pa.table([rows["node"], *_packed(list(map(shingles, rows["_bytes"].to_pylist())))], names=["node", "elements", "weights"])

    return map_arrow(rows, run, "node binary, elements binary, weights binary").dropDuplicates(["node"])


def _similar(both: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose probability Jaccard reaches the threshold."""

    def run(rows: pa.Table) -> pa.Table:
        sides = zip(*(rows[c].to_pylist() for c in ("u_elements", "u_weights", "v_elements", "v_weights")))
        near = [probability_jaccard(_unpacked(a, b), _unpacked(c, d)) >= threshold - 1e-12 for a, b, c, d in sides]
        return rows.select(["u_root", "v_root"]).filter(pa.array(near, pa.bool_()))

    return map_arrow(both, run, "u_root binary, v_root binary")


def _near(threshold: float) -> Callable:
    """For `linked`: which texts reach the threshold with a text, by a file of the shingles of all.

    With X the weight of one text, Xc that of its shingles that the other has too, and Y, Yc those of
    the other, the probability Jaccard is at most 1 / (X / Xc + (Y - Yc) / Yc), as its terms are
    concave in the weights, and the same with the sides exchanged. Where no shingle occurs twice that
    is the Jaccard itself; elsewhere pairs that reach the threshold by it are compared exactly.
    """

    def prepared(rows: pa.Table) -> Callable:
        sets = [_unpacked(e, w) for e, w in zip(rows["elements"].to_pylist(), rows["weights"].to_pylist())]
        plain = np.array([not w for w in rows["weights"].to_pylist()])
        at = np.append(0, np.cumsum([len(e) for e, _ in sets]))
        owner, weight = np.repeat(np.arange(len(sets)), np.diff(at)), np.concatenate([w for _, w in sets]).astype(float)
        total = np.bincount(owner, weight, len(sets))
        ids = np.unique(np.concatenate([e for e, _ in sets]), return_inverse=True)[1]
        order, sizes = np.argsort(ids, kind="stable"), np.bincount(ids)
        first, owner, held = np.append(0, np.cumsum(sizes)), owner[order], weight[order]

        def close(i: int, others: np.ndarray) -> np.ndarray:
            mine = ids[at[i] : at[i + 1]]
            n = sizes[mine]
            places = np.repeat(first[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
            in_i = np.bincount(owner[places], np.repeat(weight[at[i] : at[i + 1]], n), len(sets))[others]
            in_o = np.bincount(owner[places], held[places], len(sets))[others]
            both = in_i > 0
            x, y = np.where(both, in_i, 1), np.where(both, in_o, 1)
            most = 1 / np.maximum(total[i] / x + (total[others] - y) / y, (total[i] - x) / x + total[others] / y)
            near = both & (most >= threshold - 1e-12)
            for k in np.flatnonzero(near & ~(plain[i] & plain[others])):
                near[k] = probability_jaccard(sets[i], sets[others[k]]) >= threshold - 1e-12
            return near

        return close

    return prepared


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, doc_id, class_id (least doc_id of the class), class_key (key of that row) and class_rows of every row."""
    rows = written(signed(docs, doc_id, text))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("key").alias("key"))
    nodes = written(rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(first).alias("first"), F.first("buckets").alias("buckets"), F.count("*").alias("n")))
    buckets = nodes.select(F.explode("buckets").alias("bucket"), "node", F.lit(True).alias("own"))
    keys = nodes.select(F.col("node").alias("_n"), F.col("first.key").alias("key"))
    texts_of = lambda wanted: _texts(docs, wanted.join(keys, F.col("node") == F.col("_n")).select("node", "key"), doc_id, text)
    roots = linked(buckets, texts_of, lambda both: _similar(both, threshold), _near(threshold))
    placed = nodes.join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("node", "first", "n", F.coalesce("root", "node").alias("root"))
    named = placed.groupBy(F.col("root").alias("_root")).agg(F.min("first").alias("least"), F.sum("n").alias("class_rows"))
    of_node = written(placed.join(named, F.col("root") == F.col("_root")).select(F.col("node").alias("_n"), "least", "class_rows"))
    out = rows.join(of_node, F.col("node") == F.col("_n"), "left")
    alone = F.col("_n").isNull()
    return out.select(
        "key", "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("class_id"),
        F.when(alone, F.col("key")).otherwise(F.col("least.key")).alias("class_key"),
        F.coalesce("class_rows", F.lit(1)).cast("long").alias("class_rows"),
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with one row of each class; of rows equal in id and text one stays."""
    stays = classes(docs, doc_id, text, threshold).where("key = class_key").select(F.col("key").alias("_stay")).distinct()
    named = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), row_key(doc_id, text).alias("_key"), (~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).alias("_bare"))
    kept = named.join(stays, F.col("_key") == F.col("_stay"))
    one = kept.withColumn("_no", F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(0))))
    return one.where((F.col("_no") == 1) | F.col("_bare")).select("_row.*")
