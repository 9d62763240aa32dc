"""Repeated passages by a sparse enhanced suffix array and its common-prefix interval tree.

Every string of LENGTH bytes has an anchor: its least KMER-byte hash, the leftmost of ties. Equal strings
have their anchors at equal offsets, so only suffixes at anchors are compared, one in about
150 bytes. An anchor stands for the strings that chose it, a run of neighbouring starts; the bytes
that these cover are its segment.

Anchors of equal hash are counted by segment. Where all segments are equal they repeat as a
whole and no byte is compared. Else the distinct segments of the hash are an enhanced suffix
array: sorted by what follows the anchor, with common prefixes of neighbours. A stack scan gives
the interval tree. In each interval the same scan over what precedes the anchor, read backwards, gives the sets
that extend left alike; a set that is diverse on both sides is a maximal repeat, with all its
occurrences. A string at offset o repeats if a maximal repeat reaches o to the left and the rest
to the right.

A hash with more than GROUP distinct segments (a common line in many contexts) would be one task. Its
strings are counted by 128-bit hashes instead, summed before they are shuffled, with the same result.

Defined cases: a NULL text is empty; texts shorter than LENGTH keep every byte; rows equal in id
and text repeat each other; an empty table gives no rows; other columns never clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import map_arrow, row_key, written

LENGTH = 400
KMER = 100
#: Distinct segments of one hash that a task compares; beyond, strings are counted by hash.
GROUP = 2_000
#: Bytes whose anchors are found at once, below 2^20.
STRIDE = 1_000_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACE = _U((1 << 20) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


_FORWARD = _powers(_BASE, STRIDE + LENGTH)
_BACKWARD = _powers(pow(_BASE, -1, 2**64), STRIDE + LENGTH + 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _kmer_hashes(data: np.ndarray, kmer: int) -> np.ndarray:
    """Hash of each `kmer` bytes, by differences of running sums of bytes times powers."""
    n = len(data)
    sums = np.zeros(n + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * _BACKWARD[:n], out=sums[1:])
    return _mixed((sums[kmer:] - sums[:-kmer]) * _FORWARD[: n - kmer + 1])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, from running minima of blocks in both directions."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(_U).max, _U)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    upto = np.minimum.accumulate(blocks, 1).ravel()
    onward = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(onward[: n - width + 1], upto[width - 1 : n])


def anchors(text: bytes, length: int = LENGTH, kmer: int = KMER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place and hash of each anchor of a text, and the first and last start of the strings that chose it."""
    places, firsts, lasts, hashes = [], [], [], []
    for base in range(0, max(len(text) - length + 1, 0), STRIDE):
        data = np.frombuffer(text, np.uint8, min(STRIDE + length - 1, len(text) - base), base)
        found = _kmer_hashes(data, kmer)
        ranked = (found & ~_PLACE) | np.arange(len(found), dtype=_U)
        chosen = (_sliding_min(ranked, length - kmer + 1) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.diff(chosen, prepend=-1))
        place = chosen[first]
        places.append(place + base)
        firsts.append(first + base)
        lasts.append(np.append(first[1:], len(chosen)) - 1 + base)
        hashes.append(found[place].view(np.int64))
    if not places:
        return (np.zeros(0, np.int64),) * 4
    return tuple(map(np.concatenate, (places, firsts, lasts, hashes)))


def anchored(docs: DataFrame, doc_id: str, text: str, length: int, kmer: int) -> DataFrame:
    """Per row: key and the arrays place, first, last, hash and segment (hash of the segment) of its anchors."""
    source = docs.select(row_key(doc_id, text).alias("key"), F.col(text).cast("binary").alias("_bytes")).where(F.octet_length("_bytes") >= length)

    def run(rows: pa.Table) -> pa.Table:
        parts: list[list[np.ndarray]] = [[], [], [], [], []]
        for data in rows["_bytes"].to_pylist():
            place, first, last, hashes = anchors(data, length, kmer)
            view = memoryview(data)
            spans = zip(first.tolist(), last.tolist(), place.tolist())
            segment = np.fromiter((xxhash.xxh3_64_intdigest(view[a : b + length], x - a) for a, b, x in spans), _U, len(place))
            for part, values in zip(parts, (place, first, last, hashes, segment.view(np.int64))):
                part.append(values)
        ends = pa.array(np.cumsum([0, *map(len, parts[0])]), pa.int32())
        flat = [pa.array(np.concatenate(p).astype(np.int32 if i < 3 else np.int64)) for i, p in enumerate(parts)]
        return pa.table([rows["key"], *(pa.ListArray.from_arrays(ends, x) for x in flat)], names=["key", "place", "first", "last", "hash", "segment"])

    lists = "place array<int>, first array<int>, last array<int>, hash array<bigint>, segment array<bigint>"
    return map_arrow(source, run, f"key binary, {lists}")


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by the first bit in which two numbers differ."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differing = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (differing.bit_length() + 7) // 8


def intervals(prefixes: list[int]) -> list[tuple[int, int, int]]:
    """Nodes of the common-prefix interval tree as (depth, first, last), by one stack scan.

    `prefixes[i]` is the common prefix of the sorted strings i and i + 1.
    """
    found, stack = [], []
    for i, depth in enumerate([*prefixes, -1]):
        left = i
        while stack and stack[-1][0] > depth:
            top, left = stack.pop()
            found.append((top, left, i))
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, left))
    return found


def maximal_repeats(befores: list[bytes], afters: list[bytes], length: int) -> list[tuple[int, int, list[int]]]:
    """Maximal repeats around the anchors of one hash as (left, right, members).

    `befores` are the bytes before each anchor, read backwards; `afters` those from it on. Members share
    `left` and `right` bytes, no set of them shares more on both sides, and left + right >= length.
    """
    order = sorted(range(len(afters)), key=afters.__getitem__)
    prefixes = [_common(afters[a], afters[b]) for a, b in zip(order, order[1:])]
    most = max(map(len, befores))
    repeats = []
    for right, first, last in intervals(prefixes):
        if right + most < length:
            continue
        members = sorted(range(first, last + 1), key=lambda i: befores[order[i]])
        shared = [_common(befores[order[a]], befores[order[b]]) for a, b in zip(members, members[1:])]
        for left, a, b in intervals(shared):
            inside = members[a : b + 1]
            # Right-diverse: the set must not share more to the right than its interval does.
            if left + right >= length and min(prefixes[min(inside) : max(inside)]) == right:
                repeats.append((left, right, [order[i] for i in inside]))
    return repeats


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open ranges, sorted, those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _segments(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, length: int) -> DataFrame:
    """The bytes of wanted segments: hash, segment, n, before (backwards) and after the anchor."""
    rows = wanted.groupBy("at.key").agg(F.collect_list(F.struct("hash", "segment", "n", "at.place", "at.first", "at.last")).alias("cuts"))
    source = docs.select(row_key(doc_id, text).alias("_key"), F.col(text).cast("binary").alias("_bytes"))
    joined = source.join(rows, F.col("_key") == F.col("key")).select("_bytes", "cuts")

    def run(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for data, cuts in zip(table["_bytes"].to_pylist(), table["cuts"].to_pylist()):
            for c in cuts:
                out.append((c["hash"], c["segment"], c["n"], data[c["first"] : c["place"]][::-1], data[c["place"] : c["last"] + length]))
        columns = list(zip(*out)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["hash", "segment", "n", "before", "after"])

    return map_arrow(joined, run, "hash bigint, segment bigint, n bigint, before binary, after binary")


def _by_tree(group: pa.Table, length: int) -> pa.Table:
    """Repeated strings of the segments of some hashes as ranges of offsets (low, high)."""
    table = group.sort_by("hash")
    hashes, names, counts = (table[c].to_pylist() for c in ("hash", "segment", "n"))
    befores, afters = table["before"].to_pylist(), table["after"].to_pylist()
    out: list[tuple[int, int, int, int]] = []
    first = 0
    while first < len(hashes):
        last = first
        while last < len(hashes) and hashes[last] == hashes[first]:
            last += 1
        ranges: list[list[tuple[int, int]]] = [[] for _ in range(first, last)]
        for i in range(first, last):
            if counts[i] > 1:
                ranges[i - first].append((length - len(afters[i]), len(befores[i]) + 1))
        for left, right, members in maximal_repeats(befores[first:last], afters[first:last], length):
            for i in members:
                low, high = max(length - right, length - len(afters[first + i])), min(left, len(befores[first + i]))
                if low <= high:
                    ranges[i].append((low, high + 1))
        for i, found in enumerate(ranges, first):
            out.extend((hashes[i], names[i], low, high - 1) for low, high in _merged(found))
        first = last
    columns = list(zip(*out)) or [()] * 4
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["hash", "segment", "low", "high"])


def _by_string(rows: DataFrame, length: int) -> DataFrame:
    """The same for hashes with very many segments: every string counted by its 128-bit hash."""

    def run(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for name, segment, n, before, after in zip(*(table[c].to_pylist() for c in ("hash", "segment", "n", "before", "after"))):
            whole = before[::-1] + after
            for offset in range(length - len(after), len(before) + 1):
                start = len(before) - offset
                out.append((name, segment, offset, n, xxhash.xxh3_128_digest(whole[start : start + length])))
        columns = list(zip(*out)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["hash", "segment", "offset", "n", "string"])

    strings = map_arrow(rows, run, "hash bigint, segment bigint, offset int, n bigint, string binary")
    again = strings.groupBy("string").agg(F.sum("n").alias("n")).where("n > 1").select(F.col("string").alias("_s"))
    return strings.join(again, F.col("string") == F.col("_s")).select("hash", "segment", F.col("offset").alias("low"), F.col("offset").alias("high"))


def repeated_ranges(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, kmer: int = KMER, group: int = GROUP) -> DataFrame:
    """key, start, end: byte ranges of rows, covered by strings that also start elsewhere."""
    found = written(anchored(docs, doc_id, text, length, kmer))
    each = found.select("key", F.explode(F.arrays_zip("place", "first", "last", "hash", "segment")).alias("a")).select("key", "a.*")
    # Written, so that the join deals both sides anew and a very common hash can be split.
    shared = written(
        each.groupBy(F.col("hash").alias("_h")).agg(F.count("*").alias("n"), F.min("segment").alias("a"), F.max("segment").alias("z"))
        .where("n > 1").select("_h", (F.col("a") == F.col("z")).alias("alike"))
    )
    candidates = written(each.join(shared, F.col("hash") == F.col("_h")).drop("_h"))
    whole = candidates.where("alike").select("key", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    mixed = candidates.where("not alike")
    wanted = written(mixed.groupBy("hash", "segment").agg(F.count("*").alias("n"), F.min(F.struct("key", "place", "first", "last")).alias("at")))
    kinds = wanted.groupBy(F.col("hash").alias("_h")).agg(F.count("*").alias("kinds"))
    cut = written(_segments(docs, wanted, doc_id, text, length).join(kinds, F.col("hash") == F.col("_h")).drop("_h"))
    small = cut.where(F.col("kinds") <= group)
    parts = max(1, small.count() // group)
    by_tree = (
        small.withColumn("part", F.pmod(F.xxhash64("hash"), F.lit(parts))).select("part", "hash", "segment", "n", "before", "after")
        .groupBy("part").applyInArrow(lambda rows: _by_tree(rows, length), "hash bigint, segment bigint, low int, high int")
    )
    by_string = _by_string(cut.where(F.col("kinds") > group).select("hash", "segment", "n", "before", "after"), length)
    offsets = by_tree.unionByName(by_string).select(F.col("hash").alias("_h"), F.col("segment").alias("_s"), "low", "high")
    partly = mixed.join(offsets, (F.col("hash") == F.col("_h")) & (F.col("segment") == F.col("_s"))).select(
        "key", (F.col("place") - F.col("high")).alias("start"), (F.col("place") - F.col("low") + length).alias("end")
    )
    return whole.unionByName(partly)


def cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, kmer: int = KMER, group: int = GROUP) -> DataFrame:
    """Per row: doc_id, n_bytes, the removed runs (start, end), the remaining bytes, and the same as text."""
    ranges = repeated_ranges(docs, doc_id, text, length, kmer, group)
    per_row = ranges.groupBy(F.col("key").alias("_k")).agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    source = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("key"), F.col(text).cast("binary").alias("_bytes"))
    joined = source.join(per_row, F.col("key") == F.col("_k"), "left").select("doc_id", "_bytes", "ranges")
    kind = joined.schema["doc_id"].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        sizes, runs, kept = [], [], []
        for data, ranges_ in zip(rows["_bytes"].to_pylist(), rows["ranges"].to_pylist()):
            data = data or b""
            removed = _merged([(r["start"], r["end"]) for r in ranges_ or ()])
            edges = [0, *(x for pair in removed for x in pair), len(data)]
            sizes.append(len(data))
            runs.append([{"start": a, "end": b} for a, b in removed])
            kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        texts = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
        return pa.table(
            [rows["doc_id"], pa.array(sizes, pa.int64()), pa.array(runs, spans), pa.array(kept, pa.binary()), texts],
            names=["doc_id", "n_bytes", "removed", "kept", "kept_text"],
        )

    return map_arrow(joined, run, f"doc_id {kind}, n_bytes bigint, removed array<struct<start:int,end:int>>, kept binary, kept_text string")


def digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of `cleaned`, the remaining text (without characters
    that a cut broke) and the removed runs."""
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda total, r: total + (r["end"] - r["start"]))
    return cleaned(docs, **options).select(
        "doc_id", "n_bytes", lost.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.col("kept_text").alias("text"), "removed",
    )
