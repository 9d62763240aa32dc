"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Tokens of A and of B tile the same bytes. Two incidence matrices, A tokens by bytes and B tokens
by bytes, are built by hand in compressed rows; the row products A.B^T (Gustavson: a row of the
left selects rows of the right, which are added up) give each pair of overlapping tokens with the
bytes it shares. Byte offsets where both end cut the tokens into groups; the incidence of tokens
in groups gives, by the same product, the pairs that share a group.

A text is cut before single spaces between two other characters. No token of either tokenizer
crosses such a place (checked on the vocabulary of B; if it fails, whole texts are taken), so the
matrices are built once for each distinct unit of a batch, as blocks along the diagonal.

How often two ids are linked is counted over the corpus: batches send their distinct pairs with
counts, and get the totals back by batch and pair. Documents stay with their batch number and are
never dealt by pair, so a pair of a third of all links is one row a batch.

Defined cases: NULL and empty texts, and texts that the tokens of A or B do not give back byte by
byte, have no tokens, groups or links; a very long text is a batch of its own and costs memory in
proportion to itself; repeated rows are counted each; an empty table gives no rows; only the two
named columns are read, so others never clash.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plinth.llm.common import map_arrow, written

_CUT = re.compile(r"(?<=\S) (?=\S)")
_SPACE = "▁"
#: Units that are encoded and multiplied together, and nonzeros that one product expands at a time.
ENCODE_UNITS = 8_000
PRODUCT_ITEMS = 500_000


@dataclass
class Csr:
    """A sparse matrix in compressed rows."""

    indptr: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    width: int

    @property
    def height(self) -> int:
        return len(self.indptr) - 1

    def rows(self) -> np.ndarray:
        """The row of each nonzero."""
        return np.repeat(np.arange(self.height), np.diff(self.indptr))


def tiling(lengths: np.ndarray) -> Csr:
    """Tokens by bytes: each token holds the next `lengths` bytes."""
    indptr = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    n = int(indptr[-1])
    return Csr(indptr, np.arange(n), np.ones(n, np.int64), n)


def membership(columns: np.ndarray, width: int) -> Csr:
    """One nonzero a row, in the given column."""
    return Csr(np.arange(len(columns) + 1), columns, np.ones(len(columns), np.int64), width)


def transposed(matrix: Csr) -> Csr:
    order = np.argsort(matrix.indices, kind="stable")
    counts = np.bincount(matrix.indices, minlength=matrix.width)
    indptr = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    return Csr(indptr, matrix.rows()[order], matrix.values[order], matrix.height)


def row_products(left: Csr, right: Csr) -> Csr:
    """left . right by rows, a bounded number of products at a time."""
    reach = np.diff(right.indptr)[left.indices]
    cost = np.concatenate([[0], np.cumsum(reach)])[left.indptr]
    parts, counts, at = [], np.zeros(left.height, np.int64), 0
    while at < left.height:
        upto = max(at + 1, int(np.searchsorted(cost, cost[at] + PRODUCT_ITEMS, "right")) - 1)
        low, high = left.indptr[at], left.indptr[upto]
        span = reach[low:high]
        total = int(span.sum())
        picked = np.repeat(right.indptr[left.indices[low:high]] - (np.cumsum(span) - span), span) + np.arange(total)
        rows = np.repeat(np.repeat(np.arange(at, upto), np.diff(left.indptr[at : upto + 1])), span)
        cells = rows * right.width + right.indices[picked]
        values = np.repeat(left.values[low:high], span) * right.values[picked]
        order = np.argsort(cells, kind="stable")
        cells, values = cells[order], values[order]
        first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if total else np.zeros(0, np.int64)
        parts.append((cells[first] % right.width, np.add.reduceat(values, first) if total else values))
        counts[at:upto] = np.bincount(cells[first] // right.width - at, minlength=upto - at)
        at = upto
    indices, values = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2
    return Csr(np.concatenate([[0], np.cumsum(counts)]), indices, values, right.width)


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others moved up."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class Units:
    """Distinct units of a batch: tokens, groups and links of all, one after the other."""

    valid: np.ndarray
    a_ids: np.ndarray
    b_ids: np.ndarray
    a_ends: np.ndarray  # tokens of A up to and with each unit; likewise below
    b_ends: np.ndarray
    group_ends: np.ndarray
    link_ends: np.ndarray
    group_a: np.ndarray  # tokens of A up to and with each group
    group_b: np.ndarray
    links: Csr
    shared: np.ndarray  # pairs that share a group, of each token of A

    def sums(self, values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Per unit the sum of values of its items."""
        totals = np.concatenate([[0], np.cumsum(values)])
        return totals[ends] - totals[np.concatenate([[0], ends[:-1]])]

    @staticmethod
    def joined(parts: list["Units"]) -> "Units":
        """Units of several parts, numbered on."""
        shift = lambda name, of: np.concatenate([x + o for x, o in zip((getattr(p, name) for p in parts), of)])
        plain = lambda name: np.concatenate([getattr(p, name) for p in parts])
        before = lambda sizes: np.cumsum([0, *sizes[:-1]])
        a, b = before([len(p.a_ids) for p in parts]), before([len(p.b_ids) for p in parts])
        groups, links = before([len(p.group_a) for p in parts]), before([len(p.links.indices) for p in parts])
        table = Csr(
            np.concatenate([[0], *(p.links.indptr[1:] + o for p, o in zip(parts, links))]),
            np.concatenate([p.links.indices + o for p, o in zip(parts, b)]).astype(np.int32),
            np.concatenate([p.links.values for p in parts]).astype(np.int32), sum(len(p.b_ids) for p in parts),
        )
        return Units(
            plain("valid"), plain("a_ids"), plain("b_ids"), shift("a_ends", a), shift("b_ends", b), shift("group_ends", groups),
            shift("link_ends", links), shift("group_a", a), shift("group_b", b), table, plain("shared"),
        )

    def group_texts(self, pieces: list[str], n_a: int, n_b: int) -> list[str]:
        """Per unit `a1,a2|b1;a3|b2;`, of `pieces`: the ids of A before a comma, before a bar, of B before a comma, before a semicolon."""
        groups = np.arange(len(self.group_a))
        in_a, in_b = (np.repeat(groups, np.diff(ends, prepend=0)) for ends in (self.group_a, self.group_b))
        order = np.empty(len(self.a_ids) + len(self.b_ids), np.int32)
        # A token stands behind those of its own side before it and those of the other side of the groups before it.
        at_a = np.arange(len(in_a)) + np.concatenate([[0], self.group_b])[in_a]
        at_b = np.arange(len(in_b)) + self.group_a[in_b]
        order[at_a], order[at_b] = self.a_ids, self.b_ids + 2 * n_a
        order[at_a[self.group_a - 1]] += n_a
        order[at_b[self.group_b - 1]] += n_b
        out: list[str] = []
        ends = self.a_ends + self.b_ends
        for at in range(0, len(ends), ENCODE_UNITS):
            part = ends[at : at + ENCODE_UNITS]
            first = int(ends[at - 1]) if at else 0
            words = list(map(pieces.__getitem__, order[first : part[-1]].tolist()))
            stops = [0, *(part - first).tolist()]
            out += ["".join(words[i:j]) for i, j in zip(stops, stops[1:])]
        return out


class Aligner:
    """Two tokenizers and the bytes of their ids."""

    def __init__(self, path_a: str, path_b: str) -> None:
        # Spark's tasks are the threads.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(map(alphabet.__getitem__, token)) if all(c in alphabet for c in token) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace(_SPACE, " ").encode() for i, n in enumerate(names)
        ]
        self.splits = not any(re.search(f"[^{_SPACE}]{_SPACE}", n) for n in names)
        # Ids with what follows them in the text of the groups.
        self.pieces = [f"{i}{mark}" for side, marks in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for mark in marks for i in range(len(side))]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))

    def cut(self, text: str) -> list[str]:
        return _CUT.split(text) if self.splits else [text]

    def tokens(self, units: list[str]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """Ids of A and B of each unit, and whether both give its bytes back; none where they do not."""
        all_a, all_b, valid = [], [], []
        spaced = [" " + u for u in units]
        ids_a = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        ids_b = self.b.encode(units, num_threads=1)
        whole = "".join(spaced).encode()
        if all(whole == b"".join(map(table.__getitem__, chain.from_iterable(ids))) for table, ids in ((self.a_bytes, ids_a), (self.b_bytes, ids_b))):
            # Equal as a whole, so equal each if the lengths are.
            sizes = np.fromiter(map(len, map(str.encode, spaced)), np.int64)
            if all((self._sizes(table, ids) == sizes).all() for table, ids in ((self.a_sizes, ids_a), (self.b_sizes, ids_b))):
                return ids_a, ids_b, np.ones(len(units), bool)
        for text, x, y in zip(spaced, ids_a, ids_b):
            whole = text.encode()
            good = whole == b"".join(map(self.a_bytes.__getitem__, x)) and whole == b"".join(map(self.b_bytes.__getitem__, y))
            all_a.append(x if good else [])
            all_b.append(y if good else [])
            valid.append(good)
        return all_a, all_b, np.array(valid, bool)

    @staticmethod
    def _sizes(table: np.ndarray, ids: list[list[int]]) -> np.ndarray:
        """Bytes of each list of ids."""
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64))
        along = np.concatenate([[0], np.cumsum(table[np.fromiter(chain.from_iterable(ids), np.int64)])])
        return np.diff(along[ends], prepend=0)

    def units(self, units: list[str]) -> Units:
        """Tokens, groups and links of distinct units, a part at a time."""
        return Units.joined([self._part(units[at : at + ENCODE_UNITS]) for at in range(0, max(len(units), 1), ENCODE_UNITS)])

    def _part(self, units: list[str]) -> Units:
        all_a, all_b, valid = self.tokens(units)
        a_ends, b_ends = (np.cumsum([len(x) for x in ids]).astype(np.int64) for ids in (all_a, all_b))
        a_ids, b_ids = (np.fromiter(chain.from_iterable(ids), np.int32) for ids in (all_a, all_b))
        a, b = tiling(self.a_sizes[a_ids]), tiling(self.b_sizes[b_ids])
        links = row_products(a, transposed(b))
        bounds = np.intersect1d(a.indptr[1:], b.indptr[1:], assume_unique=True)
        in_a, in_b = (np.searchsorted(bounds, m.indptr[1:]) for m in (a, b))
        # Pairs that share a group, counted: tokens of A by groups, times tokens of B in each group.
        sizes = np.bincount(in_b, minlength=len(bounds))
        held = row_products(membership(in_a, len(bounds)), Csr(np.arange(len(bounds) + 1), np.zeros(len(bounds), np.int64), sizes, 1))
        unit_bytes = a.indptr[a_ends] if len(a_ends) else a_ends
        return Units(
            valid, a_ids, b_ids, a_ends, b_ends, np.searchsorted(bounds, unit_bytes, "right"), links.indptr[a_ends] if len(a_ends) else a_ends,
            np.searchsorted(in_a, np.arange(len(bounds)), "right"), np.searchsorted(in_b, np.arange(len(bounds)), "right"), links, held.values,
        )

    def shared_pairs(self, units: Units) -> Csr:
        """All pairs of tokens that share a group, as the product of the group incidences."""
        n = len(units.group_a)
        in_a, in_b = (np.repeat(np.arange(n), np.diff(ends, prepend=0)) for ends in (units.group_a, units.group_b))
        return row_products(membership(in_a, n), transposed(membership(in_b, n)))

    def batch(self, texts: list[str | None]) -> tuple[Units, np.ndarray, np.ndarray, list[bool]]:
        """Units of a batch, the units of its texts one after the other, where each text ends, and which texts have tokens."""
        parts = [self.cut(t) if t else [] for t in texts]
        known = dict.fromkeys(chain.from_iterable(parts))
        known.update(zip(known, range(len(known))))
        rows = [np.fromiter(map(known.__getitem__, units), np.int32, len(units)) for units in parts]
        del parts
        found = self.units(list(known))
        if not found.valid.all():
            # Judged as a whole: the text is one unit.
            again = [i for i, row in enumerate(rows) if not found.valid[row].all()]
            for i in again:
                rows[i] = np.array([known.setdefault(texts[i], len(known))], np.int32)
            found = Units.joined([found, self.units(list(known)[len(found.valid) :])])
            for i in again:
                rows[i] = rows[i] if found.valid[rows[i][0]] else rows[i][:0]
        ends = np.cumsum([len(r) for r in rows]).astype(np.int64)
        return found, np.concatenate([np.zeros(0, np.int32), *rows]), ends, [len(r) > 0 for r in rows]


_LOADED: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Aligner(path_a, path_b)
    return _LOADED[path_a, path_b]


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, ids of A and B, links (token of A, token of B, bytes shared), and the groups as ends in A and B."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        machine = aligner(path_a, path_b)
        out = []
        for value in rows["text"].to_pylist():
            units, picked, _, _ = machine.batch([value])
            ids_a, ids_b, links, groups = [], [], [], []
            ends = [[0, *x.tolist()] for x in (units.a_ends, units.b_ends, units.group_ends)]
            for u in picked.tolist():
                (a0, a1), (b0, b1), (g0, g1) = ((e[u], e[u + 1]) for e in ends)
                da, db = len(ids_a) - a0, len(ids_b) - b0
                for i in range(a0, a1):
                    low, high = units.links.indptr[i], units.links.indptr[i + 1]
                    links += [{"a": i + da, "b": int(j) + db, "bytes": int(n)} for j, n in zip(units.links.indices[low:high], units.links.values[low:high])]
                groups += [{"a": int(units.group_a[g]) + da, "b": int(units.group_b[g]) + db} for g in range(g0, g1)]
                ids_a += units.a_ids[a0:a1].tolist()
                ids_b += units.b_ids[b0:b1].tolist()
            out.append((ids_a, ids_b, links, groups))
        columns = [list(c) for c in zip(*out)]
        whole = pa.list_(pa.int32())
        link = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("bytes", pa.int32())]))
        group = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        return pa.table([rows["doc_id"], *(pa.array(c, t) for c, t in zip(columns, (whole, whole, link, group)))], names=["doc_id", "a_ids", "b_ids", "links", "groups"])

    return map_arrow(source, run, f"doc_id {kind}, a_ids array<int>, b_ids array<int>, links array<struct<a:int,b:int,bytes:int>>, groups array<struct<a:int,b:int>>")


_FACTS = ["n_a", "n_b", "n_groups", "n_links", "n_shared"]
_LINKS = "link_ends array<int>, links array<int>, a array<int>, b array<int>, n array<bigint>"


def _measured(docs: DataFrame, path_a: str, path_b: str, doc_id: str, text: str) -> DataFrame:
    """Rows of two kinds for each batch (`block`): documents with counts and units, and one row of links
    (`a` not NULL): per unit the ends of its links, per link its pair, per pair both ids and its count."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"block bigint, doc_id {kind}, {', '.join(f'{c} bigint' for c in _FACTS)}, groups_sha256 string, units array<int>, {_LINKS}"
    seen: list[int] = []

    def run(rows: pa.Table) -> pa.Table:
        seen.append(1)
        block = (TaskContext.get().partitionId() << 32) | len(seen)
        machine = aligner(path_a, path_b)
        units, picked, ends, valid = machine.batch(rows["text"].to_pylist())
        row_of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        totals = [
            np.bincount(row_of, per[picked], minlength=len(ends)).astype(np.int64)
            for per in (
                np.diff(units.a_ends, prepend=0), np.diff(units.b_ends, prepend=0), np.diff(units.group_ends, prepend=0),
                np.diff(units.link_ends, prepend=0), units.sums(units.shared, units.a_ends),
            )
        ]
        groups, starts = units.group_texts(machine.pieces, len(machine.a_bytes), len(machine.b_bytes)), [0, *ends.tolist()]
        digests = [
            sha256("".join([groups[u] for u in picked[i:j].tolist()])[:-1].encode()).hexdigest() if good else ""
            for i, j, good in zip(starts, starts[1:], valid)
        ]
        pairs = units.a_ids[units.links.rows()].astype(np.int64) * len(machine.b_bytes) + units.b_ids[units.links.indices]
        distinct, pair_of = np.unique(pairs, return_inverse=True)
        used = np.bincount(picked, minlength=len(units.valid))
        counted = np.bincount(pair_of, np.repeat(used, np.diff(units.link_ends, prepend=0)), minlength=len(distinct)).astype(np.int64)
        n = len(ends)
        lists = pa.list_(pa.int32())
        whole = lambda x, t: pa.array([None] * n + [x], pa.list_(t))
        return pa.table({
            "block": pa.array([block] * (n + 1), pa.int64()),
            "doc_id": pa.concat_arrays([*rows["doc_id"].chunks, pa.nulls(1, rows["doc_id"].type)]),
            **{name: pa.concat_arrays([pa.array(x), pa.nulls(1, pa.int64())]) for name, x in zip(_FACTS, totals)},
            "groups_sha256": pa.array([*digests, None], pa.string()),
            "units": pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()), pa.array(picked, pa.int32())), pa.nulls(1, lists)]),
            "link_ends": whole(units.link_ends, pa.int32()),
            "links": whole(pair_of, pa.int32()),
            "a": whole(distinct // len(machine.b_bytes), pa.int32()),
            "b": whole(distinct % len(machine.b_bytes), pa.int32()),
            "n": whole(counted, pa.int64()),
        })

    return map_arrow(source, run, schema)


def _scored(block: pa.Table, totals: pa.Table) -> pa.Table:
    """The documents of a block with the totals of its pairs, which come by their place in the block."""
    head = block.filter(block["a"].is_valid())
    rows = block.filter(block["a"].is_null())
    links, ends = (head[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("links", "link_ends"))
    count, best = np.zeros((2, len(head["a"].combine_chunks().flatten())), np.int64)
    at = totals["at"].to_numpy()
    count[at], best[at] = totals["total"].to_numpy(), totals["best"].to_numpy()
    columns = []
    units = rows["units"].combine_chunks()
    picked = units.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(units.offsets.to_numpy())
    for values in (best, count):
        running = np.concatenate([[0], np.cumsum(values[links])])
        per_unit = np.diff(running[ends], prepend=0) if len(ends) else running[:0]
        along = np.concatenate([[0], np.cumsum(per_unit[picked])])
        stop = np.cumsum(lengths)
        columns.append(along[stop] - along[stop - lengths])
    kept = rows.select(["doc_id", *_FACTS, "groups_sha256"])
    return kept.append_column("n_best", pa.array(columns[0], pa.int64())).append_column("count_sum", pa.array(columns[1], pa.int64()))


def pair_counts(measured: DataFrame) -> DataFrame:
    """a, b, total: how many links of the corpus hold both ids."""
    pairs = measured.where("a is not null").select(F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("p.*").where("n > 0")
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("total"))


def digest(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts of tokens, groups and links, links whose pair is the most frequent of its B id, the sum
    of the counts of its links, pairs that share a group, and the digest of the groups."""
    measured = written(_measured(docs, path_a, path_b, doc_id, text))
    counts = written(pair_counts(measured))
    # One row for each id of B: no more than its vocabulary.
    best = counts.groupBy(F.col("b").alias("_b")).agg(F.max("total").alias("most"))
    pairs = measured.where("a is not null").select(F.col("block").alias("part"), F.posexplode(F.arrays_zip("a", "b")).alias("at", "p")).select("part", "at", "p.*")
    totals = (
        pairs.join(counts, ["a", "b"]).join(F.broadcast(best), F.col("b") == F.col("_b"))
        .select("part", "at", "total", F.when(F.col("total") == F.col("most"), 1).otherwise(0).cast("long").alias("best"))
    )
    kind = measured.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{c} bigint' for c in _FACTS)}, groups_sha256 string, n_best bigint, count_sum bigint"
    return measured.groupBy("block").cogroup(totals.groupBy("part")).applyInArrow(_scored, schema)
