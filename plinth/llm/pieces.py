"""Encoding into pieces by one Viterbi pass over an Aho-Corasick automaton, and decoding.

The automaton holds all normal pieces with their scores. It runs over a text once; at each place
its output links give every piece that ends there, and each relaxes the best score of that place.
Among equal scores the longer piece wins. A character that is no piece costs the lowest score
less a penalty and becomes its UTF-8 bytes. No piece holds a space after another character, so
the best path splits before spaces, and a bounded memo of each worker keeps the paths of stretches.

Decoding joins the bytes of the pieces and drops the space that encoding put in front. It gives
the text back exactly, but that U+2581, which stands for the space, comes back as a space.

Defined cases: NULL and empty texts have no ids and decode to an empty text; unpaired byte ids
decode to U+FFFD, ids outside the vocabulary to nothing; repeated rows give repeated results; an empty table gives no rows; other
columns pass through, and columns named like a result are replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm.common import map_arrow

UNKNOWN_PENALTY = 10.0
#: Bytes of stretches and their ids that a worker remembers before it starts anew, and what an entry costs besides.
MEMO_BYTES = 32 << 20
ENTRY_BYTES = 200
#: Characters of texts that are split together, and of new stretches in one Viterbi pass.
GROUP_CHARS = 1_500_000
BLOCK_CHARS = 200_000
#: Longer stretches are taken one by one.
LONG_STRETCH = 400

_SPACE = "▁"
_STRETCH = re.compile(f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+$")


class Automaton:
    """Aho-Corasick over the pieces, as arrays: moves, output links, and the piece of each state.

    Characters below DENSE and the escaped space have a full table of moves; for any other the
    failure links are followed to a state that has the move.
    """

    DENSE = 256

    def __init__(self, names: list[str], ids: list[int]) -> None:
        children: list[dict[str, int]] = [{}]
        piece, depth = [-1], [0]
        for name, i in zip(names, ids):
            at = 0
            for c in name:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    piece.append(-1)
                    depth.append(depth[at] + 1)
                at = children[at][c]
            piece[at] = i
        n = len(children)
        fail, link = [0] * n, [0] * n
        moves = np.zeros((n, self.DENSE + 1), np.uint16 if n <= 1 << 16 else np.int32)
        queue = [0]
        for state in queue:
            up = fail[state]
            if state:
                moves[state] = moves[up]
                link[state] = up if piece[up] >= 0 else link[up]
            for c, child in children[state].items():
                back = up
                while state and back and c not in children[back]:
                    back = fail[back]
                fail[child] = children[back].get(c, 0) if state else 0
                if (column := self.column(c)) <= self.DENSE:
                    moves[state, column] = child
                queue.append(child)
        self.children, self.moves = children, moves
        self.piece, self.link, self.fail, self.depth = (np.array(x, np.int64) for x in (piece, link, fail, depth))
        # States that give a piece: their own, or the first on their output links.
        self.gives = np.where(self.piece >= 0, np.arange(n), self.link)

    def column(self, c: str) -> int:
        return self.DENSE if c == _SPACE else ord(c) if ord(c) < self.DENSE else self.DENSE + 1

    def move(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The next states after one character each."""
        columns = np.where(codes == ord(_SPACE), self.DENSE, codes)
        wide = columns > self.DENSE
        if not wide.any():
            return self.moves[states, columns]
        out = self.moves[states, np.where(wide, 0, columns)]
        for i in np.flatnonzero(wide).tolist():
            out[i] = self.step(int(states[i]), chr(codes[i]))
        return out

    def step(self, state: int, c: str) -> int:
        while state and c not in self.children[state]:
            state = int(self.fail[state])
        return self.children[state].get(c, 0)


class Lattice:
    """Pieces, scores and the automaton of one model."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.output: list[bytes] = []
        self.byte_ids = [0] * 256
        names, scores, kept = [], [], []
        for i in range(model.get_piece_size()):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(name[3:5], 16)
                self.byte_ids[value] = i
                self.output.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                self.output.append(b"")
            else:
                names.append(name)
                scores.append(model.get_score(i))
                kept.append(i)
                self.output.append(name.replace(_SPACE, " ").encode())
        self.automaton = Automaton(names, kept)
        #: By id; the last, which -1 finds, is a character that is no piece.
        self.scores, self.sizes = np.zeros(len(self.output) + 1), np.ones(len(self.output) + 1, np.int64)
        self.scores[kept], self.sizes[kept] = scores, list(map(len, names))
        self.scores[-1] = min(scores) - UNKNOWN_PENALTY
        self.single = np.array(sorted(ord(n) for n in names if len(n) == 1), np.uint32)
        self.splits = not any(re.search(f"[^{_SPACE}]{_SPACE}", n) for n in names)
        self.memo: dict[str, bytes] = {}
        self.memo_bytes = 0

    def viterbi(self, stretches: list[str]) -> list[bytes]:
        """Ids of the best path of each stretch, packed; spaces are escaped, longest stretch first.

        All stretches take a character at a time together. After each the output links of the
        states name the pieces that end there, the longest first, and relax the best scores.
        """
        lengths = np.fromiter(map(len, stretches), np.int64, len(stretches))
        n, longest = len(stretches), int(lengths[0])
        codes = np.zeros((n, longest), np.uint32)
        codes[np.arange(longest) < lengths[:, None]] = np.frombuffer("".join(stretches).encode("utf-32-le"), np.uint32)
        known = np.isin(codes, self.single)
        best = np.full((longest + 1, n), -np.inf)
        best[0] = 0.0
        by = np.full((longest + 1, n), -1, np.int64)
        states = np.zeros(n, np.int64)
        machine = self.automaton
        for at in range(longest):
            active = int(np.searchsorted(-lengths, -at, "left"))
            states = machine.move(states[:active], codes[:active, at])
            top, chosen = best[at + 1], by[at + 1]
            who = np.arange(active)
            ending = machine.gives[states]
            while len(who := who[ending > 0]):
                ending = ending[ending > 0]
                piece = machine.piece[ending]
                total = best[at + 1 - machine.depth[ending], who] + self.scores[piece]
                better = total > top[who]
                top[who[better]], chosen[who[better]] = total[better], piece[better]
                ending = machine.link[ending]
            strange = np.flatnonzero(~known[:active, at])
            strange = strange[best[at, strange] + self.scores[-1] > top[strange]]
            top[strange], chosen[strange] = best[at, strange] + self.scores[-1], -1
        return self._paths(stretches, lengths, by)

    def _paths(self, stretches: list[str], lengths: np.ndarray, by: np.ndarray) -> list[bytes]:
        """The paths back from the ends, written in reading order."""
        place, rows, taken = lengths.copy(), np.arange(len(lengths)), []
        while place.any():
            piece = np.where(place > 0, by[place, rows], -2)
            taken.append(piece)
            place = np.where(place > 0, place - self.sizes[np.maximum(piece, -1)], 0)
        steps = np.array(taken[::-1]).T.reshape(len(lengths), -1)
        flat = steps[steps != -2].astype(np.int32)
        ends = np.cumsum((steps != -2).sum(1)).tolist()
        packed, out, begin = flat.tobytes(), [], 0
        odd = set(np.flatnonzero((steps == -1).any(1)).tolist())
        for row, end in enumerate(ends):
            out.append(self._bytes(stretches[row], flat[begin:end].tolist()) if row in odd else packed[4 * begin : 4 * end])
            begin = end
        return out

    def _bytes(self, stretch: str, path: list[int]) -> bytes:
        """A path with characters that are no piece put as the ids of their bytes."""
        ids, at = [], 0
        for piece in path:
            ids += [piece] if piece >= 0 else [self.byte_ids[b] for b in stretch[at].encode()]
            at += int(self.sizes[piece])
        return array("i", ids).tobytes()

    def one(self, stretch: str) -> bytes:
        """The same path for one very long stretch, which is not worth arrays of width one."""
        machine, n = self.automaton, len(stretch)
        children, fail = machine.children, machine.fail.tolist()
        gives, link, piece_of, scores = machine.gives.tolist(), machine.link.tolist(), machine.piece.tolist(), self.scores.tolist()
        depth, single = machine.depth.tolist(), set(map(chr, self.single.tolist()))
        best, by, state = [0.0] + [-float("inf")] * n, [-1] * (n + 1), 0
        for at, c in enumerate(stretch, 1):
            while state and c not in children[state]:
                state = fail[state]
            state = children[state].get(c, 0)
            ending = gives[state]
            while ending:
                total = best[at - depth[ending]] + scores[piece_of[ending]]
                if total > best[at]:
                    best[at], by[at] = total, piece_of[ending]
                ending = link[ending]
            if c not in single and best[at - 1] + scores[-1] > best[at]:
                best[at], by[at] = best[at - 1] + scores[-1], -1
        path, at = [], n
        while at:
            path.append(by[at])
            at -= int(self.sizes[by[at]])
        return self._bytes(stretch, path[::-1])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as packed 32-bit integers."""
        out: list[bytes] = []
        group: list[list[str]] = []
        size = 0
        for text in texts:
            escaped = _SPACE + text.replace(" ", _SPACE) if text else ""
            group.append(_STRETCH.findall(escaped) if self.splits or not escaped else [escaped])
            size += len(escaped)
            if size > GROUP_CHARS:
                out += self._encode(group)
                group, size = [], 0
        return out + self._encode(group)

    def _encode(self, group: list[list[str]]) -> list[bytes]:
        memo = self.memo
        if self.memo_bytes > MEMO_BYTES:
            memo.clear()
            self.memo_bytes = 0
        fresh = sorted({s for stretches in group for s in stretches if s not in memo}, key=len, reverse=True)
        at = 0
        while at < len(fresh) and len(fresh[at]) > LONG_STRETCH:
            memo[fresh[at]] = self.one(fresh[at])
            self.memo_bytes += ENTRY_BYTES + len(fresh[at]) + len(memo[fresh[at]])
            at += 1
        while at < len(fresh):
            upto = at + max(1, BLOCK_CHARS // len(fresh[at]))
            found = self.viterbi(fresh[at:upto])
            memo.update(zip(fresh[at:upto], found))
            self.memo_bytes += sum(map(len, found)) + sum(map(len, fresh[at:upto])) + ENTRY_BYTES * len(found)
            at = upto
        return [b"".join(map(memo.__getitem__, stretches)) for stretches in group]

    def decode(self, ids: list[int] | None) -> str:
        output, n = self.output, len(self.output)
        return self._text(output[i] for i in ids or () if i is not None and 0 <= i < n)

    def unpack(self, packed: bytes) -> str:
        """The text of ids that `encode` packed."""
        return self._text(map(self.output.__getitem__, memoryview(packed).cast("i")))

    @staticmethod
    def _text(parts: Iterable[bytes]) -> str:
        return b"".join(parts).decode("utf-8", "replace").removeprefix(" ")


_LOADED: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    """The automaton of a path, built once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = Lattice(path)
    return _LOADED[path]


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", same: str | None = None) -> DataFrame:
    """`docs` with the piece ids of its texts and, if named, with `same`: whether they decode to the text.

    Rows travel whole in one column beside the text, so no name can clash.
    """
    source = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(text).cast("string").alias("text"))
    fields = [source.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("same", T.BooleanType())]

    def run(rows: pa.Table) -> pa.Table:
        model = lattice(model_path)
        texts = rows["text"].to_pylist()
        packed = model.encode(texts)
        equal = [model.unpack(p) == (t or "") for p, t in zip(packed, texts)] if same else [None] * len(texts)
        ends = np.cumsum([0, *map(len, packed)]) // 4
        values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))
        return pa.table([rows["row"], values, pa.array(equal, pa.bool_())], names=["row", "ids", "same"])

    found = map_arrow(source, run, T.StructType(fields))
    added = {ids: "ids", **({same: "same"} if same else {})}
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in added]
    return found.select(*kept, *(F.col(c).alias(name) for name, c in added.items()))


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`encoded` with the text that its piece ids stand for."""
    source = encoded.select(F.struct(*[F.col(c) for c in encoded.columns]).alias("row"), F.col(ids).alias("ids"))

    def run(rows: pa.Table) -> pa.Table:
        model = lattice(model_path)
        return pa.table([rows["row"], pa.array(list(map(model.decode, rows["ids"].to_pylist())), pa.string())], names=["row", "text"])

    found = map_arrow(source, run, T.StructType([source.schema["row"], T.StructField("text", T.StringType())]))
    return found.select(*(F.col("row").getField(c).alias(c) for c in encoded.columns if c != text), F.col("text").alias(text))


def round_trip(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, and whether decoding gives the text back, in one pass of one worker a task."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return encode(source, model_path, same="same").select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "same")
