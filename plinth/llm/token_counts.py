"""Token counts of whole texts for a BPE piece model, equal to those of its library.

A boundary between two characters is *stable* if no piece of the vocabulary that occurs there
spans it. Merges build pieces only, so no merge can cross a stable boundary: the tokens of the
text are those of its two sides put together. Two things follow from that proof.

* Huge documents are encoded in overlapping chunks with offsets. In each overlap a boundary that
  both encodings share and that is stable splices them. Where an overlap has none, it is widened,
  up to the rest of the text.
* Other texts are cut at stable boundaries before spaces, and the count of each stretch is
  remembered in a bounded table of the worker, so that a stretch is encoded once.

Defined cases: NULL and empty texts have no tokens; repeated rows give repeated results; an empty
table gives no rows; only the id and the text are read, so other columns never clash.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F

from plinth.llm.common import map_arrow

#: Texts of more characters are encoded in overlapping chunks of this length.
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256
#: Stretches that a worker remembers before it starts anew.
MEMO = 300_000
#: Characters of texts that are cut together.
GROUP_CHARS = 4_000_000
#: New stretches encoded in one call.
JOINED = 256

_SPACES = "[ ▁]"
_STRETCH = re.compile(f"{_SPACES}+[^ ▁]*")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Pieces:
    """A loaded piece model with the facts about its vocabulary that the splice rests on."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.normal = {n for i, n in enumerate(names) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))}
        self.longest = max(map(len, self.normal))
        self.lengths = np.array([self._characters(i, n) for i, n in enumerate(names)], np.int64)
        self.cuts_at_spaces = not any(re.search("[^▁]▁", n) for n in self.normal)
        self.memo: dict[str, int] = {}

    def _characters(self, i: int, name: str) -> int:
        """Characters a token stands for; of the bytes of a character the first stands for it."""
        if self.model.is_byte(i):
            value = int(_BYTE.match(name)[1], 16)
            return int(not 0x80 <= value < 0xC0)
        return len(name) if name in self.normal else int(self.model.is_unknown(i))

    def stable(self, text: str, at: int) -> bool:
        """Whether no piece that occurs in the text spans the boundary before `text[at]`."""
        near = text[max(0, at - self.longest + 1) : at + self.longest - 1].replace(" ", "▁")
        cut = min(at, self.longest - 1)
        return not any(near[a:b] in self.normal for a in range(cut) for b in range(cut + 1, min(len(near), a + self.longest) + 1))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk, and where each token ends in it. The model's leading space is outside."""
        ids = np.asarray(self.model.encode(text), np.int64)
        return ids, np.cumsum(self.lengths[ids]) - 1

    def spliced(self, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
        """Tokens of one huge text by overlapping chunks."""
        total, start, done = 0, 0, -1
        end = min(chunk, len(text))
        ids, ends = self.encode(text[start:end])
        while True:
            if end == len(text):
                return total + int((ends + start > done).sum())
            width, at = overlap, None
            while at is None:
                behind = max(end - width, done, start)
                next_end = min(behind + max(chunk, 2 * width), len(text))
                next_ids, next_ends = self.encode(text[behind:next_end])
                shared = np.intersect1d(ends + start, next_ends + behind)
                shared = shared[(shared > behind) & (shared < end) & (shared > done)]
                at = next((int(p) for p in shared[::-1] if self.stable(text, int(p))), None)
                if at is None and behind <= max(done, start):
                    # The overlap is the whole chunk: take in more text instead.
                    end = min(len(text), max(next_end, start + 2 * (end - start)))
                    ids, ends = self.encode(text[start:end])
                    break
                width *= 2
            if at is None:
                continue
            total += int(((ends + start > done) & (ends + start <= at)).sum())
            done, start, end, ends = at, behind, next_end, next_ends

    def count(self, texts: list[str | None], chunk: int = CHUNK_CHARS) -> list[int]:
        """Tokens of each text."""
        out: list[int] = []
        group: list[str] = []
        size = 0
        for text in texts:
            if text and len(text) > chunk:
                out += [*self._counts(group), self.spliced(text, chunk)]
                group, size = [], 0
                continue
            group.append(text or "")
            size += len(group[-1])
            if size > GROUP_CHARS:
                out += self._counts(group)
                group, size = [], 0
        return out + self._counts(group)

    def _stretches(self, text: str) -> list[str]:
        """The text cut before spaces, each stretch without its first space."""
        if not text:
            return []
        if not self.cuts_at_spaces:
            return [text]
        # The model puts a space in front; each stretch begins with one, and is encoded without it.
        plain = text[0] != " " and "  " not in text and "▁" not in text
        return text.split(" ") if plain else [s[1:] for s in _STRETCH.findall(" " + text)]

    def _counts(self, texts: list[str]) -> list[int]:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        cut = list(map(self._stretches, texts))
        self._learn([s for s in {s for stretches in cut for s in stretches} if s not in memo])
        return [sum(map(memo.__getitem__, stretches)) for stretches in cut]

    def _learn(self, fresh: list[str]) -> None:
        """Count new stretches, JOINED at a time: a space between two is a stable boundary."""
        joinable = [s for s in fresh if s and s[-1] not in " ▁"]
        for at in range(0, len(joinable), JOINED):
            part = joinable[at : at + JOINED]
            _, ends = self.encode(" ".join(part))
            stops = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
            upto = np.searchsorted(ends, stops, "right")
            self.memo.update(zip(part, np.diff(upto, prepend=0).tolist()))
        # Spaces alone could join the stretch that follows.
        self.memo.update((s, len(self.model.encode(s)) if s else 1) for s in fresh if not s or s[-1] in " ▁")


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The model of a path, loaded once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, chunk: int = CHUNK_CHARS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every text."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    schema = T.StructType([source.schema["doc_id"], source.schema["n_bytes"], T.StructField("n_tokens", T.LongType())])

    def run(rows: pa.Table) -> pa.Table:
        model = pieces(model_path)
        counts = model.count(rows["_text"].to_pylist(), chunk)
        return pa.table([rows["doc_id"], rows["n_bytes"], pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return map_arrow(source, run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
