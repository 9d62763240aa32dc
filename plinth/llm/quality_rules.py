"""Rule bitmask ledger: every rule is judged once per text, its failure kept as one bit.

`ledger` reads each whole text once and adds measurements and `fail_bits`. Policies are versions
of a mask over those bits: `apply_policy` and `ablations` never look at a text again.

Defined cases: a NULL or empty text has no words and fails `too_few_words`; ties and repeated
rows are judged row by row; an empty table gives an empty ledger; input columns that carry the
name of a ledger column are replaced, all others pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm.common import map_arrow

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper"]
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
_SPACE = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(ord("A"), ord("Z") + 1))

#: Bit number and failing condition of every rule. A rule keeps its bit for good.
RULES: dict[str, tuple[int, str]] = {
    "too_few_words": (0, "n_words < 20"),
    "repeated_windows": (1, "100 * n_repeat_words > 30 * n_words"),
    "symbol_heavy": (2, "n_symbols > n_words"),
    "repeated_lines": (3, "100 * n_dup_lines > 30 * n_lines"),
    "odd_word_length": (4, "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    "shouting": (5, "2 * n_upper > word_chars"),
}
#: Versioned policies: the rules whose failure rejects a text.
POLICIES: dict[str, list[str]] = {
    "base": ["too_few_words", "repeated_windows"],
    "v1": ["too_few_words", "repeated_windows", "symbol_heavy", "repeated_lines"],
    "v2": list(RULES),
}


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each key, and whether the key occurs twice or more."""
    _, rank, count = np.unique(keys, return_inverse=True, return_counts=True)
    return rank, count[rank] > 1


def repeat_words(words: list[bytes]) -> int:
    """Words inside WINDOW-word windows that occur at least twice.

    Windows of 2, 4 and 8 words are ranked in turn, each only where both halves repeat; ranks are
    exact, no hash stands for a window.
    """
    n = len(words)
    if n <= WINDOW:
        return 0
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    rank = np.fromiter(map(index.__getitem__, words), np.int64, n)
    at, width = np.arange(n), 1
    while width < WINDOW:
        known = np.full(n + width, -1, np.int64)
        known[at] = rank
        first, second = known[:n], known[width : n + width]
        at = np.flatnonzero((first >= 0) & (second >= 0))
        if not len(at):
            return 0
        rank, again = _repeated(first[at] * n + second[at])
        at, rank, width = at[again], rank[again], width * 2
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """MEASURES of one UTF-8 text. Words are runs of anything but ASCII white space."""
    text = text or b""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text.translate(None, _SPACE + _CONTINUATION)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(text) - len(text.translate(None, _UPPER)),
    )


def mask(rules: list[str]) -> int:
    return sum(1 << RULES[name][0] for name in rules)


def fail_bits() -> Column:
    bits = F.lit(0).cast("long")
    for bit, failing in RULES.values():
        bits = bits.bitwiseOR(F.when(F.expr(failing), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`docs` (or its `carry` columns) with MEASURES and `fail_bits`."""
    names = [c for c in (docs.columns if carry is None else carry) if c not in (*MEASURES, "fail_bits")]
    # The kept columns travel as one, so no name can clash.
    source = docs.select(F.struct(F.lit(1), *[F.col(c) for c in names]).alias("row"), F.col(text).cast("binary").alias("text"))
    schema = T.StructType([source.schema["row"], *(T.StructField(m, T.LongType()) for m in MEASURES)])

    def run(rows: pa.Table) -> pa.Table:
        found = list(zip(*map(measure, rows["text"].to_pylist())))
        return pa.table([rows["row"], *(pa.array(values, pa.int64()) for values in found)], names=["row", *MEASURES])

    judged = map_arrow(source, run, schema).withColumn("fail_bits", fail_bits())
    return judged.select(*(F.col("row").getField(c).alias(c) for c in names), *MEASURES, "fail_bits")


def passes(policy: str, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def apply_policy(judged: DataFrame, policy: str) -> DataFrame:
    """The rows of a ledger that pass a policy version."""
    return judged.where(passes(policy))


def ablations(judged: DataFrame, policies: dict[str, list[str]] | None = None) -> DataFrame:
    """Per policy and rule: rows it fails, rows only it fails, rows kept with and without it.

    Rows are first counted by `fail_bits`, at most 2^rules groups; all else is bit arithmetic.
    """
    chosen = policies or POLICIES
    cells = [
        F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask(rules)).cast("long").alias("mask"), F.lit(1 << RULES[r][0]).cast("long").alias("bit"))
        for p, rules in chosen.items()
        for r in rules
    ]
    counted = judged.groupBy("fail_bits").agg(F.count("*").alias("n"))
    spread = counted.withColumn("c", F.explode(F.array(*cells))).select("fail_bits", "n", "c.*")
    failed = F.col("fail_bits").bitwiseAND(F.col("mask"))
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0).cast("long"))
    return spread.groupBy("policy", "rule").agg(
        total(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(failed == F.col("bit")).alias("n_only_this"),
        total(failed == 0).alias("n_kept"),
        total((failed == 0) | (failed == F.col("bit"))).alias("n_kept_without"),
    )
