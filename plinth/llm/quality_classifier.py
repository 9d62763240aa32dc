"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives and unlabelled web text are enough: with class prior p the risk is
p * E_P[l(g, +)] + max(0, E_U[l(g, -)] - p * E_P[l(g, -)]). The second part is the risk on negatives, which a
flexible model can push below zero; where it falls below, its gradient is turned round.

Features come from whole texts of all rows and are written once. Only the fit is on a sample:
at most about `sample_rows` positives and as many unlabelled rows, chosen by a hash of the id.

Defined cases: NULL and empty texts have all-zero counts and are scored like any other; a NULL id
is never held out; repeated labels of an id count as positive only if all are 1; without any
positive in the training folds every score is the prior given, or 0.5; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm.common import map_arrow, written

FEATURES = [
    "log_words", "word_length", "symbols", "upper", "digits", "marks", "bars", "stops", "dup_lines", "distinct_words",
    "echoes", "wide", "is_short", "log_symbols", "log_marks", "log_bars", "log_echoes", "log_upper",
]
#: Rows of either kind that the fit may use.
SAMPLE_ROWS = 20_000

_WIDE = bytes(range(0x80, 0x100))
_CONTINUATION = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(ord("A"), ord("Z") + 1))


def features(text: bytes | None) -> tuple[float, ...]:
    """FEATURES of one UTF-8 text, all finite."""
    text = text or b""
    size = max(len(text), 1)
    count = lambda chars: len(text) - len(text.translate(None, chars))
    words = text.split()
    n = max(len(words), 1)
    lines = [line for line in text.split(b"\n") if line.strip()]
    symbols, upper, marks, bars = count(b"#*$%&<>"), count(_UPPER), count(b"!?"), count(b"|")
    echoes = sum(map(bytes.__eq__, words, words[1:]))
    small = lambda x: float(np.log(x / size + 1e-3))
    return (
        float(np.log1p(len(words))),
        (len(text) - count(_CONTINUATION)) / n / 10,
        symbols / n,
        upper / size,
        count(b"0123456789") / size,
        marks / n,
        bars / n,
        count(b".,;:") / n,
        1 - len(set(lines)) / max(len(lines), 1),
        len(set(words)) / n,
        echoes / n,
        count(_WIDE) / size,
        float(len(words) < 20),
        small(symbols), small(marks), small(bars), small(echoes * 4), small(upper),
    )


def featurise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of FEATURES per document."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("_bytes"))
    schema = T.StructType([source.schema["doc_id"], *(T.StructField(f, T.DoubleType()) for f in FEATURES)])

    def run(rows: pa.Table) -> pa.Table:
        values = list(zip(*map(features, rows["_bytes"].to_pylist())))
        return pa.table([rows["doc_id"], *(pa.array(v, pa.float64()) for v in values)], names=["doc_id", *FEATURES])

    return map_arrow(source, run, schema)


@dataclass(frozen=True)
class Model:
    """A linear model over standardised features."""

    weights: tuple[float, ...]
    bias: float

    def score(self) -> Column:
        total = F.lit(self.bias)
        for name, weight in zip(FEATURES, self.weights):
            total = total + F.col(name) * F.lit(weight)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.03, decay: float = 1e-4) -> Model:
    """Minimise the non-negative risk with the logistic loss by full-batch Adam."""
    mean, spread = unlabelled.mean(0), unlabelled.std(0) + 1e-6
    p, u = (np.clip((x - mean) / spread, -8, 8) for x in (positive, unlabelled))
    w = np.zeros(p.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    with_one = lambda x: np.hstack([x, np.ones((len(x), 1))])
    p, u = with_one(p), with_one(u)
    for step in range(1, steps + 1):
        gp, gu = p @ w, u @ w
        sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
        negative_risk = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        negative = su @ u / len(u) - prior * (sp @ p) / len(p)
        if negative_risk < 0:
            slope = -negative
        else:
            slope = -prior * ((1 - sp) @ p) / len(p) + negative
        slope = slope + decay * np.append(w[:-1], 0)
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = w[:-1] / spread
    return Model(tuple(map(float, weights)), float(w[-1] - weights @ mean))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(rows: DataFrame, limit: int) -> np.ndarray:
    """About `limit` rows at most, by a hash of the id. This bounded sample goes to the driver."""
    n = rows.count()
    share = min(1.0, limit / max(n, 1))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    table = chosen.select(*FEATURES).limit(2 * limit).toArrow()
    return np.column_stack([table[f].to_numpy() for f in FEATURES]) if table.num_rows else np.zeros((0, len(FEATURES)))


def classify(docs: DataFrame, labels: DataFrame, prior: float | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Every document with `held_out`, `score` and `predicted`.

    `labels` has doc_id and quality; only rows outside the held-out fold are read from it. The
    prior is the share of positives among those, unless given.
    """
    table = written(featurise(docs))
    known = labels.where(~held_out() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    if prior is None:
        share = known.agg(F.avg("quality")).first()[0]
        prior = min(max(0.5 if share is None else float(share), 0.01), 0.99)
    positive = _sample(table.join(known.where("quality = 1").select("doc_id"), "doc_id", "left_semi"), sample_rows)
    unlabelled = _sample(table.where(~held_out()), sample_rows)
    if len(positive) and len(unlabelled):
        score = fit(positive, unlabelled, prior).score()
    else:
        score = F.lit(float(prior))
    scored = table.select("doc_id", held_out().alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
