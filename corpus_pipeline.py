"""The corpus pipeline: rules, near-duplicates, secrets, mix, pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. `run` writes
the rows between stages as Parquet, so that a lost executor costs one stage at most.

NULL and empty texts fail the rules of the first stage. All stages but the last return the
columns they were given, whatever other columns there are; an empty table passes through.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import minhash, mixing, pieces, quality_rules, secrets
from plinth.llm.common import table, written

POLICY = "v1"
PIECE_MODEL = "piece_bpe_32k.model"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rule policy; the row travels whole beside its measurements."""
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), "text")
    judged = quality_rules.ledger(packed, carry=["_row"])
    return quality_rules.apply_policy(judged, POLICY).select("_row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return minhash.deduplicate(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Values of live credentials replaced; widely copied examples stay."""
    clean = secrets.redact(docs, F.col("source"), F.concat_ws("/", "source", "lang"))
    size = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return clean.withColumn("n_chars", size).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text."""
    model = public_tokenizers.path(PIECE_MODEL)
    coded = pieces.encode(docs.select("doc_id", "source", "lang", "n_chars", "text"), model, same="same")
    return coded.select("doc_id", "source", "lang", "n_chars", "ids", F.size("ids").cast("long").alias("n_tokens"), "same")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_good),
    ("near-duplicates", drop_copies),
    ("secrets", hide_secrets),
    ("mix", mix_sources),
    ("pieces", encode),
]
#: SQL cannot express near-duplicate classes and piece paths; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
