"""Awkward documents that every operator must take."""

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(n, seed, size=5000):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(size)}" for _ in range(n))


def rows():
    same = words(80, 1)
    near = same.split()
    near[40] = "changed"
    return [
        (1, None, "en", "a", 0),
        (2, "", None, None, 0),
        (3, "   \n\t ", "en", "a", 6),
        (4, same, "en", "a", len(same)),
        (5, same, "en", "b", len(same)),
        (6, " ".join(near), "fr", "é", 400),
        (7, words(60, 7) + ' password = "hunter22secret9" end', "en", "b", 300),
        (8, words(30_000, 8, 400_000), "en", "a", 200_000),
        (9, "日本語 😀 " + words(40, 9) + " ▁x  y", "ja", "b", 100),
        (None, words(50, 10), "en", "a", 300),
        (11, words(45, 11), "en", "é", 250),
        (11, words(45, 11), "en", "é", 250),
        (12, "x" * 3000, "en", "b", 3000),
        (13, "Released under the MIT License.\nother text. Licensed under CC BY-NC 4.0.", "en", "a", 70),
    ]


CLASHING = ["n_words", "fail_bits", "ids", "decoded", "key", "node", "row", "hash", "size", "bucket", "target", "copies", "text_bytes", "_copies", "start", "place", "label", "n_tokens", "score", "_key", "_cuts", "_cut_key", "_bytes", "_in", "_row", "_text", "same"]


@pytest.fixture(scope="session")
def odd(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    for name in CLASHING:
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    return docs.cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
