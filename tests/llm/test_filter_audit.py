"""Filter interactions against every document led through every order."""

from __future__ import annotations

import random
from itertools import permutations
from math import factorial

import pytest
from pyspark.sql import functions as F

from plinth.llm import filter_audit as fa


@pytest.mark.parametrize("n", [1, 3, 5])
def test_paths_over_a_state_are_the_orders_through_it(n):
    forward, backward = fa.path_counts(n)
    for state in range(1 << n):
        size = state.bit_count()
        assert (forward[state], backward[state]) == (factorial(size), factorial(n - size))


def plain(rows, letters):
    """rows: part, set of failed letters, good, toxic."""
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        removed = dict.fromkeys(letters, 0)
        for order in permutations(letters):
            there = mine
            for step, x in enumerate(order, 1):
                gone = [r for r in there if x in r[1]]
                there_after = [r for r in there if x not in r[1]]
                failing = [r for r in mine if x in r[1]]
                out[part, "".join(order), step] = [
                    len(there_after), len(gone), len(failing) - len(gone), sum(r[1] == {x} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)
                ]
                removed[x] += len(gone)
                there = there_after
        for key in out:
            if key[0] == part:
                out[key] = [*out[key][:6], removed[key[1][key[2] - 1]]]
    return out


@pytest.mark.parametrize("letters", ["X", "PQR", "ABCDE"])
def test_audit_equals_plain_walks(spark, letters):
    draw = random.Random(len(letters))
    rows = [(draw.choice("uv"), {x for x in letters if draw.random() < 0.3}, draw.random() < 0.5, draw.random() < 0.2) for _ in range(60)]
    table = spark.createDataFrame([(p, sum(1 << letters.index(x) for x in f), g, t) for p, f, g, t in rows], "part string, fails int, good boolean, toxic boolean")
    got = {(r[0], r[1], r[2]): list(r[3:]) for r in fa.audit(table, letters, losses=("good", "toxic")).collect()}
    assert got == plain(rows, letters)


def test_too_many_filters_are_refused(spark):
    with pytest.raises(ValueError):
        fa.audit(spark.range(1).selectExpr("'' as part", "0 as fails"), "ABCDEFGH")


def test_text_fails_at_the_bounds():
    words = [f"w{i}" for i in range(200)]
    assert fa.text_fails(" ".join(words).encode()) == 0
    assert fa.text_fails(" ".join(words[:199]).encode()) == 1
    assert fa.text_fails(None) == fa.text_fails(b"") == 1
    assert fa.text_fails(b" ".join([b"a", b"b"] * 150)) == 2
    half = " ".join(words[:150] * 2)
    assert fa.text_fails(half.encode()) == 0
    assert fa.text_fails((half + "é" * (98 - len(half) % 98 + 98 * 40) + "Z").encode()) & 4 == 0
    assert fa.text_fails((half + "ZZZZZZZZZZZZZZZZZZZZZZZZZZZZZZZZZZZZZZZ").encode()) == 4
    assert fa.text_fails((half + " |").encode()) == 8


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (5, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    judged = fa.five_filters(odd, labels)
    # Of equal texts only later ids fail E: NULL and '' of 1 and 2, the text of 4 and 5; both rows of 11 stay.
    assert judged.where(F.col("fails").bitwiseAND(16) != 0).count() == 2
    assert judged.where("good and toxic").count() == 1
    found = fa.audit(judged, fa.LETTERS, losses=("good", "toxic"))
    parts = {"", "a", "b", "é"}
    assert {r.part for r in found.select("part").distinct().collect()} == parts and found.count() == 600 * len(parts)
    assert judged.count() == odd.count()
    assert fa.audit(fa.five_filters(none, labels), fa.LETTERS).count() == 0


def test_copies_of_one_text_over_many_rows(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.lit(None).cast("string").alias("source"))
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    judged = fa.five_filters(docs, labels)
    assert judged.where(F.col("fails").bitwiseAND(16) == 0).count() == 1 and judged.count() == 3000
