"""Stored indexes: segments, thresholds, block bounds."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from plinth.functions.fulltext import fts_match, fts_rank, lexemes
from plinth.functions.similarity import jaccard, trigram_codes
from plinth.operators import search, searchindex, simindex, simjoin

WORDS = ["alpha", "beta", "gamma", "delta", "works", "studio", "north", "south", "lab", "house"]


def names(seed, n):
    draw = random.Random(seed)
    return [" ".join(draw.choices(WORDS, k=draw.randrange(1, 4))) for _ in range(n)]


def found(pairs):
    return sorted((r.left_name, r.right_name, round(r.sim, 9)) for r in pairs.collect())


@pytest.mark.parametrize("threshold", [0.3])
def test_index_gives_the_pairs_of_the_join(spark, tmp_path, threshold):
    known = spark.createDataFrame([(n,) for n in names(1, 80)] + [(None,), ("",), ("!",)], "name string")
    asked = spark.createDataFrame([(n + "s",) for n in names(2, 60)] + [(None,), ("",)], "q string")
    index = simindex.build(known.limit(30), "name", str(tmp_path / "a"), 0.3)
    index.extend(known, "name")
    index.extend(known, "name")
    want = found(simjoin.similar_pairs(asked, known, threshold, "q", "name"))
    assert want and found(index.pairs(asked, "q", threshold)) == want
    assert found(index.compact(str(tmp_path / "b")).pairs(asked, "q", threshold)) == want
    assert index.names().count() == known.where("name is not null").distinct().count()


def test_lower_thresholds_than_the_floor_are_refused(spark, tmp_path):
    frame = spark.createDataFrame([("alpha",)], "name string")
    index = simindex.build(frame, "name", str(tmp_path / "i"), 0.5)
    with pytest.raises(ValueError):
        index.pairs(frame, "name", 0.4)


def test_best_equals_the_join(spark, tmp_path):
    targets = spark.createDataFrame([(i, n) for i, n in enumerate(names(3, 90))], "id long, canonical_name string")
    asked = spark.createDataFrame([(n + " x",) for n in names(4, 50)], "name string")
    index = simindex.build(targets, "canonical_name", str(tmp_path / "i"), 0.5)
    rows = lambda df: sorted((r.name, r.id, round(r.sim, 9)) for r in df.collect())
    want = rows(simjoin.best_match(asked, targets, "name"))
    assert want and rows(index.best(asked, "name", targets)) == want


def test_segments_that_were_not_listed_are_not_read(spark, tmp_path):
    frame = spark.createDataFrame([("alpha",)], "name string")
    index = simindex.build(frame, "name", str(tmp_path / "i"))
    index.parts.put("slost", "names", index.names().withColumn("_name", F.lit("ghost")))
    assert [r["_name"] for r in index.names().collect()] == ["alpha"]


def directory(spark, n):
    draw = random.Random(n)
    shown = "entity_type string, id long, slug string, display_name string, canonical_name string, sector string, country string, country_code string, city string, short_description string, role string"
    rows = []
    for i, name in enumerate(names(n, n)):
        kind = draw.choice(["firm", "person"])
        rows.append((kind, i, f"s{i}", name.title(), name, draw.choice(["a", "b"]), draw.choice(["X", None]), None, None, " ".join(draw.choices(WORDS, k=draw.randrange(0, 30))), None))
    base = spark.createDataFrame(rows, shown)
    text = F.concat("display_name", F.lit(" "), "short_description")
    from plinth.functions.fulltext import lexemes
    from plinth.functions.similarity import trigram_codes

    return base.withColumns({"name_grams": trigram_codes("canonical_name"), "text_lexemes": lexemes(text)})


@pytest.mark.parametrize("k", [2, 500])
def test_search_with_bounds_equals_search(spark, tmp_path, k, monkeypatch):
    monkeypatch.setattr(searchindex, "BLOCK", 4)
    entities = directory(spark, 150).cache()
    aliases = spark.createDataFrame([("firm", 5, "alpha alpha"), ("person", 7, "north lab"), ("firm", 999, "beta")], "entity_type string, entity_id long, alias_normalized string")
    tags = spark.createDataFrame([(1, "alpha-kind"), (2, "studio")], "id long, slug string")
    held = spark.createDataFrame([("firm", i, 1 + i % 2) for i in range(0, 150, 3)] + [("person", i, 2) for i in range(1, 150, 4)], "entity_type string, entity_id long, tag_id long")
    queries = spark.createDataFrame(
        [(1, "alpha", None, None), (2, "Alpha works", None, None), (3, "studio north", "a", None), (4, "zzz", None, None), (5, "  ", None, None), (6, "the lab", None, "X")],
        "query_id long, query string, sector string, country string")
    index = searchindex.build(entities.where("id < 90"), aliases, tags, str(tmp_path / "i"))
    index.extend(entities, aliases, tags)
    rows = lambda df: sorted((r.query_id, r.entity_type, r.place, r.id, round(r["rank"], 9)) for r in df.collect())
    want = rows(search.search(queries, entities, aliases, tags, held, k=k))
    assert want and rows(index.search(queries, aliases, tags, held, k=k)) == want


def test_blocks_hold_their_greatest_impact_and_low_ones_are_left_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(searchindex, "BLOCK", 8)
    entities = directory(spark, 200).cache()
    blocks = searchindex.blocked_postings(entities).collect()
    assert all(b.n == len(b.entries) <= 8 and b.most == max(e.impact for e in b.entries) for b in blocks)
    index = searchindex.build(entities, spark.createDataFrame([], "alias_normalized string"), spark.createDataFrame([], "slug string"), str(tmp_path / "i"))
    asked = search.prepared(spark.createDataFrame([(1, "alpha")], "query_id long, query string"))
    bounds = lambda least: asked.select("query_id", F.lit("firm").alias("entity_type"), F.lit(least).cast("double").alias("least"))
    every = index._text_hits(asked, bounds(None), 0.7).count()
    assert every == sum(b.n for b in blocks if b.entity_type == "firm" and b.word == "alpha")
    assert index._text_hits(asked, bounds(0.7), 0.7).count() == every
    assert index._text_hits(asked, bounds(0.71), 0.7).count() < every


def test_search_v1_ranks_names_without_texts_and_equals_all_pairs(spark):
    words = ["alpha", "beta", "gamma", "delta"]
    firms = [("firm" if i % 3 else "person", i, f"s{i}", f"{words[i % 4]} works", f"{words[i % 4]} works {i % 5}", words[i % 2], ["DE", None][i % 2], None, None,
              f"a {words[i % 3]} of {words[i % 4]} trade", None) for i in range(90)]
    names = "entity_type string, id long, slug string, display_name string, canonical_name string, sector string, country string, country_code string, city string, short_description string, role string"
    text = F.concat("display_name", F.lit(" "), "short_description")
    entities = spark.createDataFrame(firms, names).withColumns({"name_grams": trigram_codes("canonical_name"), "text_lexemes": lexemes(text)})
    queries = spark.createDataFrame(
        [(1, "alpha works", None, None), (2, "beta alpha", None, "DE"), (3, "gamma trade", "alpha", None), (4, "delta works 3", None, None), (5, "zzz", None, None)],
        "query_id long, query string, sector string, country string")
    pairs = search._filtered(search.prepared(queries).crossJoin(entities), codes=False)
    told = fts_match(F.col("text_lexemes"), F.col("q_words"))
    sim, rank = jaccard("name_grams", "q_grams"), fts_rank(F.col("text_lexemes"), F.col("q_words"))
    every = pairs.withColumn("rank", F.greatest(sim, F.when(told, rank).otherwise(0.0))).where((sim > 0.2) | told)
    keep = ["query_id", "entity_type", "id", F.round("rank", 9).alias("rank"), "place"]
    found = search.search_v1(queries, entities, k=4)
    want = search._best(every, 4).select(*keep).collect()
    assert len(want) > 20 and sorted(found.select(*keep).collect()) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit [canonical_name" in plan and "BroadcastHashJoin [entity_type" not in plan
