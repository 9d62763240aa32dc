"""Plans and results of queries that must not grow faster than their input."""

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from plinth import session
from plinth.functions import pages, text
from plinth.operators import detail, resolve, search
from plinth.plans.standins import StandIns
from plinth.sources import works


def test_source_context_packs_titles_before_the_shuffle(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(300)]
    titles = {i: " ".join(rng.choices(words, k=400)) + " ü" for i in range(40)} | {40: "", 41: None}
    links = [("firm" if e % 2 else "person", e, s) for e in range(50) for s in rng.sample(range(45), 9)]
    got = detail.source_context(
        spark.createDataFrame(links, "entity_type string, entity_id long, source_id long"),
        spark.createDataFrame(list(titles.items()), "id long, title string"))
    want = {}
    for kind, entity in {l[:2] for l in links}:
        first = sorted(s for k, e, s in links if (k, e) == (kind, entity))[:5]
        if shown := [titles[s] for s in first if titles.get(s)]:
            want[kind, entity] = "Mentioned in: " + "; ".join(shown)
    assert {(r["entity_type"], r["entity_id"]): r["context"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(struct(source_id, source_id, title" not in plan and "packed_text" in plan and "ObjectHashAggregate" not in plan


def test_source_context_orders_titles_of_one_source(spark):
    links = spark.createDataFrame([("firm", 1, 7)], "entity_type string, entity_id long, source_id long")
    sources = spark.createDataFrame([(7, "b"), (7, "a")], "id long, title string")
    assert detail.source_context(links, sources).first()["context"] == "Mentioned in: a; b"
    assert detail.source_context(links, sources.where(F.lit(False))).count() == 0


def test_shuffles_begin_in_proportion_to_the_input(spark, monkeypatch):
    name, merged = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name, None)
    monkeypatch.setattr(session, "PARTITION_INPUT_BYTES", 1_000)
    try:
        df = StandIns(spark, "/root/testdata/sf0.001").sql("select o_custkey, count(*) as n from orders group by 1")
        started = int(spark.conf.get(name))
        assert started > 4 and df.count() > 0
        assert f"{started})" in df._jdf.queryExecution().toString()
        spark.conf.set(merged, "1000000b")
        session.roomy_shuffles(spark, 0)
        assert spark.conf.get(merged) == "1000000b"
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
        spark.conf.unset(merged)


def test_rows_without_a_key_meet_no_single_task(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(4000).select("id", F.when(F.col("id") % 4 == 0, F.col("id") % 50).alias("k"))
        known = spark.range(40).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name"))
        joined = detail.left_join(rows, known, "k", ["id"])
        got = {(r["id"], r["name"]) for r in joined.collect()}
        assert got == {(i, f"n{i % 50}" if i % 4 == 0 and i % 50 < 40 else None) for i in range(4000)}
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 2000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_works_are_parsed_once(spark):
    text = ('{"id": "W1", "title": " T ", "publication_year": 2000, "topics": [{"display_name": "urban robot"}], "authorships": ['
            '{"author": {"id": "A1", "display_name": "Ann"}, "institutions": [{"display_name": " Urban Lab "}, {"display_name": "Urban Lab", "country_code": "DE"}]}]}')
    parsed = works.parse_works(spark.createDataFrame([(text,), (None,), ("{",)], "value string"))
    out = works.flatten_works(parsed)
    assert [tuple(r) for r in out["institutions"].select("url", "name", "country_code", "sector").collect()] == [("W1", "Urban Lab", None, "architecture")]
    assert [r["author"] for r in out["sources"].collect()] == ["Ann"]
    for df in out.values():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1, plan


def test_image_candidates_work_out_their_ranking_once(spark):
    html = "".join(f'<img srcset="a{i % 30}.jpg 1200w">' for i in range(60)) + '<meta property="og:image" content="https://c.example.com/x.jpg?w=400">'
    facts = spark.createDataFrame([(html,)], "html string").select(pages.page_facts("html").alias("facts"))
    found = facts.select(pages.image_candidates("facts", F.lit("https://s.example.com/p")).alias("i"))
    assert [(i["priority"], i["url"].rsplit("/", 1)[1]) for i in found.first()["i"]] == [
        (1, f"a{i}.jpg") for i in range(30)] + [(4, "x.jpg?w=1600"), (5, "x.jpg?w=400")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("sort_array") == 1


def test_pages_go_to_python_in_batches_of_bounded_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)

    @F.pandas_udf("int")
    def batch_rows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([len(batch)] * len(batch))

    pages.page_facts("html")
    rows = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 200_000).alias("html"))
    most = rows.select(batch_rows("html").alias("n")).agg(F.max("n")).first()[0]
    assert most <= 60


def test_words_are_not_looked_for_byte_by_byte(spark):
    rng = random.Random(5)
    words = ["art", "arts & crafts", "tar", "ar", "a.b", "rta", "r", "ta r", "über", "c++", "(x)"]
    texts = ["".join(rng.choices(["ar", "t", "a", " ", "s & crafts", ".", "b", "über", "c++", "(x)", "ÜBER", "A.B", "xb"], k=9)) for _ in range(300)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", text.matching_words("t", words).alias("found"))
    got = {r["id"]: r["found"] for r in df.collect()}
    assert got == {i: [w for w in words if w in (t or "").lower()] for i, t in enumerate(texts)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "Contains(" not in plan


def test_names_are_normalised_once_and_in_all_tasks(spark):
    targets = spark.createDataFrame([(5, "north works"), (3, "north works"), (9, "delta lab")], "id long, canonical_name string")
    aliases = spark.createDataFrame([(9, "person", "dl")], "entity_id long, entity_type string, alias_normalized string")
    rows = [(1, "North  Works, GmbH"), (2, "north works s"), (3, "DL"), (4, "unheard of"), (5, None), (6, "North  Works, GmbH")]
    candidates = spark.createDataFrame(rows, "pos long, name string").coalesce(1)
    for way in (resolve.resolve, resolve.resolve_batch):
        got = way(candidates.where("name is not null") if way is resolve.resolve_batch else candidates, targets, aliases, "person")
        found = {r["pos"]: (r["match_type"], r["entity_id"] or r["suggested_id"]) for r in got.collect()}
        assert found[1] == found[6] == ("exact", "3") and found[2] == ("trigram", "3") and found[3] == ("alias", "9") and found[4][0] == "new"
        # The pattern of the legal forms: names are read, not normalised again (a batch also normalises aliases).
        assert way is resolve.resolve_batch or "gmbh" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_search_ranks_only_the_best_names_of_a_query_further(spark, monkeypatch):
    firms = [(i, f"f{i}", "Alpha Works", "alpha works", "design", "X", None, None, None, None, "published") for i in range(1, 41)]
    firms += [(90, "f90", "Beta", "beta", "design", "X", None, None, "alpha works trade", None, "published")]
    columns = "id long, slug string, display_name string, canonical_name string, sector string, country string, country_code string, city string, short_description string, merged_into long, publish_status string"
    people = spark.createDataFrame([], "id long, slug string, display_name string, canonical_name string, sector string, bio string, role string, publish_status string")
    queries = spark.createDataFrame([(1, " Alpha Works ")], "query_id long, query string")
    aliases = spark.createDataFrame([("firm", 40, "alpha work")], "entity_type string, entity_id long, alias_normalized string")
    tags = spark.createDataFrame([(7, "alpha-works"), (8, "other")], "id long, slug string")
    held = spark.createDataFrame([("firm", 39, 7), ("firm", 38, 8)], "entity_type string, entity_id long, tag_id long").distinct()
    ranked, whole = [], search.alias_best_sim
    monkeypatch.setattr(search, "alias_best_sim", lambda pairs, names: ranked.extend(r["id"] for r in pairs.select("id").collect()) or whole(pairs, names))
    entities = search.searchable(spark.createDataFrame(firms, columns), people)
    got = search.search(queries, entities, aliases, tags, held, k=3).collect()
    assert [(r["id"], r["rank"], r["place"]) for r in got] == [(1, 2.0, 1), (2, 2.0, 2), (3, 2.0, 3)]
    # Of forty equal names three are handed on by the name; texts, tags and aliases admit others..
    named = search._best_named(search.prepared(queries), entities, spark.createDataFrame([("alpha works", "alpha works", 1.0)], "left_name string, right_name string, sim double"), 3)
    assert sorted(r["id"] for r in named.collect()) == [1, 2, 3]
    assert {39, 40, 90} <= set(ranked)
    plan = search.holders(session.write_once(tags.select(F.col("id").alias("tag_id"))), held)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")


def test_merged_shuffle_partitions_stay_small(spark):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name, None)
    try:
        spark.conf.unset(name)
        session.roomy_shuffles(spark, 0)
        assert int(spark.conf.get(name).rstrip("b")) <= 16 << 20
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def test_source_context_sends_a_title_once_for_each_part(spark, monkeypatch):
    """Entities that begin with the same source share its titles; very many of them are dealt over several parts."""
    monkeypatch.setattr(detail, "LINKS_OF_A_PART", 60)
    monkeypatch.setattr(detail, "LEAST_PARTS", 1)
    links = [("firm" if e % 3 else "person", e, s) for e in range(200) for s in ((0, 1, 2) if e < 120 else (e % 7, 20 + e % 5, 20 + e % 5))]
    titles = {s: f"title {s} " + "x" * s for s in range(24)} | {3: None}
    got = detail.source_context(
        spark.createDataFrame(links, "entity_type string, entity_id long, source_id long"), spark.createDataFrame(list(titles.items()), "id long, title string"))
    want = {}
    for kind, entity, _ in links:
        shown = [titles[s] for s in sorted(s for k, e, s in links if (k, e) == (kind, entity)) if titles.get(s)]
        if shown:
            want[kind, entity] = "Mentioned in: " + "; ".join(shown)
    assert {(r["entity_type"], r["entity_id"]): r["context"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # Entities are listed beside a title when it moves, and told apart behind the exchange by part.
    assert plan.index("Generate inline(_entities") < plan.index("RepartitionByExpression [_part") < plan.index("AS _entities")
