"""Properties of merges, ranks and nesting, including hot keys."""

from pyspark.sql import functions as F

from plinth.functions.fulltext import fts_rank, lexemes, query_lexemes
from plinth.operators import detail, merge, ranking
from plinth.operators.quality import classify_relevance


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_upsert_twice_is_once(spark):
    target = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id int, name string, city string")
    new = spark.createDataFrame([(2, "B", 2), (2, "BB", 1), (3, "c", 1), (None, "n", 1)], "id int, name string, pos int")
    for policy in ("overwrite", "keep_first", "coalesce"):
        once = merge.upsert(target, new, ["id"], policy=policy, order=[F.asc("pos")])
        twice = merge.upsert(once, new, ["id"], policy=policy, order=[F.asc("pos")])
        assert rows(once) == rows(twice) and once.count() == 4
    kept = {r["id"]: (r["name"], r["city"]) for r in merge.upsert(target, new, ["id"], order=[F.asc("pos")]).collect()}
    assert kept[2] == ("BB", "x") and kept[1] == ("a", None) and kept[None] == ("n", None)


def test_global_numbers_and_neighbours_equal_a_single_sort(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") * 37 % 11).alias("k")).repartition(7)
    order = [F.asc("k"), F.asc("id")]
    want = sorted((r["k"], r["id"]) for r in df.collect())
    numbered = ranking.number_rows(df, order).collect()
    assert [(r["k"], r["id"]) for r in sorted(numbered, key=lambda r: r["row_no"])] == want
    assert sorted(r["row_no"] for r in numbered) == list(range(1, 501))
    after = {(r["k"], r["id"]): r["next_id"] for r in ranking.with_next(df, order, ["id"]).collect()}
    assert all(after[a] == b[1] for a, b in zip(want, want[1:])) and after[want[-1]] is None


def test_top_n_limits_groups_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = ranking.top_n(df, ["k"], [F.desc("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_hot_groups_are_nested_in_parts_and_stay_whole(spark):
    links = spark.range(5000).select(F.when(F.col("id") < 4900, 1).otherwise(2).alias("key"), F.col("id").alias("item"))
    parts = detail.nest(links, "key", F.col("item"), "items", "item", part_size=500).collect()
    assert sum(len(r["items"]) for r in parts) == 5000
    assert max(len(r["items"]) for r in parts) < 800 and len([r for r in parts if r["key"] == 1]) == 10


def test_fill_missing_moves_coordinates_together(spark):
    target = spark.createDataFrame([(1, None, 5.0), (2, 1.0, None)], "id int, latitude double, longitude double")
    new = spark.createDataFrame([(1, 8.0, 9.0), (2, 8.0, 9.0)], "id int, latitude double, longitude double")
    got = merge.fill_missing(target, new, "id", ["latitude", "longitude"], together=[("latitude", "longitude")])
    assert rows(got) == [(1, 8.0, 9.0), (2, 1.0, None)]


def test_cover_density(spark):
    df = spark.createDataFrame([("red fox and red big fox", "red fox"), ("fox", "red fox"), ("studio studio", "studio")], "d string, q string")
    got = [round(r[0], 6) for r in df.select(fts_rank(lexemes("d"), query_lexemes("q"))).collect()]
    # Covers: red fox; fox .. red with one word between; red .. fox with one word between.
    assert got == [round(0.1 + 0.05 + 0.05, 6), 0.0, 0.2]


def test_stemmed_lexemes(spark):
    row = spark.createDataFrame([("Studies of the buildings",)], "d string").select(
        F.transform(lexemes("d", stem=True), lambda t: t["word"])).first()
    assert row[0] == ["study", "build"]


def test_relevance_rules(spark):
    people = spark.createDataFrame(
        [(i, f"p{i}", f"P{i}", "Researcher", "published", 1) for i in range(5)],
        "id int, slug string, display_name string, role string, publish_status string, quality_score int")
    sources = spark.createDataFrame(
        [(1, "Cancer battery", "x"), (2, "Timber robots", "x"), (3, "Plain", "Dezeen"), (4, "Plain", "x")], "id int, title string, source_name string")
    links = spark.createDataFrame([("person", 0, 1), ("person", 1, 1), ("person", 1, 2), ("person", 2, 3), ("person", 3, 4)],
                                  "entity_type string, entity_id int, source_id int")
    got = {r["id"]: (r["classification"], r["reason"]) for r in classify_relevance(people, links, sources).collect()}
    assert got == {
        0: ("irrelevant", "irrelevant: cancer, battery"), 1: ("relevant", "matched: timber, robot"), 2: ("relevant", "from Dezeen"),
        3: ("borderline", "no keyword matches"), 4: ("borderline", "no source titles linked")}
