"""Golden cases of the name functions."""

from pyspark.sql import functions as F

from plinth.functions import similarity, text
from plinth.functions.pages import bump_cdn_width, join_url

NORMALIZED = {
    "Foster + Partners": "foster and partners", "Acme Corp": "acme", "Example Ltd.": "example", "Test GmbH": "test",
    "Foo Inc Ltd": "foo", "Herzog & de Meuron": "herzog and de meuron", "Büro Ole Scheeren": "buro ole scheeren",
    "São Paulo": "sao paulo", "  Zaha   Hadid   ": "zaha hadid", "O'Brien & Associates": "obrien and associates",
    "": "", "Jean-Paul": "jean-paul", "Co": "", "Straße": "strasse",
}


def _apply(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", expr.alias("o")).orderBy("i").collect()]


def test_normalize_name(spark):
    assert _apply(spark, NORMALIZED, text.normalize_name("v")) == list(NORMALIZED.values())


def test_slugs_have_no_bad_pattern(spark):
    slugs = _apply(spark, ["Büro Happold", "A -- B", "-x- Ltd", "Łódź  Lab"], text.slugify("v"))
    assert slugs == ["buro-happold", "a-b", "x", "lodz-lab"]


def test_aliases(spark):
    got = _apply(spark, ["Bjarke Ingels Group", "MVRDV", "SOM Design Studio", ""], text.name_aliases("v"))
    assert got == [["bjarke ingels group", "big", "bjarke ingels"], ["mvrdv"], ["som design studio", "sds", "som"], []]


def test_similarity_is_symmetric_and_bounded(spark):
    df = spark.createDataFrame([("word", "two words"), ("", "x"), ("Abc", "abc"), ("a b", "b a")], "a string, b string")
    rows = df.select(similarity.similarity("a", "b").alias("x"), similarity.similarity("b", "a").alias("y")).collect()
    assert [round(r["x"], 6) for r in rows] == [round(4 / 11, 6), 0.0, 1.0, 1.0]
    assert all(r["x"] == r["y"] for r in rows)


def test_trigram_codes_are_one_to_one(spark):
    df = spark.createDataFrame([("Straße 10 Łódź 東京 works",)], "a string")
    row = df.select(similarity.trigrams("a").alias("t"), similarity.trigram_codes("a").alias("c")).first()
    assert len(set(row["t"])) == len(set(row["c"])) == len(row["c"])


def test_urls(spark):
    refs = ["/x.jpg", "y.jpg", "//cdn.org/z.jpg", "https://o.org/a.png"]
    assert _apply(spark, refs, join_url(F.lit("https://h.org/a/b.html?q=1"), F.col("v"))) == [
        "https://h.org/x.jpg", "https://h.org/a/y.jpg", "https://cdn.org/z.jpg", "https://o.org/a.png"]
    assert _apply(spark, ["https://h.org/i.jpg?w=400&h=9#t", "https://h.org/i.jpg"], bump_cdn_width("v")) == [
        "https://h.org/i.jpg?w=1600&h=9#t", "https://h.org/i.jpg"]
