"""Full-text match and cover-density rank over token and position arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plinth.functions.similarity import words

# English stop words.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the and but if or because as until while of "
    "at by for with about against between into through during before after above below to from up down in out on "
    "off over under again further then once here there when where why how all any both each few more most other "
    "some such no nor not only own same so than too very s t can will just don should now"
).split()


def light_stem(word: Column) -> Column:
    """Plural and participle endings of words long enough to keep a stem."""
    plural = F.when(word.rlike("^.{2,}ies$"), F.regexp_replace(word, "ies$", "y")).when(
        word.rlike("^.{3,}[^su]s$"), F.regexp_replace(word, "s$", "")).otherwise(word)
    return F.when(plural.rlike("^.{3,}(ing|ed)$"), F.regexp_replace(plural, "(ing|ed)$", "")).otherwise(plural)


def lexemes(text: Column | str, stem: bool = False) -> Column:
    """(word, pos) of every non-stop word; positions count all words."""
    placed = F.transform(words(text), lambda w, i: F.struct(w.alias("word"), (i + 1).alias("pos")))
    kept = F.filter(placed, lambda t: ~t["word"].isin(STOP_WORDS))
    if not stem:
        return kept
    return F.transform(kept, lambda t: F.struct(light_stem(t["word"]).alias("word"), t["pos"].alias("pos")))


def query_lexemes(text: Column | str, stem: bool = False) -> Column:
    return F.array_distinct(F.transform(lexemes(text, stem), lambda t: t["word"]))


def fts_rank(document: Column, query: Column, weight: float = 0.1) -> Column:
    """Sum of weight / (1 + noise words) over the minimal covers of the query in the document.

    A minimal cover is the shortest stretch that ends at some query word and holds all of them.
    """
    hits = F.filter(document, lambda t: F.array_contains(query, t["word"]))
    positions = F.transform(hits, lambda t: t["pos"])
    per_word = F.transform(query, lambda q: F.transform(
        F.filter(hits, lambda t: t["word"] == q), lambda t: t["pos"]))

    def cover_start(end: Column) -> Column:
        last = F.transform(per_word, lambda places: F.array_max(F.filter(places, lambda p: p <= end)))
        return F.when(~F.exists(last, lambda p: p.isNull()), F.array_min(last))

    covers = F.filter(
        F.transform(positions, lambda end: F.struct(cover_start(end).alias("start"), end.alias("end"))),
        lambda c: c["start"].isNotNull())
    minimal = F.filter(covers, lambda c, i: (i == 0) | (c["start"] > F.get(covers, i - 1)["start"]))

    def density(cover: Column) -> Column:
        inside = F.size(F.filter(positions, lambda p: p.between(cover["start"], cover["end"])))
        noise = cover["end"] - cover["start"] - (inside - 1)
        return F.lit(weight) / (noise + 1)

    return F.aggregate(F.transform(minimal, density), F.lit(0.0), lambda total, d: total + d)


def fts_match(document: Column, query: Column) -> Column:
    """Whether the document holds every query word; an empty query matches nothing."""
    present = F.transform(document, lambda t: t["word"])
    return (F.size(query) > 0) & (F.size(F.array_except(query, present)) == 0)
