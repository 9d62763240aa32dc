"""Quality scores, publish status, sector choice and extraction confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plinth.functions.text import as_col, blank_to_null, count_words, cut, has, has_number, let, location_label, normalize_name, points
from plinth.operators.filters import QUALITY_IRRELEVANT_WORDS, irrelevant_firm

# Words that vote for a sector, sectors in tie-break order.
SECTOR_WORDS = {
    "architecture": ["architecture", "building", "urban", "construction", "housing", "landscape"],
    "design": ["design", "interaction", "graphic", "product", "material"],
    "technology": ["computation", "digital", "fabrication", "smart", "robot", "algorithm",
                   "machine learning", "artificial intelligence"],
}


def _long_or_short(column: str) -> list[tuple[Column, int]]:
    long = F.coalesce(F.length(column) >= 50, F.lit(False))
    return [(long, 15), (has(column) & ~long, 8)]


def score_firm(alias_count: str = "alias_count", people_count: str = "people_count") -> Column:
    return points(
        (has("country"), 20), (has("city"), 15), *_long_or_short("short_description"), (has("website"), 10),
        (has_number("founded_year"), 10), (has("size_range"), 10),
        (has_number(alias_count), 10), (has_number(people_count), 10),
    )


def score_person(alias_count: str = "alias_count") -> Column:
    return points(
        (has("current_firm_id"), 25), (has("role") | has("title"), 20), *_long_or_short("bio"),
        (has("nationality"), 15), (has_number(alias_count), 15),
        (has("sector") & F.coalesce(F.col("sector") != "architecture", F.lit(False)), 10),
    )


def firm_publish_status(name: Column | str, score: Column | str, at_least: int = 40) -> Column:
    hidden = irrelevant_firm(name, QUALITY_IRRELEVANT_WORDS)
    return F.when(hidden, F.lit("hidden")).when(as_col(score) >= at_least, F.lit("published")).otherwise(F.lit("draft"))


def person_publish_status(score: Column | str, at_least: int = 30) -> Column:
    return F.when(as_col(score) >= at_least, F.lit("published")).otherwise(F.lit("draft"))


def classify_sector(topics: Column | str) -> Column:
    """Sector with most words found in the joined topics, ties to the declared order, else technology."""
    def voted(text: Column) -> Column:
        votes = [
            F.struct((-count_words(text, words)).alias("hits"), F.lit(rank).alias("rank"), F.lit(sector).alias("sector"))
            for rank, (sector, words) in enumerate(SECTOR_WORDS.items())
        ]
        return F.sort_array(F.array(*votes))[0]

    best = let(F.array_join(as_col(topics), " "), voted)
    return let(best, lambda b: F.when(b["hits"] < 0, b["sector"]).otherwise(F.lit("technology")))


def confidence(kind: str, description: str = "description", website: str = "found_website",
               image: str = "found_image", tags: str = "found_tags") -> Column:
    """Share of 100 points earned by the extracted fields and by what the entity already has."""
    name = F.col("display_name")
    squashed = F.replace(normalize_name(name), F.lit(" "), F.lit(""))
    plain_site = F.regexp_replace(F.lower(F.col(website)), "[-.]", "")
    length = F.length(description)
    known = [("founded_year", "city")] if kind == "firm" else [("role", "nationality")]
    first, second = known[0]
    tag_points = F.least(F.size(F.coalesce(F.col(tags), F.array().cast("array<string>"))) * 3, F.lit(15))
    total = points(
        (F.coalesce(length >= 50, F.lit(False)), 20),
        (F.coalesce((length >= 30) & (length < 50), F.lit(False)), 10),
        (has(description) & F.coalesce(F.lower(F.col(description)).contains(F.lower(name)), F.lit(False)), 10),
        (has(website), 15), (has(website) & F.coalesce(plain_site.contains(squashed), F.lit(False)), 5),
        (has(image), 10), (has(image) & F.coalesce(F.col(image).rlike("wikimedia|wikipedia"), F.lit(False)), 5),
        (has("country") if kind == "firm" else F.lit(False), 5), (has("sector"), 5),
        ((has_number(first) if kind == "firm" else has(first)), 5), (has(second), 5),
    )
    return (total + tag_points).cast("double") / 100.0


def boosted(score: Column, has_education: Column) -> Column:
    """Person confidence with the bonus for education found, at most 1."""
    return F.when(has_education, F.least(score + 0.1, F.lit(1.0))).otherwise(score)


def firm_seo_description() -> Column:
    place = location_label("city", "country")
    based = F.when(F.length(place) > 0, F.concat(F.lit(" based in "), place)).otherwise(F.lit(""))
    plain = F.concat("display_name", F.lit(" is a "), "sector", F.lit(" firm"), based, F.lit("."))
    return F.coalesce(blank_to_null("short_description"), plain)


def person_seo_description() -> Column:
    plain = F.concat("display_name", F.lit(" — "), F.coalesce(blank_to_null("role"), F.col("sector")))
    return F.coalesce(blank_to_null(cut("bio", 160)), plain)
