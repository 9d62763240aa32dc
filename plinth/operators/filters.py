"""Predicates and row filters. Each stays a pushed-down `where` over its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.text import as_col, contains_any, has, has_number, points

# Words that mark an institution as relevant (the blank in " art" counts).
RELEVANT_INSTITUTION_WORDS = [
    "architect", "design", " art", "arts", "engineer", "technology", "polytech", "fabricat",
    "comput", "urban", "built environment", "construction", "material", "sustainability",
    "media lab", "creative", "planning", "landscape", "robot", "smart", "digital",
    "technical university", "institute of technology", "technische", "técnic", "politecnic", "politécnic",
]

# Words that hide a firm when quality is computed.
QUALITY_IRRELEVANT_WORDS = [
    "hospital", "clinic", "medical", "pharma", "health", "neurology", "cardiology", "oncology",
    "surgery", "dentist", "veterinary", "nursing", "pathology", "radiology", "ministry of",
    "department of defense", "army", "navy", "air force", "police", "prison", "correctional",
]

# The wider list of the audit.
AUDIT_IRRELEVANT_WORDS = [
    "hospital", "clinic", "medical", "pharma", "health", "neurology", "cardiology", "oncology",
    "surgery", "dentist", "veterinary", "nursing", "midwi", "pathology", "radiology", "ministry",
    "department of", "army", "navy", "air force", "police", "prison", "correctional",
]


def active(df: DataFrame, kind: str) -> DataFrame:
    """Rows the public sees: published, and for firms not merged away."""
    shown = df.where(F.col("publish_status") == "published")
    return shown.where(F.col("merged_into").isNull()) if kind == "firm" else shown


def facet(df: DataFrame, sector: str | None = None, country: str | None = None) -> DataFrame:
    """Equality facets; an absent facet does not filter."""
    if sector is not None:
        df = df.where(F.col("sector") == sector)
    if country is not None:
        df = df.where(F.col("country") == country)
    return df


def country_or_code(text: str) -> Column:
    return (F.col("country") == text) | (F.col("country_code") == F.upper(F.lit(text)))


def letter_prefix(df: DataFrame, letter: str | None, column: str = "display_name") -> DataFrame:
    """Case-sensitive range [letter, next letter) for A-Z; anything else leaves the rows alone."""
    if letter is None or len(letter) != 1 or not "A" <= letter <= "Z":
        return df
    return df.where((F.col(column) >= letter) & (F.col(column) < chr(ord(letter) + 1)))


def role_contains(df: DataFrame, text: str, column: str = "role") -> DataFrame:
    """Case-insensitive substring; LIKE wildcards in the input stand for themselves."""
    return df.where(F.lower(F.col(column)).contains(text.lower()))


def relevant_institution(name: Column | str) -> Column:
    return contains_any(name, RELEVANT_INSTITUTION_WORDS)


def irrelevant_firm(name: Column | str, words: list[str]) -> Column:
    return contains_any(name, words)


def junk_name(name: Column | str) -> Column:
    """All digits, one letter, nothing but signs, or shorter than two characters."""
    value = as_col(name)
    return (
        value.rlike("^\\d+$") | value.rlike("^[A-Za-z]$") | value.rlike("^[^\\p{L}\\p{N}_]+$") | (F.length(value) < 2)
    )


def bad_slug(slug: Column | str) -> Column:
    return as_col(slug).rlike("--|[^a-z0-9-]|^-|-$")


def filled_firm_fields() -> Column:
    return points(
        (has("country"), 1), (has("city"), 1), (has("website"), 1), (has_number("founded_year"), 1),
        (has("short_description"), 1), (has("size_range"), 1),
    )


def filled_person_fields() -> Column:
    return points(
        (has("role"), 1), (has("title"), 1), (has("nationality"), 1), (has("bio"), 1),
        (has("current_firm_id"), 1),
    )


def thin_firm(at_least: int = 2) -> Column:
    return filled_firm_fields() < at_least


def thin_person(at_least: int = 2) -> Column:
    return filled_person_fields() < at_least


def noindex_firms(firms: DataFrame, firm_people: DataFrame) -> DataFrame:
    """Every firm with `noindex`: under 3 of 6 signs of content, or not published."""
    staffed = firm_people.select(F.col("firm_id").alias("id")).distinct().withColumn("staffed", F.lit(True))
    content = points(
        (has("short_description"), 1), (has("country"), 1), (has("city"), 1), (has("website"), 1),
        (has_number("founded_year"), 1), (F.coalesce("staffed", F.lit(False)), 1),
    )
    flag = (content < 3) | F.coalesce(F.col("publish_status") != "published", F.lit(True))
    return firms.join(staffed, "id", "left").withColumn("noindex", flag).drop("staffed")


def skip_unlabelled(df: DataFrame, label: str, legacy: bool = False) -> DataFrame:
    """Drop labels that are bare item ids. The legacy rule drops every label that starts with Q."""
    return df.where(~F.col(label).rlike("^Q" if legacy else "^Q\\d+$"))


def not_person(df: DataFrame, name: str = "person_name") -> DataFrame:
    """Drop blank names and names of cities."""
    return df.where(has(name) & ~F.col(name).startswith("City of"))


# Map regions as south, west, north, east.
REGIONS = [
    ("Europe", 35.0, -25.0, 72.0, 45.0),
    ("North America", 15.0, -170.0, 72.0, -50.0),
    ("Asia", -10.0, 60.0, 55.0, 150.0),
    ("Oceania", -50.0, 110.0, 0.0, 180.0),
    ("South America", -60.0, -90.0, 15.0, -30.0),
    ("Africa & Middle East", -40.0, -20.0, 40.0, 60.0),
]


def assign_regions(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """One row per (row, region that holds its point). Six fixed boxes, so no join is needed."""
    inside = [
        F.when(F.col(lat).between(south, north) & F.col(lon).between(west, east), F.lit(name))
        for name, south, west, north, east in REGIONS
    ]
    return df.withColumn("region", F.explode(F.array_compact(F.array(*inside))))


def valid_image_url(url: Column | str, min_width: int = 800) -> Column:
    """URL-only checks: no logos, icons, thumbnails or small sizes given in the file name."""
    path = F.lower(F.regexp_extract(as_col(url), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    name = F.regexp_extract(path, "([^/]*)$", 1)
    width = F.regexp_extract(name, "[-_](\\d{2,3})x\\d{2,3}", 1).try_cast("int")
    bad_name = name.rlike("^(logo[._-]|favicon|placeholder)|sprite\\.|icon-|-icon\\.|placeholder|_thumb|-thumb\\.")
    bad_path = path.rlike("/styles/|/thumbs/|sitesv|/favicon")
    return ~(bad_name | bad_path | F.coalesce(width < min_width, F.lit(False)))
