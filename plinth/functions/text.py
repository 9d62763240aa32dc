"""Name and text expressions. All but `matching_words` are plain Column expressions with no Python per row."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.session import bounded_batches

# Legal forms removed from the end of a name.
LEGAL_FORMS = [
    "pty ltd", "pvt ltd", "gmbh", "sarl", "corp", "llc", "llp", "inc", "ltd",
    "ag", "kg", "sa", "bv", "nv", "lp", "co", "company",
]

# Words left out of the short form of a name.
GENERIC_NAME_WORDS = [
    "architects", "architecture", "studio", "studios", "design", "designs", "lab", "labs",
    "laboratory", "group", "associates", "partners", "office", "atelier", "workshop",
    "collective", "practice", "research", "institute", "center", "centre",
]

# Letters that Unicode does not decompose into a base letter and a mark.
_WHOLE_LETTERS = {
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "þ": "th", "ð": "d", "đ": "d",
    "ħ": "h", "ı": "i", "ŋ": "ng", "ŧ": "t", "ĳ": "ij", "ŀ": "l", "ſ": "s",
}


def latin_fold_table() -> tuple[str, str]:
    """Accented Latin letters (U+00C0 to U+024F) and the ASCII letter each decomposes to."""
    source, target = [], []
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii() and base.isalpha():
            source.append(chr(code))
            target.append(base)
    for letter, plain in _WHOLE_LETTERS.items():
        if len(plain) == 1:
            source.append(letter)
            target.append(plain)
    return "".join(source), "".join(target)


LEGAL_FORM_PATTERN = "(^|[^\\p{L}\\p{N}_])(" + "|".join(LEGAL_FORMS) + ")\\s*$"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def has(value: Column | str) -> Column:
    """Filled: not NULL and not the empty string."""
    text = as_col(value).cast("string")
    return F.coalesce(F.length(text) > 0, F.lit(False))


def has_number(value: Column | str) -> Column:
    """Filled number: not NULL and not zero."""
    return F.coalesce(as_col(value) != 0, F.lit(False))


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def points(*parts: tuple[Column, int]) -> Column:
    """Sum of the weights whose condition holds."""
    total = F.lit(0)
    for condition, weight in parts:
        total = total + F.when(condition, F.lit(weight)).otherwise(F.lit(0))
    return total


def fold_latin(value: Column | str) -> Column:
    """ASCII form of Latin letters; other scripts pass through."""
    source, target = latin_fold_table()
    out = F.translate(as_col(value), source, target)
    for letter, plain in _WHOLE_LETTERS.items():
        if len(plain) > 1:
            out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


def collapse_spaces(value: Column | str) -> Column:
    return F.trim(F.regexp_replace(as_col(value), "(?U)\\s+", " "))


def normalize_name(value: Column | str) -> Column:
    """Matching form of a name: lower case, no punctuation, no legal form, ASCII, single spaces."""
    out = F.lower(F.trim(as_col(value)))
    out = F.regexp_replace(out, "[&+]", " and ")
    out = F.regexp_replace(out, "(?U)[^\\p{L}\\p{N}_\\s-]", "")
    for _ in range(3):
        out = F.trim(F.regexp_replace(out, "(?U)" + LEGAL_FORM_PATTERN, "$1"))
    return collapse_spaces(fold_latin(out))


def slug_of(normalized: Column | str) -> Column:
    """Slug from an already normalised name."""
    hyphened = F.regexp_replace(as_col(normalized), "\\s+", "-")
    return F.btrim(F.regexp_replace(hyphened, "-{2,}", "-"), F.lit("-"))


def slugify(value: Column | str) -> Column:
    return slug_of(normalize_name(value))


def name_aliases(value: Column | str) -> Column:
    """Distinct aliases in order: full form, acronym, form without generic words. Never empty strings."""
    full = normalize_name(value)
    words = F.filter(F.split(full, " "), lambda w: F.length(w) > 0)
    acronym = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    short_words = F.filter(words, lambda w: ~w.isin(GENERIC_NAME_WORDS))
    short = F.array_join(short_words, " ")
    acronym = F.when((F.size(words) >= 2) & (F.length(acronym) >= 2), acronym)
    short = F.when(F.size(short_words) > 0, short)
    forms = F.array_compact(F.array(full, acronym, short))
    return F.array_distinct(F.filter(forms, lambda a: F.length(a) > 0))


def role_slug(value: Column | str) -> Column:
    lowered = F.regexp_replace(F.lower(as_col(value)), "[^a-z0-9]+", "-")
    return F.regexp_replace(lowered, "-+$", "")


def year_of(value: Column | str) -> Column:
    """First four-digit year 1900-2099 standing as a word."""
    found = F.regexp_extract(as_col(value), "\\b(19\\d{2}|20\\d{2})\\b", 1)
    # NULL before the cast: a cast that fails makes an exception, which costs ten times the search.
    return F.nullif(found, F.lit("")).try_cast("int")


def clean_recipient(value: Column | str) -> Column:
    """Name without bracketed notes and without surrounding spaces, commas and semicolons."""
    out = F.regexp_replace(as_col(value), "\\[.*?\\]", "")
    out = F.regexp_replace(out, "\\(.*?\\)", "")
    return F.btrim(out, F.lit(" ,;"))


def contains_any(value: Column | str, words: list[str]) -> Column:
    """Whether the lower-cased text holds any of the words: one alternation, one pass."""
    pattern = "|".join(_quote(w) for w in words)
    return F.coalesce(F.lower(as_col(value)).rlike(pattern), F.lit(False))


def matching_words(value: Column | str, words: list[str]) -> Column:
    """The words found in the lower-cased text, in list order; none in a NULL text.

    Python's search skips ahead in the text; Spark's `contains` tries each byte, which is dear for long
    texts and many words.
    """
    bounded_batches(SparkSession.active())

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([[w for w in words if w in t] if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))

    return found(F.lower(as_col(value)))


def count_words(value: Column | str, words: list[str]) -> Column:
    """How many of the words occur in the lower-cased text."""
    text = F.lower(as_col(value))
    total = F.lit(0)
    for word in words:
        total = total + text.contains(word).cast("int")
    return total


def _quote(word: str) -> str:
    return "".join("\\" + c if c in ".^$*+?()[]{}|\\" else c for c in word)


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(as_col(value), F.lit(""))


def location_label(city: Column | str, country: Column | str) -> Column:
    return F.concat_ws(", ", blank_to_null(city), blank_to_null(country))


def sector_path(sector: Column | str) -> Column:
    value = as_col(sector)
    return F.when(value == "multidisciplinary", F.lit("technology")).otherwise(value)


def site_domain(url: Column | str) -> Column:
    """Host of a URL, or the text itself when it has no host, without `www.`."""
    value = as_col(url)
    host = F.nullif(F.regexp_extract(value, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    return F.replace(F.coalesce(host, value), F.lit("www."), F.lit(""))


def ensure_scheme(url: Column | str) -> Column:
    value = as_col(url)
    return F.when(value.rlike("^https?://"), value).otherwise(F.concat(F.lit("https://"), value))


def name_in_url(name: Column | str, url: Column | str) -> Column:
    squashed = F.replace(F.lower(as_col(name)), F.lit(" "), F.lit(""))
    return F.replace(F.lower(as_col(url)), F.lit(" "), F.lit("")).contains(squashed)


def commons_path(filename: Column | str) -> Column:
    """Media path sharded by the first digits of the md5 of the underscored file name."""
    name = F.replace(as_col(filename), F.lit(" "), F.lit("_"))
    digest = F.md5(name)
    return F.concat_ws("/", F.substring(digest, 1, 1), F.substring(digest, 1, 2), name)


def cut(value: Column | str, limit: int) -> Column:
    return F.substring(as_col(value), 1, limit)
