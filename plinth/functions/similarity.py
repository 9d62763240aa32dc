"""Trigram sets and their Jaccard similarity as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plinth.functions.text import as_col

WORD = "[\\p{L}\\p{N}]+"


def words(value: Column | str) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(as_col(value)), F.lit(WORD), F.lit(0))


def trigrams(value: Column | str) -> Column:
    """Distinct 3-grams of each word padded with two blanks before and one after."""
    padded = F.array_join(F.transform(words(value), lambda w: F.concat(F.lit("  "), w, F.lit(" "))), "\n")
    return F.array_distinct(F.regexp_extract_all(padded, F.lit("(?=([^\\n]{3}))"), F.lit(1)))


def trigram_codes(value: Column | str) -> Column:
    """The trigrams as numbers, one per gram: three code points of 21 bits. Smaller and faster to compare."""
    def code(gram: Column) -> Column:
        first, second, third = (F.ascii(F.substring(gram, i, 1)).cast("long") for i in (1, 2, 3))
        return F.shiftleft(first, 42) + F.shiftleft(second, 21) + third

    return F.transform(trigrams(value), code)


def jaccard(left: Column | str, right: Column | str) -> Column:
    """Jaccard of two arrays that hold no duplicates; 0 when both are empty."""
    a, b = as_col(left), as_col(right)
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.coalesce(F.try_divide(shared.cast("double"), union.cast("double")), F.lit(0.0))


def similarity(left: Column | str, right: Column | str) -> Column:
    return jaccard(trigrams(left), trigrams(right))


def grams(value: Column | str, n: int) -> Column:
    """Distinct character n-grams of the whole text, empty when it is shorter than n."""
    return F.array_distinct(F.regexp_extract_all(as_col(value), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))
