"""Award data: programme entry files and tables on web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions.pages import award_table_rows
from plinth.functions.text import clean_recipient, contains_any, let, year_of
from plinth.operators.filters import not_person

ENTRY_SCHEMA = "year int, person_name string, firm_name string, nationality string"

# Programmes read from entry files as (key, award, organization, prestige).
ENTRY_PROGRAMMES = [
    ("pritzker", "Pritzker Architecture Prize", "The Hyatt Foundation", "1"),
    ("riba", "RIBA Royal Gold Medal", "Royal Institute of British Architects", "1"),
    ("aia", "AIA Gold Medal", "American Institute of Architects", "1"),
]

# Programmes read from page tables as (page, award, organization, prestige).
TABLE_PROGRAMMES = [
    ("Stirling_Prize", "RIBA Stirling Prize", "Royal Institute of British Architects", "1"),
    ("Aga_Khan_Award_for_Architecture", "Aga Khan Award for Architecture", "Aga Khan Development Network", "1"),
    ("European_Union_Prize_for_Contemporary_Architecture", "European Union Prize for Contemporary Architecture",
     "European Commission / Mies van der Rohe Foundation", "1"),
    ("Driehaus_Architecture_Prize", "Driehaus Architecture Prize", "University of Notre Dame", "1"),
    ("Praemium_Imperiale", "Praemium Imperiale", "Japan Art Association", "1"),
    ("Wolf_Prize_in_Arts", "Wolf Prize in Arts", "Wolf Foundation", "1"),
]

# Words of header cells, and words that make a recipient a firm.
HEADER_WORDS = ["year", "winner", "architect", "laureate", "recipient", "name"]
FIRM_WORDS = [
    "architects", "studio", "associates", "partners", "group", "office", "practice", "atelier", "workshop",
]


def programmes(spark: SparkSession, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "programme string, award_name string, organization string, prestige string")


def read_award_entries(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """JSON arrays of entries, one path per programme key, tagged with the programme's constants."""
    parts = [
        spark.read.schema(ENTRY_SCHEMA).json(path, multiLine=True).withColumn("programme", F.lit(key))
        for key, path in paths.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return award_entries(out)


def award_entries(entries: DataFrame) -> DataFrame:
    """Entries of known programmes that name a person."""
    table = programmes(entries.sparkSession, ENTRY_PROGRAMMES)
    return not_person(entries).join(F.broadcast(table), "programme")


def entity_kind(name: Column | str) -> Column:
    return F.when(contains_any(name, FIRM_WORDS), F.lit("firm")).otherwise(F.lit("person"))


def table_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, row_no, cells): trimmed cell texts of every row of every award table."""
    rows = F.posexplode(award_table_rows(html)).alias("row_no", "cells")
    return pages.select(key, rows)


def award_row(cells: Column | str, legacy: bool = False) -> Column:
    """Struct (year, name) of a table row, NULL when the row does not give both.

    A header row is one whose name cell is a header word. The legacy rule drops every name that
    holds one, which loses firms with "architect" in their name.
    """
    row = F.col(cells) if isinstance(cells, str) else cells
    years = F.filter(F.transform(row, year_of), lambda y: y.isNotNull())
    names = F.filter(F.transform(row, lambda c: F.when(
        (F.length(c) > 2) & ~c.rlike("^\\d+$"), clean_recipient(c))),
        lambda n: (F.length(n) > 2) & ~n.rlike("^\\d+$"))
    def judged(fact: Column) -> Column:
        year, name = fact["year"], fact["name"]
        if legacy:
            header = contains_any(name, HEADER_WORDS)
        else:
            header = F.lower(F.trim(name)).rlike("^(" + "|".join(HEADER_WORDS) + ")s?(\\(s\\))?$")
        return F.when((F.size(row) >= 2) & year.isNotNull() & name.isNotNull() & ~header, fact)

    return let(F.struct(F.get(years, F.lit(0)).alias("year"), F.get(names, F.lit(0)).alias("name")), judged)


def award_table_facts(pages: DataFrame, key: str = "programme", html: str = "html", legacy: bool = False) -> DataFrame:
    """(key, row_no, year, name, entity_type) for each award row of the pages."""
    # Exploded, so that no row is judged once to keep it and once to show it.
    fact = F.explode(F.array_compact(F.array(award_row("cells", legacy)))).alias("fact")
    found = table_rows(pages, key, html).select(key, "row_no", fact)
    return found.select(key, "row_no", "fact.year", "fact.name", entity_kind(F.col("fact.name")).alias("entity_type"))
