"""Exhibition editions: nested JSON to one row per named person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.text import has

_PERSON = "struct<name:string,nationality:string,firm:string,role:string>"
EDITION = (
    f"struct<year:int,title:string,director:array<{_PERSON}>,golden_lion_lifetime:array<{_PERSON}>,"
    f"golden_lion_best_participant:array<{_PERSON}>,"
    "golden_lion_best_pavilion:struct<architect:string,nationality:string,firm:string>,"
    f"notable_participants:array<{_PERSON}>>"
)

# List field, award given, role recorded.
LISTS = [
    ("director", "Venice Biennale Director", "Curator/Director"),
    ("golden_lion_lifetime", "Golden Lion Lifetime Achievement", "Architect"),
    ("golden_lion_best_participant", "Golden Lion Best Participant", "Architect"),
    ("notable_participants", None, None),
]
PAVILION_AWARD = "Golden Lion Best National Pavilion"
ORGANIZATION = "Venice Biennale"


def parse_editions(df: DataFrame, column: str = "value") -> DataFrame:
    """JSON text that is `{editions: [...]}` or a list; a single director object becomes a list."""
    text = F.col(column)
    listed = F.from_json(text, f"array<{EDITION}>")
    wrapped = F.from_json(text, f"struct<editions:array<{EDITION}>>")["editions"]
    single = F.from_json(text, f"array<struct<year:int,director:{_PERSON}>>")
    single_wrapped = F.from_json(text, f"struct<editions:array<struct<year:int,director:{_PERSON}>>>")["editions"]
    is_list = F.ltrim(text).startswith("[")
    editions = F.when(is_list, listed).otherwise(wrapped)
    loners = F.when(is_list, single).otherwise(single_wrapped)
    rows = df.select(F.posexplode(editions).alias("at", "edition"), loners.alias("loners"))
    lone = F.get(F.col("loners"), F.col("at"))["director"]
    director = F.coalesce(F.col("edition.director"), F.when(lone.isNotNull(), F.array(lone)))
    return rows.select(F.col("edition").withField("director", director).alias("edition"))


def flatten_editions(df: DataFrame, edition: str = "edition") -> DataFrame:
    """(year, award_name, name, nationality, firm, role): one pass over each edition's lists."""
    e = F.col(edition)

    def entry(person: Column, award: str | None, role: str | None) -> Column:
        return F.struct(
            F.lit(award).cast("string").alias("award_name"), person["name"].alias("name"),
            person["nationality"].alias("nationality"), person["firm"].alias("firm"),
            (F.lit(role) if role else F.coalesce(person["role"], F.lit("Participant"))).alias("role"))

    def listed(field: str, award: str | None, role: str | None) -> Column:
        none = F.array().cast(f"array<{_PERSON}>")
        return F.transform(F.coalesce(e[field], none), lambda person: entry(person, award, role))

    lists = [listed(*spec) for spec in LISTS]
    p = e["golden_lion_best_pavilion"]
    pavilion = F.struct(
        F.lit(PAVILION_AWARD).alias("award_name"), p["architect"].alias("name"), p["nationality"].alias("nationality"),
        p["firm"].alias("firm"), F.lit("Architect").alias("role"))
    everyone = F.concat(*lists, F.array(pavilion))
    rows = df.select(e["year"].alias("year"), F.explode(everyone).alias("p"))
    return rows.select("year", "p.*").where(has("name"))
