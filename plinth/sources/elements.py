"""Map elements and knowledge-graph bindings to typed candidate rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.geo import item_id, map_country_code, point_latitude, point_longitude
from plinth.functions.text import as_col, blank_to_null

ELEMENT = (
    "id long, type string, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>"
)
BINDING = "map<string,struct<value:string>>"


def flatten_map_elements(elements: DataFrame) -> DataFrame:
    """Candidates with a name of three characters or more; a coordinate of 0 is a coordinate."""
    tag = lambda name: F.try_element_at("tags", F.lit(name))
    rows = elements.select(
        "id", tag("name").alias("name"),
        F.coalesce("lat", "center.lat").alias("latitude"), F.coalesce("lon", "center.lon").alias("longitude"),
        tag("addr:city").alias("city"), map_country_code(tag("addr:country")).alias("country_code"),
        F.coalesce(blank_to_null(tag("website")), blank_to_null(tag("contact:website"))).alias("website"))
    return rows.where(F.length("name") >= 3)


def bound(binding: Column | str, name: str) -> Column:
    return F.try_element_at(as_col(binding), F.lit(name))["value"]


def bound_year(binding: Column | str, name: str) -> Column:
    return F.substring(bound(binding, name), 1, 4).try_cast("int")


def read_bindings(df: DataFrame, column: str = "binding") -> DataFrame:
    """Typed columns of result bindings; absent variables are NULL."""
    number = lambda name: bound(column, name).try_cast("double").cast("int")
    return df.select(
        item_id(bound(column, "item")).alias("wikidata_id"), bound(column, "itemLabel").alias("label"),
        number("sitelinks").alias("sitelinks"), bound_year(column, "inception").alias("founded_year"),
        bound(column, "website").alias("website"), bound(column, "countryLabel").alias("country"),
        bound(column, "nationalityLabel").alias("nationality"),
        number("birthYear").alias("birth_year"), number("deathYear").alias("death_year"),
        point_longitude(bound(column, "coord")).alias("longitude"),
        point_latitude(bound(column, "coord")).alias("latitude"))
