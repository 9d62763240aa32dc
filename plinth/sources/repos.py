"""Repository search results to sources and owners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators.ranking import keep_first

REPO = "full_name string, html_url string, owner struct<login:string,type:string>"


def repo_owners(repos: DataFrame, order: str = "pos") -> DataFrame:
    """(login, entity_type): each owner once, in order of first sight."""
    kind = F.when(F.col("owner.type") == "User", F.lit("person")).when(
        F.col("owner.type") == "Organization", F.lit("firm"))
    rows = repos.select(F.col("owner.login").alias("login"), kind.alias("entity_type"), order)
    return keep_first(rows, ["login"], [F.asc(order)])


def repo_sources(repos: DataFrame, order: str = "pos", legacy: bool = False) -> DataFrame:
    """Every repository as a source; the legacy rule keeps only the first one of each owner."""
    rows = repos.select(
        "html_url", "full_name", F.col("owner.login").alias("author"), order)
    keys = ["author"] if legacy else ["html_url"]
    kept = keep_first(rows, keys, [F.asc(order)])
    return kept.select(
        F.col("full_name").alias("title"), F.lit("GitHub").alias("source_name"), F.col("html_url").alias("url"),
        "author", F.lit("repository").alias("source_type"), F.lit("technology").alias("sector"))


def user_contributors(contributors: DataFrame) -> DataFrame:
    return contributors.where(F.col("type") == "User")
