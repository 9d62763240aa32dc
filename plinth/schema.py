"""Table schemas, enum orders and the table loader for a directory of Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Enum members in declaration order, which is also their sort order.
SECTORS = ["architecture", "design", "technology", "multidisciplinary"]
ENTITY_TYPES = ["firm", "person"]
SOURCE_TYPES = ["rss", "api", "scrape", "manual", "repository"]
PUBLISH_STATUSES = ["published", "draft", "hidden"]
QUEUE_STATUSES = ["pending", "processing", "done", "failed"]
REVIEW_STATUSES = ["pending", "accepted", "rejected", "skipped"]
CURSOR_STATUSES = ["ok", "partial", "error"]
RELATIONSHIPS = ["partner", "collaboration", "acquired_by", "subsidiary", "spin_off"]


# Columns of each table.
TABLES: dict[str, str] = {
    "firms": (
        "id string, slug string, display_name string, canonical_name string, sector string, country string, "
        "country_code string, city string, website string, founded_year int, size_range string, "
        "short_description string, merged_into string, publish_status string, quality_score int, "
        "source_count int, last_seen_at timestamp, wikidata_id string, openalex_id string, latitude double, "
        "longitude double, logo_url string, image_url string, image_credit string, created_at timestamp, "
        "updated_at timestamp"),
    "people": (
        "id string, slug string, display_name string, canonical_name string, role string, title string, "
        "sector string, current_firm_id string, nationality string, bio string, publish_status string, "
        "quality_score int, source_count int, last_seen_at timestamp, wikidata_id string, openalex_id string, "
        "orcid string, birth_year int, death_year int, image_url string, image_credit string, "
        "created_at timestamp, updated_at timestamp"),
    "sources": (
        "id string, title string, source_name string, url string, published_at timestamp, author string, "
        "source_type string, sector string, created_at timestamp"),
    "awards": (
        "id string, slug string, award_name string, organization string, category string, year int, "
        "prestige string"),
    "firm_people": (
        "firm_id string, person_id string, role string, is_current boolean, start_year int, end_year int, "
        "source string"),
    "award_recipients": (
        "award_id string, firm_id string, person_id string, project_name string, year int"),
    "entity_aliases": (
        "entity_id string, entity_type string, alias string, alias_normalized string"),
    "ingest_cursors": (
        "source_name string, last_cursor string, last_run_at timestamp, entity_count bigint, status string, "
        "errors array<string>"),
    "enrichment_queue": (
        "id string, entity_id string, entity_type string, status string, attempts int, last_error string, "
        "created_at timestamp, enriched_at timestamp"),
    "review_queue": (
        "id string, candidate_name string, entity_type string, suggested_entity_id string, confidence double, "
        "match_type string, status string, created_at timestamp, resolved_at timestamp"),
    "entity_sources": (
        "entity_id string, entity_type string, source_id string, mention_type string, confidence double, "
        "created_at timestamp"),
    "tags": (
        "id string, name string, slug string, category string"),
    "entity_tags": (
        "entity_id string, entity_type string, tag_id string, source string"),
    "projects": (
        "id string, slug string, display_name string, description string, year int, location string, "
        "project_type string, sector string, wikidata_id string, country string, city string, latitude double, "
        "longitude double, created_at timestamp, updated_at timestamp"),
    "project_entities": (
        "project_id string, entity_id string, entity_type string, role string"),
    "entity_relationships": (
        "from_entity_id string, from_entity_type string, to_entity_id string, to_entity_type string, "
        "relationship string, start_year int, end_year int, notes string"),
    "education": (
        "person_id string, institution_id string, institution_name string, degree string, field string, "
        "start_year int, end_year int, source string"),
    "pipeline_runs": (
        "id string, started_at timestamp, finished_at timestamp, sources_run array<string>, "
        "total_entities bigint, failures bigint, "
        "summary array<struct<name: string, entities: bigint, duration_s: double, error: string>>"),
}


def read_tables(spark: SparkSession, base: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Every directory table under `base`, with its declared schema and nothing read yet."""
    return {
        name: spark.read.schema(TABLES[name]).parquet(f"{base}/{name}")
        for name in (names or list(TABLES))
    }


def entity_id(entity_type: Column | str, slug: Column | str) -> Column:
    """Deterministic id, so a rerun of a job mints the same ids."""
    kind = F.lit(entity_type) if isinstance(entity_type, str) else entity_type
    key = F.col(slug) if isinstance(slug, str) else slug
    return F.sha2(F.concat_ws("|", kind, key), 256)


def enum_rank(column: Column | str, members: list[str]) -> Column:
    """Declaration-order rank of an enum value, after the last member for anything else."""
    value = F.col(column) if isinstance(column, str) else column
    position = F.array_position(F.array(*[F.lit(m) for m in members]), value)
    return F.when(position > 0, position).otherwise(F.lit(len(members) + 1)).cast("int")


def enum_table(spark: SparkSession, column: str, members: list[str]) -> DataFrame:
    """The members of an enum as rows, used to zero-fill counts."""
    return spark.createDataFrame([(m, i + 1) for i, m in enumerate(members)], f"{column} string, position int")


def validate_enum(df: DataFrame, column: str, members: list[str]) -> tuple[DataFrame, DataFrame]:
    """Split into rows whose value is a member (NULL allowed) and rejected rows."""
    known = F.col(column).isNull() | F.col(column).isin(members)
    return df.where(known), df.where(~known)
