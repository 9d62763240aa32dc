"""The directory for SQL users: temp views and parameterised table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Each function is (signature, returned columns, body over the registered views).
FUNCTIONS = [
    ("entity_source_counts(kind STRING)", "entity_id BIGINT, source_count BIGINT",
     "SELECT entity_id, count(*) FROM entity_sources WHERE entity_type = kind GROUP BY entity_id"),
    ("firms_in(wanted_sector STRING, wanted_country STRING)", "id BIGINT, display_name STRING, sector STRING, country STRING",
     "SELECT id, display_name, sector, country FROM firms WHERE publish_status = 'published' AND merged_into IS NULL "
     "AND (wanted_sector IS NULL OR sector = wanted_sector) AND (wanted_country IS NULL OR country = wanted_country)"),
    ("count_firms_by(dimension STRING)", "value STRING, firms BIGINT",
     "SELECT CASE dimension WHEN 'sector' THEN sector ELSE country END AS value, count(*) FROM firms "
     "WHERE publish_status = 'published' AND merged_into IS NULL "
     "AND CASE dimension WHEN 'sector' THEN sector ELSE country END IS NOT NULL GROUP BY 1"),
]


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Publish the tables as temp views and the functions on top of them."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    for signature, columns, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS TABLE ({columns}) RETURN {body}")
