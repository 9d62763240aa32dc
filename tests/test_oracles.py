"""Registered queries against their oracles at the smallest scale. PLINTH_ALL=1 checks every query."""

import os

import pytest

import __spark_entry__ as contract
from plinth.plans import catalog
from tests.check_oracles import compare, duck

SF_DIR = "/root/testdata/sf0.001"
QUICK = [
    "count_firms_by_country", "home_stats", "awards_pages_bulk", "sitemap_urls", "normalize_names", "name_aliases", "keyword_tags",
    "firm_detail", "entity_sources_of", "upsert_overwrite", "queue_transition", "resolve_people", "match_trigram_top5", "title_mentions",
    "adjacent_duplicates", "firm_quality", "classify_relevance", "audit_issues", "flatten_editions", "work_authors", "award_table_facts",
    "route_firm_people", "extract_education", "ingest_batch_links", "stream_new_items",
    "stream_first_seen", "feed_job_tables", "resolve_batch", "merge_touched_parts", "merge_buckets_twice", "entities_for_tag",
]
NAMES = sorted(catalog()) if os.environ.get("PLINTH_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_oracle(spark, con, name):
    entry = catalog()[name]
    result = entry.run(spark, SF_DIR).toArrow()
    if entry.sql:
        assert compare(result, con.execute(entry.sql).to_arrow_table()) is None


def test_contract():
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 150
    assert contract.FLAGSHIP in queries
