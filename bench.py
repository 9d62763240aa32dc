"""Time the headline queries: one warm-up, then the median of BENCH_RUNS runs. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from plinth.plans import catalog
from plinth.session import local_session

HEADLINE = [
    "count_firms_by_country", "entity_source_counts", "tag_counts", "home_stats", "gap_counts", "awards_pages_bulk",
    "sitemap_urls", "normalize_texts", "page_texts", "keyword_tags", "summary_sentences", "firm_detail",
    "award_detail", "entity_sources_of", "entity_tags_of", "multi_entity_sources", "firm_json_ld",
    "upsert_overwrite", "link_edges", "resolve_people", "resolve_batch", "match_trigram_top5", "similar_page_titles",
    "title_mentions", "adjacent_duplicates", "firm_quality", "classify_relevance", "audit_issues", "search_directory",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session("plinth-bench", cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    entries = catalog()
    seconds: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.time()
            entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.time() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name} {taken[0]:.2f} {seconds[name]:.2f}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
