"""Job isolation and enum validation."""

import pytest
from pyspark.sql import functions as F

from plinth.operators import audit, counts, jobs
from plinth.schema import validate_enum


def test_one_failing_job_does_not_stop_the_rest(spark):
    def broken(_):
        raise ValueError("no feed")

    registry = {"good": lambda s: s.range(4).count(), "bad": broken}
    got = jobs.run_jobs(spark, registry)
    assert [(r["name"], r["entity_count"], r["error"]) for r in got.collect()] == [("good", 4, None), ("bad", 0, "ValueError: no feed")]
    totals = counts.run_totals(got).first()
    assert (totals["total_entities"], totals["failures"], totals["outcome"]) == (4, 1, "FAILED")
    with pytest.raises(KeyError, match="nope"):
        jobs.run_jobs(spark, registry, ["nope"])


def test_validate_enum_splits_rows(spark):
    df = spark.createDataFrame([("a",), ("x",), (None,)], "v string")
    good, bad = validate_enum(df, "v", ["a", "b"])
    assert good.count() == 2 and [r["v"] for r in bad.collect()] == ["x"]


def test_feed_changes_gather_no_growing_table(spark):
    from plinth.streaming import feeds

    rows = lambda schema, *r: spark.createDataFrame(list(r), schema)
    changes = feeds.ingest_changes(
        rows("entry_id string, url string, title string, source_name string", ("e1", "u1", "by works 1", "s")),
        rows("id string, url string, title string, author string", ("s1", "u1", "old", "a")),
        rows("id long, canonical_name string, merged_into long", (1, "works 1", None)),
        rows("entity_id long, entity_type string, source_id string, mention_type string", (1, "firm", "old", "subject")),
        rows("entity_id long, entity_type string, status string", (1, "firm", "done")))
    for table in ("sources", "links", "queue"):
        assert "Broadcast" not in changes[table]._jdf.queryExecution().executedPlan().toString()
    assert [r["source_id"] for r in changes["links"].collect()] == ["s1"]
    assert [r["status"] for r in changes["queue"].collect()] == ["pending"]
