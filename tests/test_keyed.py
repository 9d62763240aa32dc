"""Tables that take merges in place: which files they touch, what they shuffle, and batches over several tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plinth.operators import merge
from plinth.sources.keyed import BucketedTable, KeyedTable
from plinth.sources.segments import Segments
from plinth.streaming.ledger import Ledger


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_merge_writes_touched_parts_only(spark, tmp_path):
    base = spark.range(400).select("id", F.concat(F.lit("n"), "id").alias("name")).unionByName(spark.createDataFrame([(None, "none")], "id long, name string"))
    table = KeyedTable(spark, str(tmp_path / "k"), ["id"], 16).create(base)
    files = lambda: {(r.p, r.f) for r in table.stored().select(F.col("_part").alias("p"), F.col("_metadata.file_name").alias("f")).distinct().collect()}
    before = files()
    change = spark.createDataFrame([(3, "three"), (None, "null"), (1000, "new")], "id long, name string")
    touched = table.merge(change)
    assert 0 < len(touched) <= 3
    assert {x for x in before if x[0] not in touched} == {x for x in files() if x[0] not in touched}
    assert not {x for x in before if x[0] in touched} & files()
    want = rows(merge.upsert(base, change, ["id"]))
    assert rows(table.read()) == want
    table.merge(change)
    assert rows(table.read()) == want
    assert table.merge(change.limit(0)) == [] and rows(table.read()) == want


def test_second_merge_does_not_shuffle_the_table(spark, tmp_path):
    name = "bucketed_test"
    spark.sql(f"drop table if exists {name}")
    conf = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "-1")
    try:
        base = spark.range(300).select("id", F.lit("a").alias("name"))
        one = BucketedTable(spark, name, ["id"], 8).create(base, str(tmp_path))
        two = one.merge(spark.range(250, 350).select("id", F.lit("b").alias("name")), str(tmp_path))
        last = two.merged(spark.range(340, 360).select("id", F.lit("c").alias("name")))
        last.count()
        plan = last._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("Exchange hashpartitioning") == 1
        assert "Bucketed: true" in plan
        assert {n: c for n, c in last.groupBy("name").count().collect()} == {"a": 250, "b": 90, "c": 20}
        one.drop(), two.drop()
    finally:
        spark.conf.set(conf, before)


def test_a_batch_is_in_all_tables_or_in_none(spark, tmp_path):
    ledger = Ledger(Segments(spark, str(tmp_path / "l")), {"a": ["k"], "b": ["k"]})
    row = lambda k, v: spark.createDataFrame([(k, v)], "k long, v string")
    assert ledger.commit(-1, {"a": row(1, "x"), "b": row(1, "x")})

    def breaks(table):
        if table == "a":
            raise RuntimeError

    with pytest.raises(RuntimeError):
        ledger.commit(0, {"a": row(1, "y"), "b": row(1, "y")}, breaks)
    assert rows(ledger.state("a")) == [(1, "x")] and ledger.done() == {-1}
    assert ledger.commit(0, {"a": row(1, "y"), "b": row(2, "y")})
    assert not ledger.commit(0, {"a": row(1, "z"), "b": row(2, "z")})
    assert rows(ledger.state("a")) == [(1, "y")] and rows(ledger.state("b")) == [(1, "x"), (2, "y")]
    small = ledger.compact(str(tmp_path / "m"), ["a", "b"])
    assert small.done() == {0} and rows(small.state("b")) == rows(ledger.state("b"))
    assert small.commit(1, {"a": row(3, "w")}) and rows(small.state("a")) == [(1, "y"), (3, "w")]


def test_stream_state_tells_what_is_new(spark, tmp_path):
    from plinth.streaming import feeds

    schema, got = "entry_id string, url string, n int", []

    def land(*items):
        spark.createDataFrame(items, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        feeds.run_new_items(stream, str(tmp_path / "state"), lambda new, _: got.append(rows(new))).awaitTermination()

    land(("b", "u", 1), ("a", "u", 2), ("c", "v", 3))
    # Known keys are not new, whatever their order, and the first of a batch stands for a new one.
    land(("0", "u", 9), ("e", "w", 5), ("d", "w", 4))
    assert got == [[("a", 2, "u"), ("c", 3, "v")], [("d", 4, "w")]]
    assert list((tmp_path / "state/state").rglob("*.sst"))
