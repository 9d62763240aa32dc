"""What the operators share: row keys, Arrow batches of bounded size, tables written once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.session import checkpoint_root

#: Bytes of one Arrow batch sent to a Python worker: bounds its memory however long the texts are.
BATCH_BYTES = 8 << 20
#: Groups that rows of one key are dealt into.
SALTS = 256


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128-bit key of a row by id and text, never NULL. Rows equal in both are interchangeable."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")).cast("binary") for c in (doc_id, text)]
    return F.unhex(F.md5(F.concat(parts[0], F.lit(b"\x1f"), parts[1])))


def map_tables(df: DataFrame, function: Callable[[Iterator[pa.Table]], Iterator[pa.Table]], schema: str | T.StructType) -> DataFrame:
    """`function(tables) -> tables` over all Arrow batches of a task, each of at most about BATCH_BYTES.

    Empty partitions give no rows. The batch bound is a session setting, so it is set only where
    the session still has Spark's default.
    """
    conf = df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(name, str(2**31 - 1)).rstrip("bB")) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in function(pa.Table.from_batches([batch]) for batch in batches if batch.num_rows):
            yield from table.to_batches()
            del table
            # What the pool keeps of this batch counts as the worker's memory while it waits.
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def map_arrow(df: DataFrame, function: Callable[[pa.Table], pa.Table], schema: str | T.StructType) -> DataFrame:
    """`function(table) -> table` over Arrow batches of at most about BATCH_BYTES."""
    return map_tables(df, lambda tables: map(function, tables), schema)


def over_equals(rows: DataFrame, key: str, salt: str, **aggregates: tuple[Callable[[Column | str], Column], str]) -> DataFrame:
    """`rows` with aggregates over all rows that share `key`, `n` of them; NULL where `n` would be 1.

    Aggregates are (function, column) for functions that combine their own results, as min and max do.
    Rows are summed by key and a salt from the column `salt` first, and joined by both: a key that a
    third of all rows hold is at most SALTS rows in the second step and SALTS groups in the join.
    """
    salted = rows.withColumn("_salt", F.pmod(F.hash(salt), F.lit(SALTS)))
    parts = salted.groupBy(key, "_salt").agg(F.count("*").alias("n"), *(f(c).alias(name) for name, (f, c) in aggregates.items()))
    sums = parts.groupBy(key).agg(F.sum("n").alias("n"), F.collect_list("_salt").alias("_salts"), *(f(name).alias(name) for name, (f, _) in aggregates.items()))
    found = written(sums.where("n > 1").select(F.col(key).alias("_k"), "n", *aggregates, F.explode("_salts").alias("_s")))
    return salted.join(found, (F.col(key) == F.col("_k")) & (F.col("_salt") == F.col("_s")), "left").drop("_salt", "_k", "_s")


def written(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet to the shared checkpoint folder and read back.

    Survives the loss of executors, cuts the lineage, and gives later joins true sizes.
    """
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
