"""Stored tables that take merges without being written whole: by key parts, and by buckets.

`KeyedTable` lies in parts by a hash of its keys, and a merge reads and replaces only the parts that the incoming
keys fall in. `BucketedTable` lies in buckets of its keys, so that a merge of any share of it joins bucket by
bucket: only the incoming rows are shuffled, and the result is written in the same buckets.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.operators.merge import upsert
from plinth.session import write_once

PART = "_part"


def part_of(keys: list[str], parts: int) -> Column:
    """The part of a key: from its MD5, so that any engine finds it; NULL keys are a value of their own."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys])
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("int"), F.lit(parts))


@dataclass(frozen=True)
class KeyedTable:
    """A table in `parts` folders. Choose as many as make a part some files large."""

    spark: SparkSession
    path: str
    keys: list[str]
    parts: int = 64

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(PART, part_of(self.keys, self.parts))

    def _write(self, placed: DataFrame) -> None:
        # Rows of a part are gathered; the adaptive planner splits the large ones.
        placed.hint("rebalance", PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path)

    def create(self, df: DataFrame) -> KeyedTable:
        self._write(self._placed(df))
        return self

    def stored(self) -> DataFrame:
        """The rows with their part, which Spark takes from the folder names."""
        return self.spark.read.parquet(self.path)

    def read(self) -> DataFrame:
        return self.stored().drop(PART)

    def merge(self, rows: DataFrame, **options) -> list[int]:
        """`merge.upsert` of the rows on the keys; returns the parts that were written, no more than there are.

        Spark puts the parts in place one by one, so a merge that was lost half way is to be repeated: with
        an overwriting policy that gives the same table.
        """
        incoming = write_once(self._placed(rows))
        touched = sorted(r[PART] for r in incoming.select(PART).distinct().collect())
        old = self.stored().where(F.col(PART).isin(touched)).drop(PART)
        merged = upsert(old, incoming.drop(PART), self.keys, **options)
        self._write(self._placed(merged).where(F.col(PART).isin(touched)))
        return touched


@dataclass(frozen=True)
class BucketedTable:
    """A table of the catalog in `buckets` by keys that are never NULL; each merge gives a new version of it."""

    spark: SparkSession
    name: str
    keys: list[str]
    buckets: int = 64

    def _write(self, df: DataFrame, name: str, folder: str | None) -> BucketedTable:
        writer = df.write.bucketBy(self.buckets, *self.keys).sortBy(*self.keys)
        (writer.option("path", f"{folder.rstrip('/')}/{name}") if folder else writer).saveAsTable(name)
        return replace(self, name=name)

    def create(self, df: DataFrame, folder: str | None = None) -> BucketedTable:
        return self._write(df.repartition(self.buckets, *self.keys), self.name, folder)

    def read(self) -> DataFrame:
        return self.spark.read.table(self.name)

    def merged(self, rows: DataFrame, **options) -> DataFrame:
        """The table after `merge.upsert` of the rows; its own rows are not shuffled."""
        return upsert(self.read(), rows, self.keys, null_keys=False, **options)

    def merge(self, rows: DataFrame, folder: str | None = None, **options) -> BucketedTable:
        base = self.name.split("__")[0]
        return self._write(self.merged(rows, **options), f"{base}__{uuid.uuid4().hex[:12]}", folder)

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")
