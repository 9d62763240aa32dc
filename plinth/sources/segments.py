"""Parts of a stored index as segments: written under a new number, then listed, then read.

Readers take listed segments only, so a writer that is lost leaves files that nobody reads. One writer at a
time is assumed. Every part keeps its schema beside it, so parts without rows can be read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Segments:
    spark: SparkSession
    path: str

    @staticmethod
    def new() -> str:
        return "s" + uuid.uuid4().hex

    def put(self, segment: str, part: str, df: DataFrame) -> DataFrame:
        """The rows written as a part of a segment, and read back."""
        df.limit(0).write.mode("ignore").parquet(f"{self.path}/schema/{part}")
        df.withColumn("segment", F.lit(segment)).write.mode("append").partitionBy("segment").parquet(f"{self.path}/{part}")
        return self.read(segment, part)

    def read(self, segment: str, part: str) -> DataFrame:
        return self._read(part).where(F.col("segment") == segment).drop("segment")

    def commit(self, segment: str) -> None:
        """From now on readers see the segment."""
        self.spark.createDataFrame([(segment,)], "segment string").coalesce(1).write.mode("append").parquet(f"{self.path}/segments")

    def segments(self) -> list[str]:
        """The listed segments: as many as there were batches since the parts were last made one."""
        marker = self.spark.createDataFrame([], "segment string")
        marker.write.mode("ignore").parquet(f"{self.path}/segments")
        return [r["segment"] for r in self.spark.read.schema("segment string").parquet(f"{self.path}/segments").collect()]

    def listed(self, part: str) -> DataFrame:
        """The rows of a part in the listed segments; a segment is a folder, so others are not opened."""
        return self._read(part).where(F.col("segment").isin(self.segments())).drop("segment")

    def _read(self, part: str) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/schema/{part}").schema
        return self.spark.read.schema(schema.add("segment", "string")).parquet(f"{self.path}/{part}")
