"""Several tables that change together: a batch is seen in all of them or in none.

Every batch writes what it changes in each table as rows of a segment (`sources.segments`) and then one
record that names the batch and its segment. Only listed segments are read, so a batch that fails between
two tables leaves nothing, and its repetition does all of it anew; a batch that is listed is not written
again. The current row of a key is that of its last batch; `compact` writes the current rows as one segment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators.ranking import keep_first
from plinth.sources.segments import Segments

#: The batch number of rows that were there before the first batch.
BEFORE = -1


@dataclass(frozen=True)
class Ledger:
    """Tables by name with their key columns, and where they are stored."""

    parts: Segments
    keys: dict[str, list[str]]

    def state(self, table: str) -> DataFrame:
        """The current rows of a table."""
        rows = self.parts.listed(table)
        return keep_first(rows, self.keys[table], [F.desc("_batch")]).drop("_batch")

    def done(self) -> set[int]:
        """Numbers of the batches that are listed."""
        return {int(s.split("-")[0][1:].replace("m", "-")) for s in self.parts.segments()}

    def commit(self, batch: int, changes: Callable[[], dict[str, DataFrame]] | dict[str, DataFrame], after: Callable[[str], None] | None = None) -> bool:
        """Apply the changed rows of each table, unless the batch was applied before. Tells whether it was new.

        `after` is called when a table is written and before the batch is listed.
        """
        if batch in self.done():
            return False
        # A name that tells the batch and is new at each attempt.
        segment = f"s{batch}-".replace("s-", "sm") + Segments.new()
        for table, rows in (changes() if callable(changes) else changes).items():
            self.parts.put(segment, table, rows.withColumn("_batch", F.lit(batch).cast("long")))
            if after:
                after(table)
        self.parts.commit(segment)
        return True

    def compact(self, path: str, tables: Iterable[str]) -> Ledger:
        """The current rows in a new place, as the rows before the first of the batches to come."""
        fresh = Ledger(Segments(self.parts.spark, path), self.keys)
        fresh.commit(max(self.done()), {t: self.state(t) for t in tables})
        return fresh
