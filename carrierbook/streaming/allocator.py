"""Durable numbers for micro-batches (B3 receipts, ledger line ids).

A batch takes a range of a named sequence once: the range is written under the batch's id before it is used, so a
batch that is killed and run again finds the same range, and the next batch goes on after it.  Sequences
have one writer, the query whose batch ids count up.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from carrierbook.session import path_exists, sub_folders


class NumberAllocator:
    def __init__(self, spark: SparkSession, folder: str, start: int = 1):
        self.spark, self.folder, self.start = spark, folder, start

    def _range(self, name: str, batch: int) -> tuple[int, int]:
        row = self.spark.read.schema("first long, count long").parquet(self._place(name, batch)).first()
        return row["first"], row["count"]

    def _place(self, name: str, batch: int) -> str:
        return os.path.join(self.folder, name, f"batch={batch}")

    def _written(self, name: str, batch: int) -> bool:
        return path_exists(self.spark, os.path.join(self._place(name, batch), "_SUCCESS"))

    def take(self, name: str, batch: int, count: int) -> int:
        """The first of ``count`` consecutive numbers of sequence ``name`` for ``batch``.

        A repeated call of the batch gives the same numbers; it must ask for as many as before.
        """
        if self._written(name, batch):
            first, had = self._range(name, batch)
            if had != count:
                raise ValueError(f"batch {batch} took {had} numbers of {name} before and asks for {count} now")
            return first
        earlier = [int(f.split("=")[1]) for f in sub_folders(self.spark, os.path.join(self.folder, name)) if f.startswith("batch=")]
        earlier = [b for b in earlier if b < batch and self._written(name, b)]
        first = sum(self._range(name, max(earlier))) if earlier else self.start
        self.spark.createDataFrame([(first, count)], "first long, count long").coalesce(1).write.mode("overwrite").parquet(self._place(name, batch))
        return first
