"""Tables in a shared folder that micro-batches rewrite bucket by bucket.

Batch n writes ``<table>/v=n/bucket=b`` for the buckets it touches and then its row in ``commits``, which names them.  A
bucket's current version is its largest committed one.  A batch that is run again reads the versions before
itself and overwrites what it wrote, so it ends as if it had run once.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carrierbook.session import path_exists, sub_folders


class Versions:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def place(self, table: str, batch: int) -> str:
        return os.path.join(self.folder, table, f"v={batch}")

    def write(self, table: str, batch: int, rows: DataFrame) -> None:
        """Write a batch's rows (with ``bucket``); overwrites what a killed run left.

        Rows are brought together by bucket, a bucket that is too large for one task (a hot case's log) is split.
        """
        rows.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(self.place(table, batch))

    def commit(self, batch: int, touched: list[int]) -> None:
        rows = self.spark.createDataFrame([(b,) for b in touched], "bucket int")
        rows.coalesce(1).write.mode("overwrite").parquet(os.path.join(self.folder, "commits", f"batch={batch}"))

    def committed(self) -> list[int]:
        place = os.path.join(self.folder, "commits")
        found = sorted(int(n.split("=")[1]) for n in sub_folders(self.spark, place) if n.startswith("batch="))
        return [b for b in found if path_exists(self.spark, os.path.join(place, f"batch={b}", "_SUCCESS"))]

    def last_batch(self) -> int | None:
        done = self.committed()
        return done[-1] if done else None

    def current(self, before: int | None = None) -> dict[int, int]:
        """Per bucket its largest committed batch (below ``before``): one number per bucket."""
        done = [b for b in self.committed() if before is None or b < before]
        if not done:
            return {}
        root = os.path.join(self.folder, "commits")
        rows = (self.spark.read.schema("bucket int, batch long").option("basePath", root)
                .parquet(*[os.path.join(root, f"batch={b}") for b in done]))
        return {r["bucket"]: r["v"] for r in rows.groupBy("bucket").agg(F.max("batch").alias("v")).collect()}

    def _from(self, table: str, schema: T.StructType, batches: list[int]) -> DataFrame | None:
        dirs = [self.place(table, v) for v in batches if path_exists(self.spark, os.path.join(self.place(table, v), "_SUCCESS"))]
        if not dirs:
            return None
        full = T.StructType([*schema.fields, T.StructField("v", T.LongType()), T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(full).option("basePath", os.path.join(self.folder, table)).parquet(*dirs)

    def _none(self, schema: T.StructType) -> DataFrame:
        return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("v", T.LongType()), T.StructField("bucket", T.IntegerType())]))

    def read(self, table: str, schema: T.StructType, versions: dict[int, int]) -> DataFrame:
        """The rows of the given versions of buckets, with ``bucket``; other folders are not read."""
        found = self._from(table, schema, sorted(set(versions.values())))
        if found is None:
            return self._none(schema).drop("v")
        wanted = F.lit(False)
        for v in sorted(set(versions.values())):  # a predicate on the folders alone
            wanted = wanted | ((F.col("v") == v) & F.col("bucket").isin([b for b, at in versions.items() if at == v]))
        return found.where(wanted).drop("v")

    def grown(self, table: str, schema: T.StructType, upto: int, touched: list[int]) -> DataFrame:
        """All rows of a table that only grows, in the touched buckets, up to a batch, with their batch ``v``."""
        found = self._from(table, schema, [b for b in self.committed() if b < upto] + [upto])
        return self._none(schema) if found is None else found.where(F.col("bucket").isin(touched))
