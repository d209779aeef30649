"""T1 with exact de-duplication in bounded memory: live stock that counts every ledger line once, however late it comes.

Which line ids have been counted is a table on disk, not stream state: one bitmap of 32,768 bits per block of ids,
in files by range of ids.  Ledger ids are serial, so an id costs about one bit; a new batch reads and rewrites
only the ranges that its ids fall in, and an executor holds a few bitmaps of 4 KB at a time.  The test is
exact, there is no probable hit to look up.  The balances are a small table, one row per
location, department and product, to which every batch adds its new lines.

A batch that is killed and run again finds the ids and balances before itself (``Versions``), so its lines count
once.  Of lines with one id the first delivery counts; inside a delivery any of the copies.  Lines
without an id cannot be told apart and all count.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carrierbook.functions.rules import product_or_default
from carrierbook.operators.balance import signed_sums
from carrierbook.streaming.versions import Versions

BITS = 32_768            # bits of one bitmap, as Spark's bitmap functions lay them out
BLOCKS_PER_RANGE = 1024  # bitmaps of one file range: at most 4 MB
_IDS = T.StructType([T.StructField("block", T.LongType()), T.StructField("bits", T.BinaryType())])
_STOCK = T.StructType([T.StructField("location_id", T.IntegerType()), T.StructField("department_id", T.IntegerType()),
                       T.StructField("product_type", T.StringType()), T.StructField("ins", T.LongType()), T.StructField("outs", T.LongType())])


def id_range(block):
    return F.floor(block / BLOCKS_PER_RANGE).cast("int")


def _has(bits, place):
    """Whether bit ``place`` (from 0) of a bitmap is set."""
    octet = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", octet, (place % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


class SeenIds:
    """The ids counted so far, by range."""

    def __init__(self, spark: SparkSession, folder: str):
        self.store = Versions(spark, folder)

    def new_lines(self, lines: DataFrame, batch: int) -> DataFrame:
        """The lines of a batch whose id no earlier batch had, each id once; the ids become known when ``commit`` is called."""
        keyed = lines.where(F.col("id").isNotNull()).dropDuplicates(["id"]).withColumns(
            {"_block": F.bitmap_bucket_number("id"), "_bit": F.bitmap_bit_position("id")})
        versions = self.store.current(before=batch)
        self.ranges = sorted(r[0] for r in keyed.select(id_range(F.col("_block"))).distinct().collect())  # ranges, not ids
        known = self.store.read("ids", _IDS, {r: versions[r] for r in self.ranges if r in versions})
        added = keyed.groupBy(F.col("_block").alias("block")).agg(F.bitmap_construct_agg("_bit").alias("bits"))
        merged = (known.select("block", "bits").unionByName(added).groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))
                  .withColumn("bucket", id_range(F.col("block"))))
        self.store.write("ids", batch, merged)
        joined = keyed.join(known.select(F.col("block").alias("_block"), F.col("bits").alias("_bits")), "_block", "left")
        fresh = joined.where(F.col("_bits").isNull() | ~_has(F.col("_bits"), F.col("_bit"))).select(*lines.columns)
        return fresh.unionByName(lines.where(F.col("id").isNull()))

    def commit(self, batch: int) -> None:
        self.store.commit(batch, self.ranges)


class ExactStock:
    """``foreachBatch`` runner; also callable on plain DataFrames batch by batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.seen = SeenIds(spark, os.path.join(folder, "seen"))
        self.totals = Versions(spark, os.path.join(folder, "stock"))

    def __call__(self, lines: DataFrame, batch: int) -> None:
        fresh = self.seen.new_lines(lines, batch)
        added = (fresh.groupBy("location_id", "department_id", product_or_default("product_type").alias("product_type")).agg(*signed_sums())
                 .select("location_id", "department_id", "product_type", F.coalesce("_ins", F.lit(0)).cast("bigint").alias("ins"),
                         F.coalesce("_outs", F.lit(0)).cast("bigint").alias("outs")))
        held = self.totals.read("stock", _STOCK, self.totals.current(before=batch)).drop("bucket")
        total = held.unionByName(added).groupBy("location_id", "department_id", "product_type").agg(
            F.sum("ins").alias("ins"), F.sum("outs").alias("outs"))
        self.totals.write("stock", batch, total.withColumn("bucket", F.lit(0)))
        # The ids first: a batch killed between the two commits finds its stock uncommitted, reads the ids before itself and repeats.
        self.seen.commit(batch)
        self.totals.commit(batch, [0])

    def current(self) -> DataFrame:
        """(location_id, department_id, product_type, ins, outs, saldo) over all lines delivered so far."""
        rows = self.totals.read("stock", _STOCK, self.totals.current()).drop("bucket")
        return rows.withColumn("saldo", F.col("ins") - F.col("outs"))

    def start(self, feed: DataFrame, checkpoint: str):
        return (feed.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
