"""Live stock from a booking feed (Structured Streaming).

The feed is the ledger as an append-only stream.  Duplicated deliveries of a
line are dropped by ``dropDuplicates`` on the line id.  That state keeps every
id seen (hash-partitioned over the executors; use the RocksDB state store for
large feeds), because a watermark would also discard lines that arrive late,
and a ledger balance must count them.  The
balance per (location, department, product) is a plain streaming aggregate
(update / complete mode) whose state holds one row per group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierbook.functions.rules import product_or_default
from carrierbook.operators.balance import signed_sums


def live_stock(feed: DataFrame, *, dedup_key: str | None = "id") -> DataFrame:
    """Streaming (or batch) balance per location, department and product.

    ``feed`` needs location_id, department_id, product_type, type, quantity
    (+ the dedup key).  Lines count whenever they arrive.  Same rows and values as the batch stock
    aggregate on the same lines.
    """
    f = feed
    if dedup_key:
        f = f.dropDuplicates([dedup_key] if isinstance(dedup_key, str) else list(dedup_key))
    g = f.groupBy("location_id", "department_id", product_or_default("product_type").alias("product_type")) \
        .agg(*signed_sums())
    ins = F.coalesce(F.col("_ins"), F.lit(0).cast("bigint"))
    outs = F.coalesce(F.col("_outs"), F.lit(0).cast("bigint"))
    return g.select("location_id", "department_id", "product_type", ins.alias("ins"), outs.alias("outs"),
                    (ins - outs).alias("saldo"))


def start_live_stock(spark, source_dir: str, schema, checkpoint: str, query_name: str = "live_stock",
                     trigger_once: bool = True, dedup_key: str | None = "id"):
    """Run T1 over Parquet files arriving in ``source_dir`` into a memory table ``query_name``.

    ``checkpoint`` must be a shared folder (offsets and aggregate state survive
    a restart or a lost executor).
    """
    feed = spark.readStream.schema(schema).parquet(source_dir)
    q = (live_stock(feed, dedup_key=dedup_key).writeStream.outputMode("complete").format("memory").queryName(query_name)
         .option("checkpointLocation", checkpoint))
    q = q.trigger(availableNow=True) if trigger_once else q
    return q.start()


class StockTable:
    """T1 sink: keep the live balance as a table in a shared folder (``update`` mode).

    Each micro-batch writes the groups whose balance changed to
    ``table_dir/batch=<id>`` (overwrite, so a retried batch rewrites only its
    own folder).  The current balance of a group is its row in the largest
    batch that holds it: a ``max_by`` per group, no collect.
    """

    GROUP = ["location_id", "department_id", "product_type"]

    def __init__(self, spark, table_dir: str):
        self.spark, self.table_dir = spark, table_dir

    def __call__(self, changed: DataFrame, batch_id: int) -> None:
        # the batch id is the folder's partition value
        changed.write.mode("overwrite").parquet(f"{self.table_dir}/batch={batch_id}")

    def start(self, feed: DataFrame, checkpoint: str, dedup_key: str | None = "id"):
        return (live_stock(feed, dedup_key=dedup_key).writeStream.outputMode("update").foreachBatch(self)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())

    def current(self) -> DataFrame:
        rows = self.spark.read.parquet(self.table_dir)
        latest = rows.groupBy(*self.GROUP).agg(F.max_by(F.struct("ins", "outs", "saldo"), F.col("batch")).alias("_s"))
        return latest.select(*self.GROUP, "_s.ins", "_s.outs", "_s.saldo")
