"""Consecutive numbering in a stated order without pulling a group into one task.

``row_number() over (partition by g order by k)`` sends every row of a group
to one task; an unpartitioned window sends the whole table there.  Here the
rows are range-partitioned on ``(g..., k...)`` instead, so even a group that
holds a third of the table is spread over many tasks:

1. range-partition and sort, tag each row with its partition and its index
   inside the partition (``monotonically_increasing_id`` is
   ``partition << 33 | index`` and is consecutive inside a sorted partition);
2. pin those partitions with a reliable checkpoint so that every later pass
   sees the same rows in the same place (and a lost executor is recomputed
   from the shared folder, not re-sampled);
3. count rows per (group, partition) — at most one row per pair — and turn
   the counts into per-group start offsets with a window over that small table;
4. number = offset of (group, partition) + index inside the partition
   − index of the group's first row in that partition + 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carrierbook.session import reliable_checkpoint

_LOW_BITS = (1 << 33) - 1


def number_rows(df: DataFrame, order: list[Column | str], group: list[str] | None = None,
                start: int | Column = 1, out: str = "row_no", num_partitions: int | None = None) -> DataFrame:
    """Add ``out``: 1-based (plus ``start`` - 1) position of each row in ``order`` within ``group``.

    ``order`` must make rows unique (add the key as the last column), else
    ties are broken by an arbitrary but fixed (checkpointed) choice.
    """
    group = list(group or [])
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = [F.col(g) for g in group] + order_cols
    # Without an explicit count the range shuffle is sized by AQE (adjacent
    # ranges are coalesced up to the advisory partition size), so the number
    # of partitions follows the data; ids are read after that, from the
    # checkpointed partitions.
    ranged = (df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys))
    ranged = (ranged.sortWithinPartitions(*keys)
              .withColumn("__nr_mid", F.monotonically_increasing_id()))
    ranged = reliable_checkpoint(ranged)
    ranged = ranged.withColumns({"__nr_pid": F.shiftright(F.col("__nr_mid"), 33),
                                 "__nr_idx": F.col("__nr_mid").bitwiseAND(F.lit(_LOW_BITS))})
    counts = ranged.groupBy(*group, "__nr_pid").agg(F.count(F.lit(1)).alias("__nr_cnt"), F.min("__nr_idx").alias("__nr_first"))
    w = Window.partitionBy(*group).orderBy("__nr_pid") if group else Window.orderBy("__nr_pid")
    # counts has at most one row per (group, partition): bounded by the partition
    # count per group, so the per-group window here never sees a large group.
    offsets = counts.withColumn("__nr_before", F.coalesce(
        F.sum("__nr_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__nr_cnt")
    start_c = start if isinstance(start, Column) else F.lit(start)
    # NULL is a group like any other: its rows meet their offsets by a null-safe join.
    keyed = offsets.withColumnsRenamed({c: f"__nr_on_{c}" for c in [*group, "__nr_pid"]})
    same = F.col("__nr_pid") == F.col("__nr_on___nr_pid")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__nr_on_{g}"))
    numbered = ranged.join(keyed, same, "inner").drop(*[f"__nr_on_{c}" for c in [*group, "__nr_pid"]])
    return numbered.withColumn(
        out, (start_c.cast("bigint") + F.col("__nr_before") + F.col("__nr_idx") - F.col("__nr_first")).cast("bigint")
    ).drop("__nr_mid", "__nr_pid", "__nr_idx", "__nr_first", "__nr_before")
