"""Exact deduplication by skew-safe combining.

Texts are equal when they are identical after deleting every character of [\\x20\\x09-\\x0D].
Copies are combined in three steps, each grouping by the *whole* normalised text next to its
digest, so two contents are never merged on a digest alone:

1. local: the map-side combine of step 2 leaves one row per task and distinct text;
2. salted: the rows of a digest are spread over ``salts`` groups (by the task that read them),
   so a text that makes up a third of all rows never meets in one task;
3. global: at most ``salts`` winners per text are combined into one.

A winner is the row with the most code points in its original text, then the smallest doc_id.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierbook.llm.common import map_rows, pin, text_or_empty

SALTS = 32

# A winner is the largest rank: code points first, then the smallest id (no id counts as the largest).
_SPAN = "cast(100000000000000000000 as decimal(38,0))"
_TOP = "cast(9223372036854775808 as decimal(38,0))"
_RANK = f"cast(n_chars as decimal(12,0)) * {_SPAN} + coalesce({_TOP} - cast(doc_id as decimal(20,0)), cast(0 as decimal(38,0)))"

_DELETE = bytes([0x20, *range(0x09, 0x0E)])


def _digests(slices, with_text):
    for rows in slices:
        texts = rows.column("text").to_pylist()
        normal = [t.encode().translate(None, _DELETE) for t in texts]
        out = {"doc_id": rows.column("doc_id"), "text_hash": rows.column("text_hash"), "n_chars": [len(t) for t in texts],
               "sha": [hashlib.sha256(b).hexdigest() for b in normal], "n_bytes": [len(b) for b in normal]}
        if with_text:
            out["normal"] = [b.decode() for b in normal]
        yield out


def digests(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, code points, SHA-256 and length of the normalised text (and the text itself)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"),
                         F.xxhash64(text_or_empty()).alias("text_hash"))
    schema = "doc_id long, text_hash long, n_chars long, sha string, n_bytes long" + (", normal string" if with_text else "")
    return map_rows(source, lambda slices: _digests(slices, with_text), schema)


def winners(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per distinct text: sha, n_bytes, rank of the winner, group_size, copies that tie with it."""
    rows = (digests(docs, with_text=True)
            .withColumn("rank", F.expr(f"cast({_RANK} as decimal(38,0))"))
            .withColumn("salt", F.spark_partition_id() % salts))
    salted = (rows.groupBy("sha", "salt", "normal", "n_bytes")
              .agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n")))
    return (salted.groupBy("sha", "normal", "n_bytes")
            .agg(F.max("rank").alias("rank"), F.sum("n").alias("group_size"))
            .select("sha", "n_bytes", "rank", "group_size",
                    F.expr(f"cast(floor(rank / {_SPAN}) as long)").alias("keep_chars"),
                    F.expr(f"cast(nullif({_TOP} - (rank % {_SPAN}), {_TOP}) as long)").alias("keep_id")))


def _members(docs: DataFrame, salts: int) -> DataFrame:
    joined = digests(docs).join(winners(docs, salts), ["sha", "n_bytes"])
    return joined.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))
                             & (F.col("n_chars") == F.col("keep_chars")))


def membership(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows without an id come after all ids.  Rows that repeat the winner's id and length are all
    marked kept; ``deduplicate`` leaves one of them.
    """
    return _members(docs, salts).select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def deduplicate(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, one per distinct text, with all their columns."""
    kept = (_members(docs, salts).where("kept").groupBy("sha", "doc_id")
            .agg(F.min("text_hash").alias("text_hash"), F.count(F.lit(1)).alias("__times"))
            .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__times"))
    kept = pin(kept)
    stay = (docs.withColumn("__h", F.xxhash64(text_or_empty()))
            .join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash"))))
    names = docs.columns
    if kept.where("__times > 1").isEmpty():
        return stay.select(*names)
    once = stay.where("__times = 1").select(*names)
    thinned = stay.where("__times > 1").dropDuplicates(["__id", "__h"]).select(*names)
    return once.unionByName(thinned)
