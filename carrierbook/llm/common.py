"""Helpers shared by the operators: table reads, Arrow maps, pinned tables, sized broadcasts."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrierbook.llm import words
from carrierbook.session import reliable_checkpoint, scratch_path

# The white space of the contracts: [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"

# Rows that one Arrow batch hands to Python code at most; the text of a batch is the memory a task needs.
ROWS_PER_SLICE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by Spark's own reader (any path that Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pin(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder of ``spark.checkpoint.dir``."""
    return reliable_checkpoint(df)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder; smaller than a checkpoint, read by column."""
    spark = df.sparkSession
    place = scratch_path(spark, f"llm-{uuid.uuid4().hex}")
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def rows_of(batches: Iterable[pa.RecordBatch], most: int = ROWS_PER_SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``most`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def give_back() -> None:
    """Hand the memory of a finished task back to the system: workers live on, and idle ones of earlier
    stages would otherwise keep what their largest task needed."""
    words.forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has it
    if trim is not None:
        trim(0)


def map_rows(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[dict | None]], schema: str,
             most_rows: int = ROWS_PER_SLICE) -> DataFrame:
    """``mapInArrow`` for functions that take slices of rows and give columns (name -> values)."""
    names = [part.strip().split()[0] for part in _fields(schema)]

    def run(batches):
        for columns in make(rows_of(batches, most_rows)):
            if columns is None:
                continue
            yield pa.RecordBatch.from_arrays([pa.array(columns[n], type=t) for n, t in zip(names, arrow_types)], names=names)
        give_back()

    _reachable(df.sparkSession)
    arrow_types = [_arrow(part.strip().split(None, 1)[1]) for part in _fields(schema)]
    return df.mapInArrow(run, schema)


def _reachable(spark: SparkSession) -> None:
    """Let Python workers import this package.

    A cluster gets it as every job's code, by ``--py-files``.  Workers of a local master run on this
    machine and only need its path.
    """
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if context.master.startswith("local") and root not in context.environment.get("PYTHONPATH", "").split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, context.environment.get("PYTHONPATH")]))


def _fields(schema: str) -> list[str]:
    """The fields of a flat DDL string (commas inside <> do not split)."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(schema[last:i])
            last = i + 1
    return [*parts, schema[last:]]


def _arrow(kind: str) -> pa.DataType:
    flat = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
            "binary": pa.binary(), "boolean": pa.bool_()}
    kind = kind.strip()
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    return flat[kind]


def text_or_empty(name: str = "text"):
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def join_sized(left: DataFrame, right: DataFrame, on: list[str], most_rows: int = 20_000, how: str = "left") -> DataFrame:
    """Join a per-group table: broadcast when its counted rows stay below a bound, else a shuffled join.

    ``right`` must be cheap to count (pinned or small).  Without the broadcast, Spark's adaptive
    skew join splits a hot key of ``left``; null keys meet null keys either way.
    """
    small = right.limit(most_rows + 1).count() <= most_rows
    side = (F.broadcast(right) if small else right).select(*[F.col(k).alias(f"__on_{k}") for k in on],
                                                           *[c for c in right.columns if c not in on])
    rule = None
    for k in on:
        same = left[k].eqNullSafe(F.col(f"__on_{k}"))
        rule = same if rule is None else rule & same
    return left.join(side, rule, how).drop(*[f"__on_{k}" for k in on])
