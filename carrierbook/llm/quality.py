"""Quality rules with adaptive thresholds.

Every document is measured; base rules reject documents with fewer than 10 words or with more than
20 % of their words in repeated 5-word windows.  The other limits are not fixed: per language and
source, each ratio of the documents that pass the base rules goes into a quantile sketch, and a
document is rejected when a ratio lies far outside its group (beyond the upper quartile by
``FENCE`` interquartile ranges, where a range counts as ``SLACK`` at least, so that a uniform group
does not reject a document for its first symbol).

The sketch is a log-bin histogram with relative error ``ERROR`` (DDSketch, Masson et al., 2019):
counts per bin, merged by addition, the same on every run.  Sketches of a source merge into those of
its language and of the corpus; groups under ``LEAST_ROWS`` documents use the next larger sketch.

Null texts have no words; null languages and sources are groups of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carrierbook.llm.common import _reachable, give_back, join_sized, pin, rows_of
from carrierbook.llm.words import window_hashes, word_hashes

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5

ERROR = 0.01
LEAST_ROWS = 50
FENCE = 3.0
# Ratio -> least interquartile range that counts.
SLACK = {"symbol_ratio": 0.02, "dup_line_ratio": 0.10, "repeat_ratio": 0.07, "upper_ratio": 0.06, "word_length": 1.5}

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in some ``width``-word window found twice or more in the text."""
    if len(words) <= width:
        return 0
    hashes = window_hashes(word_hashes(words), width)
    in_order = np.sort(hashes)
    twice = in_order[1:][in_order[1:] == in_order[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(hashes, twice))
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def metrics(text: str) -> tuple[int, ...]:
    """The METRICS of one text."""
    data = text.encode()
    words = data.split()
    lines = [line for line in text.split("\n") if line.strip(" \t\x0b\x0c\r")]
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    octets = np.frombuffer(data, dtype=np.uint8)
    upper = int(np.count_nonzero((octets >= 65) & (octets <= 90)))
    return (len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(words), len(lines), upper)


def measure(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of ``docs`` with one struct column ``__m`` of METRICS."""
    _reachable(docs.sparkSession)
    fields = T.StructType([T.StructField(n, T.LongType()) for n in METRICS])
    out = T.StructType([*[docs.schema[c] for c in carry], T.StructField("__m", fields)])
    inner = pa.struct([(n, pa.int64()) for n in METRICS])
    source = docs.select(*carry, F.coalesce(F.col("text"), F.lit("")).alias("__text"))

    def run(batches):
        for rows in rows_of(batches):
            found = np.array([metrics(t) for t in rows.column("__text").to_pylist()], dtype=np.int64)
            struct = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(len(METRICS))], fields=list(inner))
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in carry], struct], names=[*carry, "__m"])
        give_back()

    return source.mapInArrow(run, out)


def _ratios(measured: DataFrame) -> DataFrame:
    m = F.col("__m")
    words, chars = F.greatest(m.n_words, F.lit(1)), F.greatest(m.word_chars, F.lit(1))
    return measured.withColumn("__base_failed", (m.n_words < LEAST_WORDS) | (100 * m.n_repeat_words > REPEAT_PERCENT * m.n_words)
                               ).withColumn("__r", F.struct(
        (m.n_symbols / chars).alias("symbol_ratio"), (m.n_dup_lines / F.greatest(m.n_lines, F.lit(1))).alias("dup_line_ratio"),
        (m.n_repeat_words / words).alias("repeat_ratio"), (m.n_upper / chars).alias("upper_ratio"),
        (m.word_chars / words).alias("word_length")))


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, rule, bin, n): the sketch of each ratio in each group; bin null holds zeros."""
    growth = math.log((1 + ERROR) / (1 - ERROR))
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"__r.{r}").alias("x")) for r in SLACK])
    long = (_ratios(measured).where(~F.col("__base_failed"))
            .select(F.col("lang"), F.col("source"), F.explode(pairs).alias("p")))
    place = F.when(F.col("p.x") > 0, F.ceil(F.log(F.col("p.x")) / growth).cast("int"))
    return (long.select("lang", "source", F.col("p.rule").alias("rule"), place.alias("bin"))
            .groupBy("lang", "source", "rule", "bin").agg(F.count(F.lit(1)).alias("n")))


def _limits(sketch: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Per key group: the limit of each rule and the number of documents behind it."""
    merged = sketch.groupBy(*keys, "rule", "bin").agg(F.sum("n").alias("n"))
    one = Window.partitionBy(*keys, "rule")
    running = one.orderBy(F.col("bin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    growth = math.log((1 + ERROR) / (1 - ERROR))
    # A bin's middle, by relative error.
    value = F.when(F.col("bin").isNull(), 0.0).otherwise(F.exp(F.col("bin") * growth) * (1 - ERROR))
    placed = merged.select(*keys, "rule", value.alias("x"), F.sum("n").over(running).alias("upto"), F.sum("n").over(one).alias("all"))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("all")), F.col("x")))
    slack = F.create_map(*[F.lit(v) for pair in SLACK.items() for v in pair])
    quart = placed.groupBy(*keys, "rule").agg(at(0.25).alias("q1"), at(0.75).alias("q3"), F.max("all").alias("all"))
    limit = F.col("q3") + FENCE * F.greatest(F.col("q3") - F.col("q1"), slack[F.col("rule")])
    return (quart.select(*keys, "all", F.struct("rule", limit.alias("limit")).alias("p"))
            .groupBy(*keys).agg(F.max("all").alias(f"{prefix}_n"),
                                F.map_from_entries(F.collect_list("p")).alias(f"{prefix}_limits")))


def thresholds(measured: DataFrame) -> DataFrame:
    """(lang, source, limits) for every group: its own limits, its language's or the corpus's."""
    sketch = pin(sketches(measured))
    corpus = sketch.withColumn("every", F.lit(1))
    own, of_lang, of_all = (_limits(sketch, ["lang", "source"], "own").withColumn("every", F.lit(1)),
                            _limits(sketch, ["lang"], "lang").withColumnRenamed("lang", "__lang"), _limits(corpus, ["every"], "all"))
    joined = own.join(of_lang, F.col("lang").eqNullSafe(F.col("__lang")), "left").join(of_all, "every", "left")
    best = (F.when(F.col("own_n") >= LEAST_ROWS, F.col("own_limits")).when(F.col("lang_n") >= LEAST_ROWS, F.col("lang_limits"))
            .otherwise(F.col("all_limits")))
    return joined.select("lang", "source", best.alias("limits"))


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with ``__base_failed`` and ``__kept``.

    A group whose documents all fail the base rules has no limits; they are rejected anyway.
    """
    with_limits = join_sized(_ratios(measured), limits.withColumnRenamed("limits", "__limits"), ["lang", "source"])
    beyond = F.lit(False)
    for rule in SLACK:
        beyond = beyond | F.coalesce(F.col(f"__r.{rule}") > F.col("__limits")[rule], F.lit(False))
    return with_limits.withColumn("__kept", ~F.col("__base_failed") & ~beyond)


def quality_rows(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, the base metrics, base_failed and kept."""
    measured = pin(measure(docs, ["doc_id", "lang", "source"]))
    judged = judge(measured, pin(thresholds(measured)))
    return judged.select(F.col("doc_id").cast("long").alias("doc_id"),
                         *[F.col(f"__m.{n}").alias(n) for n in METRICS[:5]],
                         F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    names = docs.columns
    limits = pin(thresholds(measure(docs, ["lang", "source"])))
    return judge(measure(docs, names), limits).where("__kept").select(*names)
