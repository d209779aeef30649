"""Ranked lexical search over a length-stratified index.

Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased.  With N documents that
hold a term, L terms in all and n terms in a document, the document's normaliser is m = 75 + (25 n N) div L.
A term that df documents hold weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))), tf occurrences of it give the impact
(1000000000 tf) div (1000 tf + 12 m), and a document scores the sum of w * impact over the query's terms, repeats included.

* *Index.*  Documents with equal m form a stratum, so an impact depends on tf alone inside it.  Rows are
  range-partitioned on (m, hash of the row), which spreads a stratum that holds many documents over tasks, and cut into blocks
  of at most ``BLOCK_DOCS`` documents of one stratum.  A block row holds its terms, each with its postings ordered by tf.
* *Bounds.*  A block's bound for a query adds up, over the query's terms, weight times the impact of the
  term's largest tf in the block.  They order the visits: every query first visits its ``FIRST_VISITS`` best blocks; the
  ``top``-th score found there is its threshold.
* *Visits.*  All blocks whose bound reaches the threshold are visited, the others cannot hold an answer.  In a
  visit an impact is computed once per distinct tf and added to the documents of the posting.  A block hands on
  its ``top`` best documents per query; the last ranking takes ``top`` of those.

Results are exact, equal scores stand in ascending order of the document's id.  Queries are taken in groups of about
``TERMS_AT_ONCE`` query terms, each against the whole index, so what is sent to tasks is bounded.

Defined results: a null or empty text has no term and is no document of N; a document row without an id counts in the statistics but
cannot be named and is not ranked; rows that repeat are documents of their own; a query without terms, or whose terms
stand nowhere, has no row; further columns are not read; empty tables give an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carrierbook.llm.common import map_rows, stored, text_or_empty

TOP = 20
BLOCK_DOCS = 4096          # documents of a block at most
BLOCK_POSTINGS = 1_000_000  # postings after which a block is closed
FIRST_VISITS = 8
TERMS_AT_ONCE = 200_000    # query terms (with repeats) of one group of queries, about

# Octets outside terms become spaces, A-Z becomes a-z; octets of characters beyond ASCII stay.
_TERM_OCTETS = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_TERM_OCTETS).split()


def impact(tf, m):
    """The impact of ``tf`` occurrences in a document with normaliser ``m`` (64-bit integers)."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


# --- the index ------------------------------------------------------------------------------------

def _counted(docs: DataFrame, only: set[bytes] | None) -> DataFrame:
    """(doc_id, row, n, terms, tfs) of the texts with a term; with ``only``, other terms count in n alone."""
    def run(slices):
        for part in slices:
            out = {k: [] for k in ("doc_id", "n", "terms", "tfs")}
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                found = terms(text)
                if found:
                    counts = Counter(found if only is None else filter(only.__contains__, found))
                    out["doc_id"].append(doc_id)
                    out["n"].append(len(found))
                    out["terms"].append(list(counts))
                    out["tfs"].append(list(counts.values()))
            yield out

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    return map_rows(source, run, "doc_id long, n long, terms array<binary>, tfs array<long>")


def _blocks(rows: DataFrame) -> DataFrame:
    """Block rows of counted documents with their normaliser, strata spread by range over the tasks."""
    placed = rows.repartitionByRange("m", F.xxhash64("doc_id")).sortWithinPartitions("m")

    def run(slices):
        held, size, m = [], 0, None

        def close():
            by_term = {}
            for k, (_, words, tfs) in enumerate(held):
                for word, tf in zip(words, tfs):
                    by_term.setdefault(word, []).append((-tf, k))
            words = sorted(by_term)
            lists = [sorted(by_term[w]) for w in words]
            return {"m": [m], "ids": [[i for i, _, _ in held]], "terms": [words], "most": [[-one[0][0] for one in lists]],
                    "ends": [np.cumsum([len(one) for one in lists]).tolist()],
                    "docs": [[k for one in lists for _, k in one]], "tfs": [[-t for one in lists for t, _ in one]]}

        for part in slices:
            for doc_id, new_m, words, tfs in zip(*(part.column(k).to_pylist() for k in ("doc_id", "m", "terms", "tfs"))):
                if held and (new_m != m or len(held) == BLOCK_DOCS or size + len(words) > BLOCK_POSTINGS):
                    yield close()
                    held, size = [], 0
                m = new_m
                held.append((doc_id, words, tfs))
                size += len(words)
        if held:
            yield close()

    return map_rows(placed.select("doc_id", "m", "terms", "tfs"), run,
                    "m long, ids array<long>, terms array<binary>, most array<long>, ends array<long>, docs array<int>, tfs array<long>",
                    most_rows=256)


class Index:
    """The blocks and the term weights, as tables in the shared folder."""

    def __init__(self, blocks: DataFrame, weights: DataFrame):
        self.blocks, self.weights = blocks, weights


def build_index(docs: DataFrame, only: set[bytes] | None = None) -> Index:
    """Index every row of ``docs``; with ``only`` (a bounded set), just the postings of those terms."""
    counted = stored(_counted(docs, only))
    whole = counted.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    n, total = int(whole["n"]), int(whole["l"] or 1)
    seen = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = stored(seen.select("term", F.floor(1000 * F.log((2.0 * n + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long").alias("w")))
    m = F.lit(75).cast("long") + F.expr(f"(25L * n * {n}L) div {total}L")
    with_id = counted.where(F.col("doc_id").isNotNull()).withColumn("m", m)
    return Index(stored(_blocks(with_id).withColumn("block", F.monotonically_increasing_id())), weights)


# --- queries --------------------------------------------------------------------------------------

def _queries(items: DataFrame) -> DataFrame:
    """(item, item_id, terms, times) of the rows with a term; ``item`` numbers the rows."""
    def run(slices):
        for part in slices:
            out = {"item_id": [], "terms": [], "times": []}
            for item_id, text in zip(part.column("item_id").to_pylist(), part.column("text").to_pylist()):
                counts = Counter(terms(text))
                if counts:
                    out["item_id"].append(item_id)
                    out["terms"].append(list(counts))
                    out["times"].append(list(counts.values()))
            yield out

    source = items.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().cast("binary").alias("text"))
    found = map_rows(source, run, "item_id long, terms array<binary>, times array<long>")
    return stored(found.withColumn("item", F.monotonically_increasing_id()))


def _groups(items: DataFrame) -> list[DataFrame]:
    """The queries in groups of about ``TERMS_AT_ONCE`` terms, dealt by hash."""
    size = items.agg(F.sum(F.size("terms"))).first()[0]
    if not size:
        return []
    parts = -(-size // TERMS_AT_ONCE)
    return [items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == k) for k in range(parts)]


def _weighted(group: DataFrame, weights: DataFrame) -> dict[bytes, list[tuple[int, int]]]:
    """Per term the queries that hold it, as (item, weight times repeats); bounded by the group's terms."""
    pairs = group.select("item", F.explode(F.arrays_zip("terms", "times")).alias("p")).select(
        "item", F.col("p.terms").alias("term"), F.col("p.times").alias("times"))
    held = {}
    for row in pairs.join(weights, "term").select("item", "term", (F.col("w") * F.col("times")).alias("worth")).collect():
        if row["worth"]:
            held.setdefault(bytes(row["term"]), []).append((row["item"], row["worth"]))
    return held


def _bounds(index: Index, held) -> DataFrame:
    """(block, item, bound) of every block that holds a term of the query."""
    def run(slices):
        for part in slices:
            out = {"block": [], "item": [], "bound": []}
            for block, m, words, most in zip(*(part.column(k).to_pylist() for k in ("block", "m", "terms", "most"))):
                bound = Counter()
                for word, tf in zip(words, most):
                    for item, worth in held.get(word, ()):
                        bound[item] += worth * impact(tf, m)
                out["block"] += [block] * len(bound)
                out["item"] += bound.keys()
                out["bound"] += bound.values()
            yield out

    return stored(map_rows(index.blocks.select("block", "m", "terms", "most"), run, "block long, item long, bound long", most_rows=64))


def _visit(index: Index, visits: DataFrame, held, top: int) -> DataFrame:
    """(item, doc_id, score): per visit (block, item, least) the ``top`` best documents that reach ``least``."""
    def run(slices):
        for part in slices:
            out = {"item": [], "doc_id": [], "score": []}
            for m, ids, words, ends, places, tfs, items, least in zip(*(
                    part.column(k) for k in ("m", "ids", "terms", "ends", "docs", "tfs", "items", "least"))):
                m = m.as_py()
                ids, ends, places, tfs, items, least = (c.values.to_numpy(zero_copy_only=False) for c in (ids, ends, places, tfs, items, least))
                wanted = dict(zip(items.tolist(), least.tolist()))
                scores = {}
                # Impacts of the stratum, once per distinct tf.
                distinct, at = np.unique(tfs, return_inverse=True)
                impacts = impact(distinct, m)[at]
                for word, a, b in zip(words.as_py(), [0, *ends.tolist()], ends.tolist()):
                    for item, worth in held.get(word, ()):
                        if item in wanted:
                            if item not in scores:
                                scores[item] = np.zeros(len(ids), dtype=np.int64)
                            scores[item][places[a:b]] += worth * impacts[a:b]
                for item, score in scores.items():
                    hit = np.flatnonzero(score >= max(1, wanted[item]))
                    best = hit[np.lexsort((ids[hit], -score[hit]))[:top]]
                    out["item"] += [item] * len(best)
                    out["doc_id"] += ids[best].tolist()
                    out["score"] += score[best].tolist()
            yield out

    # A block is visited by at most the queries of the group.
    asked = visits.groupBy("block").agg(F.collect_list(F.struct("item", "least")).alias("asked"))
    rows = index.blocks.join(asked, "block").select("m", "ids", "terms", "ends", "docs", "tfs", F.col("asked.item").alias("items"),
                                                    F.col("asked.least").alias("least"))
    return stored(map_rows(rows, run, "item long, doc_id long, score long", most_rows=8))


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(index: Index, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of every query row of ``items`` (item_id, text)."""
    return _answer(index, _queries(items), top)


def _answer(index: Index, queries: DataFrame, top: int) -> DataFrame:
    found = None
    for group in _groups(queries):
        held = _weighted(group, index.weights)
        bounds = _bounds(index, held)
        order = Window.partitionBy("item").orderBy(F.col("bound").desc(), "block")
        first = bounds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= FIRST_VISITS)
        early = _visit(index, first.withColumn("least", F.lit(0).cast("long")), held, top)
        threshold = _best(early, top).where(F.col("rank") == top).select("item", F.col("score").alias("least"))
        rest = (bounds.join(first.select("item", "block"), ["item", "block"], "left_anti").join(threshold, "item", "left")
                .withColumn("least", F.coalesce("least", F.lit(0).cast("long"))).where(F.col("bound") >= F.col("least")))
        late = _visit(index, rest.select("block", "item", "least"), held, top)
        one = early.unionByName(late)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return queries.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    best = _best(found, top).select("item", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
    return best.join(queries.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """Index ``docs`` for the terms of ``items`` and search: every document, only postings that can be asked for.

    The query's vocabulary reaches the tasks while it has at most ``TERMS_AT_ONCE`` terms; a larger one
    is not sent and every term is indexed.
    """
    queries = _queries(items)
    vocabulary = queries.select(F.explode("terms").alias("term")).distinct()
    few = vocabulary.limit(TERMS_AT_ONCE + 1).collect()
    only = {bytes(r["term"]) for r in few} if len(few) <= TERMS_AT_ONCE else None
    return _answer(build_index(docs, only), queries, top)
