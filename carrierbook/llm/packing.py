"""Sequence packing by non-negative least squares over length combinations.

Documents are cut every ``window`` tokens; what is left of each is one piece.  Pieces of equal
length are exchangeable, so the plan is made on the histogram of lengths (at most ``window`` bins):

1. shallow combinations that fill a window exactly are enumerated: the full piece, all pairs, and
   the triples with one of the ``triple_lengths`` most frequent lengths;
2. non-negative least squares gives each combination a repeat count, so that the used lengths match
   the histogram;
3. counts are rounded (down, then up by one where pieces remain, largest fractions first);
4. pieces left over are packed greedily, longest first, each gap taking the longest piece that fits.

Every piece finds its place from its rank among pieces of its length.  Ranks come from counts per
(partition, length), so a length that a third of all pieces share is never ranked in one task.  Only
the histogram reaches the driver; the plan sent to tasks has at most a few entries per combination.

Null texts are empty; an empty text is one piece holding the end id alone.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carrierbook.llm.common import map_rows, pin, text_or_empty
from carrierbook.llm.tokens import vocabulary, word_ids

WINDOW = 4096
END_ID = 2
TRIPLE_LENGTHS = 48
STEPS = 60
TEXTS_AT_ONCE = 512  # texts whose parts a worker looks up together


# --- pieces -------------------------------------------------------------------------------------

def _pieces(slices, path, window, end_id, with_ids):
    end = np.array([end_id], dtype="<u4").tobytes()
    for rows in slices:
        out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else []))}
        vocab = vocabulary(path)
        for doc_id, ids in zip(rows.column("doc_id").to_pylist(), word_ids(vocab, rows.column("text"))):
            ids += end
            total = len(ids) // 4
            for start in range(0, total, window):
                part = ids[4 * start:4 * (start + window)]
                out["doc_id"].append(doc_id)
                out["start"].append(start)
                out["length"].append(len(part) // 4)
                out["ids_crc32"].append(zlib.crc32(part))
                out["doc_tokens"].append(total)
                if with_ids:
                    out["ids"].append(part)
        yield out


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens (and its ids, 4 bytes each)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if with_ids else "")
    return map_rows(source, lambda s: _pieces(s, path, window, end_id, with_ids), schema, TEXTS_AT_ONCE)


# --- the plan -----------------------------------------------------------------------------------

def combinations(histogram: np.ndarray, triple_lengths: int = TRIPLE_LENGTHS) -> np.ndarray:
    """Rows of three lengths (0: none) that sum to the window, of lengths in the histogram."""
    window = len(histogram) - 1
    have = np.flatnonzero(histogram)
    have = have[(have > 0) & (have < window)]
    small = have[2 * have <= window]
    pairs = small[histogram[window - small] > 0]
    found = [np.stack([pairs, window - pairs, np.zeros_like(pairs)], axis=1)]
    for a in have[np.argsort(-histogram[have], kind="stable")][:triple_lengths]:
        b = have[2 * have <= window - a]
        b = b[histogram[window - a - b] > 0]
        found.append(np.sort(np.stack([np.full_like(b, a), b, window - a - b], axis=1), axis=1)[:, ::-1])
    return np.unique(np.concatenate(found), axis=0)[::-1]


def solve(histogram: np.ndarray, combos: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that bring the used lengths close to the histogram.

    Projected gradient steps, each scaled by how many combinations use a length, so that no step
    overshoots; the squared error falls with every step.
    """
    target = histogram.astype(float).copy()
    target[0] = 0
    uses = np.bincount(combos.ravel(), minlength=len(histogram)).astype(float)
    uses[0] = 1
    x = np.zeros(len(combos))
    for _ in range(steps):
        used = np.bincount(combos.ravel(), weights=np.repeat(x, 3), minlength=len(histogram))
        used[0] = 0
        left = (target - used) / np.maximum(uses, 1)
        left[0] = 0
        x = np.maximum(0, x + left[combos].sum(axis=1) / (combos > 0).sum(axis=1))
    return x


def plan(histogram: np.ndarray, triple_lengths: int = TRIPLE_LENGTHS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences); every piece of the histogram is in one.

    Triples help where short pieces are many, and cost partners of long pieces where lengths are
    spread evenly: pairs alone and pairs with triples are both solved, and the shorter plan holds.
    """
    return min((_rounded(histogram, k) for k in (triple_lengths, 0)), key=lambda made: sum(times for _, times in made))


def _rounded(histogram: np.ndarray, triple_lengths: int) -> list[tuple[tuple[int, ...], int]]:
    """The plan from one set of combinations: solved, rounded, the rest packed greedily."""
    window = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    made: list[tuple[tuple[int, ...], int]] = []

    def take(lengths, most):
        need: dict[int, int] = {}
        for n in lengths:
            need[n] = need.get(n, 0) + 1
        times = min(most, *(int(left[n]) // k for n, k in need.items()))
        if times > 0:
            made.append((tuple(lengths), times))
            for n, k in need.items():
                left[n] -= k * times

    take([window], int(left[window]))
    combos = combinations(left, triple_lengths)
    if len(combos):
        x = solve(left, combos)
        order = np.argsort(-x, kind="stable")
        for c in order[x[order] >= 1]:
            take([int(n) for n in combos[c] if n], int(x[c]))
        part = x - np.floor(x)
        for c in np.argsort(-part, kind="stable")[:np.count_nonzero(part > 1e-6)]:
            take([int(n) for n in combos[c] if n], 1)
    # Greedy rest: the longest piece opens a window, gaps take the longest piece that fits.
    while left.any():
        lengths, room, spare = [], window, left.copy()
        while True:
            fits = np.flatnonzero(spare[:room + 1])
            if not len(fits):
                break
            n = int(fits[-1])
            lengths.append(n)
            spare[n] -= 1
            room -= n
        take(lengths, int(left[lengths[0]]))
    return made


def _places(made: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys length << 40 | first rank, with the first sequence and the offset of each run."""
    used: dict[int, int] = {}
    keys, first, offset, sequence = [], [], [], 0
    for lengths, times in made:
        at = 0
        for n in lengths:
            keys.append(n << 40 | used.get(n, 0))
            first.append(sequence)
            offset.append(at)
            used[n] = used.get(n, 0) + times
            at += n
        sequence += times
    order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
    return (np.array(keys, dtype=np.int64)[order], np.array(first, dtype=np.int64)[order], np.array(offset, dtype=np.int64)[order])


def _placed(slices, keys, first, offset, names):
    for rows in slices:
        length = rows.column("length").to_numpy(zero_copy_only=False)
        rank = rows.column("rank").to_numpy(zero_copy_only=False)
        at = np.searchsorted(keys, length << 40 | rank, side="right") - 1
        yield {**{n: rows.column(n) for n in names},
               "sequence_id": first[at] + rank - (keys[at] & ((1 << 40) - 1)), "offset": offset[at]}


# --- the operator -------------------------------------------------------------------------------

def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: its document, place there, checksum, sequence and offset (and its ids)."""
    cut = pin(pieces(docs, path, window, end_id, with_ids)).withColumn("part", F.spark_partition_id())
    counts = pin(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = np.zeros(window + 1, dtype=np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``window`` rows
        histogram[row["length"]] = row["n"]
    keys, first, offset = _places(plan(histogram))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "length", "before")
    within = Window.partitionBy("part", "length").orderBy("doc_id", "start", "ids_crc32")
    ranked = (cut.withColumn("own", F.row_number().over(within) - 1).join(starts, ["part", "length"])
              .withColumn("rank", (F.col("own") + F.col("before")).cast("long")))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    schema = ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in [*names, "sequence_id", "offset"])
    return map_rows(ranked.select(*names, "rank"), lambda s: _placed(s, keys, first, offset, names), schema)
