"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct character n-grams (2 to 8 characters, lower-cased) of its distinct
words, each word with a space on both sides, hashed into ``DIMS`` buckets.  Training:

1. *Counts.*  Per bucket the documents of either class that hold it are counted in tasks and added up.
   The log-count ratio r = ln((p / |p|) / (q / |q|)) has p and q as the smoothed counts of the toxic and
   the other documents.
2. *Choice.*  The ``KEEP`` buckets whose split between the classes is least likely by chance stay.
3. *Weights.*  A logistic regression on the features x * r, fitted by L-BFGS with an L2 penalty.

The model is fitted on at most ``SAMPLE_MOST`` labelled rows (those with the smallest hash of their
id); only those rows' chosen buckets and the ``KEEP`` best counts reach the driver.  Scoring covers
all rows and whole texts: a sum of one weight per bucket found.  Ids, labels, language and source are
no inputs.  A document labelled more than once counts with its mean label; rows without an id are
scored but never learned from; without labels of both classes every score is the smoothed share of
the one class (0.5 without any label).  A null text counts as the empty one and scores by the base alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierbook.llm.common import map_rows, stored, text_or_empty

SIZES = (2, 3, 4, 5, 6, 7, 8)
DIMS = 1 << 21
SAMPLE_MOST = 16_000
KEEP = 8_000
SMOOTH = 1.0
LEAST_DOCS = 3      # documents of the sample that hold a bucket, at least
PENALTY = 0.3
STEPS = 200
CUT = 0.5
_PIECE = 1 << 18    # characters hashed at a time; longer texts go in overlapping pieces
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(64 - DIMS.bit_length() + 1)  # the top bits of a product depend on all bits below
_ENTRIES = 1 << 20  # entries of the training rows that one step of a pass works on


def features(text: str, wanted: np.ndarray | None = None) -> np.ndarray:
    """The sorted distinct buckets of a text's character n-grams; with ``wanted`` (a flag per bucket), just the flagged ones."""
    distinct = dict.fromkeys(text.lower().split())
    if not distinct:
        return np.zeros(0, dtype=np.int32)
    points = np.frombuffer((" " + " ".join(distinct) + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    found = [part for at in range(0, len(points), _PIECE)
             for part in _buckets(points[at:at + _PIECE + SIZES[-1] - 1], at + _PIECE < len(points), wanted)]
    return np.unique(np.concatenate(found))


def _buckets(points: np.ndarray, goes_on: bool, wanted: np.ndarray | None):
    """Buckets of the n-grams that start in a piece, per size; those after its last ``_PIECE`` belong to the next one."""
    starts = min(len(points), _PIECE) if goes_on else len(points)
    codes = (points.astype(np.uint64) + np.uint64(1)) * _STEP
    codes ^= codes >> np.uint64(31)
    blank = points == 32
    rolling = codes[:starts]
    whole = np.ones(starts, dtype=bool)  # no space inside, which ends a word
    for size in range(2, SIZES[-1] + 1):
        last = max(len(points) - size + 1, 0)
        n = min(starts, last)
        rolling = rolling[:n] * _STEP + codes[size - 1:size - 1 + n]
        whole = whole[:n] if size == 2 else whole[:n] & ~blank[size - 2:size - 2 + n]
        if size in SIZES:
            buckets = ((rolling * _SPREAD) >> _SHIFT).astype(np.int32)
            yield buckets[whole] if wanted is None else buckets[whole & wanted[buckets]]


# --- the model ------------------------------------------------------------------------------------

@dataclass
class Model:
    base: float
    buckets: np.ndarray   # int32, the buckets with a weight
    weights: np.ndarray   # float64, weight times ratio

    def dense(self) -> np.ndarray:
        table = np.zeros(DIMS)
        table[self.buckets] = self.weights
        return table


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _minimise(cost, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with a halving line search; ``cost`` gives the value and the gradient."""
    value, slope = cost(x)
    moves, turns = [], []
    for _ in range(steps):
        way = -slope
        scales = []
        for s, y in zip(reversed(moves), reversed(turns)):
            a = s @ way / (y @ s)
            scales.append(a)
            way = way - a * y
        if moves:
            way = way * (moves[-1] @ turns[-1]) / (turns[-1] @ turns[-1])
        else:
            way = way / max(1.0, float(np.linalg.norm(way)))
        for s, y, a in zip(moves, turns, reversed(scales)):
            way = way + (a - y @ way / (y @ s)) * s
        fall = slope @ way
        if fall > -1e-10:
            break
        size = 1.0
        while size > 1e-8:
            new_value, new_slope = cost(x + size * way)
            if new_value <= value + 1e-4 * size * fall:
                break
            size /= 2
        else:
            break
        move, turn = size * way, new_slope - slope
        if move @ turn > 1e-12:
            moves, turns = [*moves, move][-memory:], [*turns, turn][-memory:]
        done = value - new_value < 1e-7 * max(1.0, abs(value))
        x, value, slope = x + move, new_value, new_slope
        if done:
            break
    return x


def fit(rows: list[np.ndarray], y: np.ndarray, buckets: np.ndarray, ratios: np.ndarray) -> Model:
    """Fit on rows of sorted places in ``buckets`` with labels in [0, 1]."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(float(np.log(share / (1 - share))), np.zeros(0, np.int32), np.zeros(0))
    ends = np.cumsum([len(r) for r in rows])
    place = np.concatenate(rows) if ends[-1] else np.zeros(0, np.int64)
    # Passes go over the rows in parts of about ``_ENTRIES`` entries.
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(_ENTRIES, ends[-1], _ENTRIES)), [len(rows)]]))
    begins = np.concatenate([[0], ends])
    parts = [(lo, hi, begins[lo], begins[hi]) for lo, hi in zip(cuts, cuts[1:])]

    def lines(lo, hi):
        return np.repeat(np.arange(hi - lo), begins[lo + 1:hi + 1] - begins[lo:hi])

    def cost(v):
        scaled, z = ratios * v[:-1], np.full(len(y), v[-1])
        for lo, hi, a, b in parts:
            z[lo:hi] += np.bincount(lines(lo, hi), scaled[place[a:b]], hi - lo)
        loss = np.sum(np.logaddexp(0, z) - y * z) + PENALTY / 2 * (v[:-1] @ v[:-1])
        off, slope = _sigmoid(z) - y, np.zeros(len(ratios))
        for lo, hi, a, b in parts:
            slope += np.bincount(place[a:b], off[lo:hi][lines(lo, hi)], len(ratios))
        return loss, np.append(ratios * slope + PENALTY * v[:-1], off.sum())

    start = np.zeros(len(ratios) + 1)
    start[-1] = np.log(y.mean() / (1 - y.mean()))
    v = _minimise(cost, start, STEPS)
    return Model(float(v[-1]), buckets.astype(np.int32), v[:-1] * ratios)


# --- on Spark -------------------------------------------------------------------------------------

def held_out(doc_id="doc_id"):
    """Rows that labels are never learned from: crc32 of the id as text leaves 0 on division by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string")) % 5 == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(id, y, f): the labelled rows to learn from with their buckets, pinned; at most ``most`` ids."""
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
              .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.avg("toxic").alias("y"))
              .orderBy(F.xxhash64("id"), "id").limit(most))
    # At most ``most`` rows of (id, y) are sent to the scan of the texts.
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text")).join(F.broadcast(chosen), "id")

    def run(slices):
        for part in slices:
            yield {"id": part.column("id"), "y": part.column("y"), "f": [features(t) for t in part.column("text").to_pylist()]}

    return stored(map_rows(rows.select("id", "y", "text"), run, "id long, y double, f array<int>"))


def _counts(sample: DataFrame) -> DataFrame:
    """(bucket, p, q): label-weighted documents of either class that hold a bucket, added up in tasks first."""
    def run(slices):
        held = np.zeros((2, DIMS))
        for part in slices:
            y = part.column("y").to_numpy(zero_copy_only=False)
            found = part.column("f")
            sizes = np.diff(found.offsets.to_numpy())
            places = found.flatten().to_numpy(zero_copy_only=False)
            held[0] += np.bincount(places, np.repeat(y, sizes), DIMS)
            held[1] += np.bincount(places, np.repeat(1 - y, sizes), DIMS)
        at = np.flatnonzero(held.any(axis=0))
        if len(at):
            yield {"bucket": at.astype(np.int32), "p": held[0][at], "q": held[1][at]}

    return stored(map_rows(sample.select("y", "f"), run, "bucket int, p double, q double")
                  .groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q")))


def train(docs: DataFrame, labels: DataFrame, sample_most: int = SAMPLE_MOST, keep: int = KEEP) -> Model:
    sample = _sample(docs, labels, sample_most)
    counts = _counts(sample)
    sums = counts.agg(F.sum("p"), F.sum("q"), F.count(F.lit(1))).first()
    sizes = sample.agg(F.sum("y"), F.sum(1 - F.col("y")), F.count(F.lit(1))).first()
    toxic, other = float(sizes[0] or 0), float(sizes[1] or 0)
    if not toxic or not other:
        y = np.full(int(sizes[2]), 1.0 if toxic else 0.0)
        return fit([np.zeros(0, np.int64)] * len(y), y, np.zeros(0, np.int32), np.zeros(0))
    p, q = F.col("p"), F.col("q")
    total = F.lit(toxic + other)

    def part(seen, row, column):  # one cell of the log-likelihood ratio of independence
        return F.when(seen > 1e-9, seen * F.log(seen * total / (row * column))).otherwise(0.0)

    held = p + q
    gain = (part(p, held, F.lit(toxic)) + part(q, held, F.lit(other))
            + part(toxic - p, total - held, F.lit(toxic)) + part(other - q, total - held, F.lit(other)))
    p_all, q_all = float(sums[0] or 0) + SMOOTH * sums[2], float(sums[1] or 0) + SMOOTH * sums[2]
    ratio = F.log(((p + SMOOTH) / p_all) / ((q + SMOOTH) / q_all))
    best = (counts.where(held >= LEAST_DOCS).select("bucket", ratio.alias("r"), gain.alias("gain"))
            .orderBy(F.round("gain", 9).desc(), "bucket").limit(keep).toPandas().sort_values("bucket"))
    buckets, ratios = best["bucket"].to_numpy(np.int32), best["r"].to_numpy(float)

    def run(slices):
        for part in slices:
            out = []
            for one in part.column("f"):
                one = one.values.to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(buckets, one), max(len(buckets) - 1, 0))
                out.append(at[buckets[at] == one].astype(np.int32) if len(buckets) else at[:0].astype(np.int32))
            yield {"id": part.column("id"), "y": part.column("y"), "at": out}

    # Ids may repeat in the documents; the sample bound holds for what is fitted.
    found = (map_rows(sample, run, "id long, y double, at array<int>")
             .orderBy(F.xxhash64("id"), "id", "at").limit(sample_most).toArrow())
    rows = [r.values.to_numpy(zero_copy_only=False).astype(np.int64) for r in found.column("at")]
    return fit(rows, found.column("y").to_numpy(), buckets, ratios)


def score(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    def run(slices):
        table = model.dense()
        wanted = table != 0
        for part in slices:
            total = np.array([table[features(t, wanted)].sum() for t in part.column("text").to_pylist()], dtype=float)
            value = _sigmoid(model.base + total)
            yield {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": value,
                   "predicted": (value >= cut).astype(np.int32)}

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_or_empty().alias("text"))
    return map_rows(source, run, "doc_id long, held_out boolean, score double, predicted int")
