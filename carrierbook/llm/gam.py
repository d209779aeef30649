"""Quality classifier: a generalised additive model with pairwise interactions.

Every text gives FEATURES numbers.  Training cycles over the features; each visit fits a shallow
tree to the current gradient over that feature's bins and adds it to the feature's lookup table.
The strongest pairs, judged by what one cross-shaped cut explains of the rest, then get tables of
their own in the same way.  Scoring looks the bins up and adds: one addition per table and text.

The model is fitted on at most ``SAMPLE_MOST`` labelled rows (those with the smallest hash of their
id), which are the only rows that reach the driver.  Scoring covers all rows.  Ids, labels, language
and source are no inputs.  A document labelled more than once counts with its mean label; without
any label the score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierbook.llm.common import map_rows, text_or_empty
from carrierbook.llm.quality import metrics

FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "distinct", "same_next",
            "line_words", "exclaims", "stops", "commas", "longest", "beyond_ascii", "short_words")
SAMPLE_MOST = 20_000
CUT = 0.7
BINS, PAIR_BINS, PAIRS = 48, 8, 8
ROUNDS, PAIR_ROUNDS, RATE = 150, 60, 0.08
LEAST_WEIGHT = 2.0


def features(text: str) -> list[float]:
    n, chars, symbols, dup_lines, repeats, lines, upper = metrics(text)
    data = text.encode()
    words = data.split()
    w, c = max(n, 1), max(chars, 1)
    octets = np.frombuffer(data, dtype=np.uint8)
    return [np.log1p(n), chars / w, symbols / c, dup_lines / max(lines, 1), repeats / w, upper / c,
            np.count_nonzero((octets >= 48) & (octets <= 57)) / c, len(set(words)) / w,
            sum(map(bytes.__eq__, words, words[1:])) / w, np.log1p(n / max(lines, 1)), data.count(b"!") / w, data.count(b".") / w,
            data.count(b",") / w, np.log1p(max(map(len, words), default=0)), np.count_nonzero(octets >= 128) / c,
            sum(len(x) < 3 for x in words) / w]


# --- the model ------------------------------------------------------------------------------------

@dataclass
class Model:
    base: float
    edges: list[np.ndarray]          # per feature, of the bins
    tables: list[np.ndarray]         # per feature, one value per bin
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]     # per feature, of the coarse bins
    pair_tables: list[np.ndarray]    # per pair, one value per cell

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores in (0, 1) of rows of features: additions of looked-up bins."""
        total = np.full(len(x), self.base)
        for k, (edge, values) in enumerate(zip(self.edges, self.tables)):
            total += values[np.searchsorted(edge, x[:, k], side="right")]
        coarse = {k: np.searchsorted(self.pair_edges[k], x[:, k], side="right") for pair in self.pairs for k in pair}
        for (i, j), values in zip(self.pairs, self.pair_tables):
            total += values[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def _gain(g, h):
    return g * g / (h + 1.0)


def _best_cut(g: np.ndarray, h: np.ndarray, lo: int, hi: int) -> tuple[float, int]:
    """The cut of bins lo..hi-1 that explains most: (gain, first bin of the right side)."""
    left_g, left_h = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
    if not len(left_g):
        return 0.0, lo
    all_g, all_h = g[lo:hi].sum(), h[lo:hi].sum()
    gain = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
    gain[(left_h < LEAST_WEIGHT) | (all_h - left_h < LEAST_WEIGHT)] = 0
    at = int(np.argmax(gain))
    return float(gain[at]), lo + at + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two over ordered bins, as one value per bin."""
    gain, cut = _best_cut(g, h, 0, len(g))
    ranges = [(0, len(g))] if gain <= 0 else [(0, cut), (cut, len(g))]
    leaves = []
    for lo, hi in ranges:
        gain, cut = _best_cut(g, h, lo, hi)
        leaves += [(lo, hi)] if gain <= 0 else [(lo, cut), (cut, hi)]
    out = np.zeros(len(g))
    for lo, hi in leaves:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + 1.0)
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cross-shaped cut of a table of cells: its gain and one value per cell."""
    best, values = 0.0, np.zeros_like(g)
    for r in range(1, g.shape[0]):
        for c in range(1, g.shape[1]):
            quarters = [(slice(0, r), slice(0, c)), (slice(0, r), slice(c, None)), (slice(r, None), slice(0, c)), (slice(r, None), slice(c, None))]
            gain = sum(_gain(g[q].sum(), h[q].sum()) for q in quarters)
            if gain > best:
                best, values = gain, np.zeros_like(g)
                for q in quarters:
                    values[q] = g[q].sum() / (h[q].sum() + 1.0)
    return best, values


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit on rows of features and labels in [0, 1]; nothing here depends on the order of rows."""
    wide = x.shape[1] if x.ndim == 2 and len(x) else len(FEATURES)
    if not len(x) or y.min() == y.max():
        share = 0.5 if not len(x) else (y.sum() + 1) / (len(y) + 2)
        return Model(float(np.log(share / (1 - share))), [np.array([])] * wide, [np.zeros(1)] * wide, [], [np.array([])] * wide, [])
    base = float(np.log(y.mean() / (1 - y.mean())))
    edges = [_edges(x[:, k], BINS) for k in range(wide)]
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(x), base)

    def gradient():
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for k, b in enumerate(bins):
            g, h = gradient()
            step = RATE * _tree(np.bincount(b, g, len(tables[k])), np.bincount(b, h, len(tables[k])))
            tables[k] += step
            total += step[b]

    coarse_edges = [_edges(x[:, k], PAIR_BINS) for k in range(wide)]
    coarse = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(coarse_edges)]

    def cells(i, j, values):
        shape = (len(coarse_edges[i]) + 1, len(coarse_edges[j]) + 1)
        return np.bincount(coarse[i] * shape[1] + coarse[j], values, shape[0] * shape[1]).reshape(shape)

    g, h = gradient()
    ranked = sorted(((_cross(cells(i, j, g), cells(i, j, h))[0], i, j) for i in range(wide) for j in range(i)), reverse=True)
    pairs = [(i, j) for gain, i, j in ranked[:PAIRS] if gain > 0]
    pair_tables = [np.zeros((len(coarse_edges[i]) + 1, len(coarse_edges[j]) + 1)) for i, j in pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), values in zip(pairs, pair_tables):
            g, h = gradient()
            step = RATE * _cross(cells(i, j, g), cells(i, j, h))[1]
            values += step
            total += step[coarse[i], coarse[j]]
    return Model(base, edges, tables, pairs, coarse_edges, pair_tables)


# --- on Spark -------------------------------------------------------------------------------------

def held_out(doc_id="doc_id"):
    """Rows that labels are never learned from: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_most: int = SAMPLE_MOST) -> Model:
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
              .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.avg("quality").alias("y"))
              .orderBy(F.xxhash64("id"), "id").limit(sample_most))
    # At most ``sample_most`` rows are sent to the scan of the texts.
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text")).join(F.broadcast(chosen), "id")

    def run(slices):
        for part in slices:
            yield {"id": part.column("id"), "y": part.column("y"), "x": [features(t) for t in part.column("text").to_pylist()]}

    # Ids may repeat in the documents; the sample bound holds for what is fitted.
    found = (map_rows(rows.select("id", "y", "text"), run, "id long, y double, x array<double>")
             .orderBy(F.xxhash64("id"), "id", "x").limit(sample_most).toPandas())
    x = np.array(found["x"].tolist(), dtype=float) if len(found) else np.zeros((0, len(FEATURES)))
    return fit(x, found["y"].to_numpy(float) if len(found) else np.zeros(0))


def score(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    def run(slices):
        for part in slices:
            value = model.score(np.array([features(t) for t in part.column("text").to_pylist()], dtype=float))
            yield {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": value, "predicted": (value >= cut).astype(np.int32)}

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_or_empty().alias("text"))
    return map_rows(source, run, "doc_id long, held_out boolean, score double, predicted int")
