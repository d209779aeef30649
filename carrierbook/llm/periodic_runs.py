"""Periodic runs of words, found by block convolution.

A text is the sequence of its words ``[^\\x20\\x09-\\x0D]+``.  A run is a stretch of words with smallest period
q (words q apart are identical) and at least max(6, 4 q) words that no neighbouring word extends.

1. *Scales.*  At scale B = 2^k lie the periods whose runs must hold a block of B words, aligned to B, with its
   next occurrence: B is the largest power of two up to (3 q + 1) / 2.  Each period has one scale.
2. *Convolution.*  For every block the squared differences to all places of its window, the words that follow at
   distances of the scale, are summed by a number-theoretic transform: sum a^2 + sum b^2 - 2 sum a b, exact
   modulo a prime.  A zero is an occurrence without a mismatch, its distance is a seed.  Blocks whose first
   words do not recur at any distance of the scale can have none and are left out.
3. *Extension.*  Seeds that a run's first block could give are compared word by word to both sides as far as the
   words agree; smaller periods come first, so a run found again at a multiple of its period is known.

Texts are taken many at a time as one sequence with unlike numbers between them, so that the work is done on
arrays; a text longer than a batch is a batch of its own and takes memory in proportion to its words.

A null text has no words.  A row without an id keeps its words as they are (``planted_period`` does
nothing).  Repeated rows are answered one by one; further columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierbook.llm.common import _reachable, give_back, map_rows, rows_of, text_or_empty

LEAST_WORDS = 6
LEAST_PERIODS = 4
WORDS_AT_ONCE = 400_000   # words of one batch of texts; a longer text is a batch of its own
_CELLS = 1 << 18          # numbers that one transform holds (more where a single block needs them)
_PRIME = 2013265921       # 15 * 2^27 + 1, with 31 as a primitive root
_ROOT = 31
_P = np.uint64(_PRIME)
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


# --- the transform --------------------------------------------------------------------------------

_ROOTS: dict[int, np.ndarray] = {}


def _roots(half: int, inverse: bool) -> np.ndarray:
    """Powers of the root of unity of order 2 * half, or of its inverse."""
    key = -half if inverse else half
    if key not in _ROOTS:
        step = pow(_ROOT, (_PRIME - 1) // (2 * half), _PRIME)
        if inverse:
            step = pow(step, _PRIME - 2, _PRIME)
        powers = np.ones(half, dtype=np.uint64)
        done = 1
        while done < half:
            powers[done:2 * done] = powers[:done] * np.uint64(pow(step, done, _PRIME)) % _P
            done *= 2
        _ROOTS[key] = powers
    return _ROOTS[key]


def _transform(a: np.ndarray) -> np.ndarray:
    """Transform of each row (a power of two long); the places come out in bit-reversed order."""
    rows, size = a.shape
    half = size // 2
    while half:
        a = a.reshape(rows, -1, 2, half)
        low, high = a[:, :, 0], a[:, :, 1]
        a = np.stack([(low + high) % _P, (low + _P - high) * _roots(half, False) % _P], axis=2)
        half //= 2
    return a.reshape(rows, size)


def _back(a: np.ndarray) -> np.ndarray:
    """The inverse of ``_transform``."""
    rows, size = a.shape
    half = 1
    while half < size:
        a = a.reshape(rows, -1, 2, half)
        low, high = a[:, :, 0], a[:, :, 1] * _roots(half, True) % _P
        a = np.stack([(low + high) % _P, (low + _P - high) % _P], axis=2)
        half *= 2
    return a.reshape(rows, size) * np.uint64(pow(size, _PRIME - 2, _PRIME)) % _P


def squared_differences(x: np.ndarray, starts: np.ndarray, block: int, first: int, last: int) -> np.ndarray:
    """For each block x[s:s+block]: the sums of squared differences, modulo the prime, to x[s+d:s+d+block]
    for d in first..last.  ``x`` reaches far enough; last - first is below ``block``."""
    lags = last - first + 1
    size = 2 * block
    blocks = x[starts[:, None] + np.arange(block)]
    windows = x[starts[:, None] + first + np.arange(block + lags - 1)]
    left = np.zeros((len(starts), size), dtype=np.uint64)
    right = np.zeros((len(starts), size), dtype=np.uint64)
    left[:, :block] = blocks[:, ::-1]
    right[:, :windows.shape[1]] = windows
    products = _back(_transform(left) * _transform(right) % _P)[:, block - 1:block - 1 + lags]
    own = (blocks * blocks % _P).sum(axis=1) % _P
    running = np.zeros((len(starts), windows.shape[1] + 1), dtype=np.uint64)
    np.cumsum(windows * windows % _P, axis=1, out=running[:, 1:])
    theirs = (running[:, block:] - running[:, :-block])[:, :lags] % _P
    return (own[:, None] + theirs + _P + _P - products - products) % _P


# --- runs of one sequence -------------------------------------------------------------------------

def _distances(block: int) -> tuple[int, int]:
    """The periods whose scale is ``block``: those q with block <= (3 q + 1) / 2 < 2 * block."""
    return max(1, -(-(2 * block - 1) // 3)), -(-(4 * block - 1) // 3) - 1


def _prefix(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the numbers times powers of an odd number (modulo 2^64), and the powers."""
    n = len(x)
    powers = np.ones(n + 1, dtype=np.uint64)
    done = 1
    while done < n + 1:
        piece = min(done, n + 1 - done)
        powers[done:done + piece] = powers[:piece] * np.uint64(pow(_ODD, done, 1 << 64))
        done += piece
    spread = (x + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
    spread ^= spread >> np.uint64(29)
    running = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(spread * powers[:n], out=running[1:])
    return running, powers


def _seeds(x: np.ndarray, grams: np.ndarray, order: np.ndarray, block: int, first: int, last: int):
    """(start, distance) of the blocks that occur again at a distance of the scale, by start.

    ``grams`` numbers the words that begin at each place, ``order`` lists the places by that number.
    """
    n = len(x)
    starts = np.arange(0, n - block - first + 1, block, dtype=np.int64)
    if not len(starts):
        return starts, starts
    # The next place with the same first words at a distance of ``first`` or more, if it is within ``last``.
    keyed = grams[order] * np.int64(n) + order
    at = np.searchsorted(keyed, grams[starts] * np.int64(n) + starts + first)
    near = np.minimum(at, n - 1)
    hit = (at < n) & (keyed[near] <= grams[starts] * np.int64(n) + np.minimum(starts + last, n - 1))
    starts = starts[hit]
    padded = np.concatenate([x, np.arange(1, last + block + 1, dtype=np.uint64) + (x.max() if n else np.uint64(0))])
    found = [], []
    rows = max(1, _CELLS // (2 * block))
    for k in range(0, len(starts), rows):
        part = starts[k:k + rows]
        line, lag = np.nonzero(squared_differences(padded, part, block, first, last) == 0)
        found[0].append(part[line])
        found[1].append(lag + first)
    if not found[0]:
        return starts[:0], starts[:0]
    return np.concatenate(found[0]), np.concatenate(found[1])


def _agreeing(x: np.ndarray, at: int, step: int) -> int:
    """The number of places from ``at`` on whose words equal those ``step`` further on."""
    size, done, most = 64, 0, len(x) - at - step
    while done < most:
        piece = min(size, most - done)
        unlike = x[at + done:at + done + piece] != x[at + done + step:at + done + step + piece]
        if unlike.any():
            return done + int(np.argmax(unlike))
        done += piece
        size *= 4
    return done


def _agreeing_before(x: np.ndarray, at: int, step: int) -> int:
    """The number of places before ``at`` whose words equal those ``step`` further on."""
    size, done = 64, 0
    while done < at:
        piece = min(size, at - done)
        lo = at - done - piece
        unlike = x[lo:lo + piece] != x[lo + step:lo + step + piece]
        if unlike.any():
            return done + int(np.argmax(unlike[::-1]))
        done += piece
        size *= 4
    return done


def _unknown(starts: np.ndarray, gaps: np.ndarray, block: int, found: dict[tuple[int, int], int]) -> np.ndarray:
    """Which seeds do not lie inside a run whose period divides their distance: those would find that run again."""
    new = np.ones(len(starts), dtype=bool)
    if not len(starts):
        return new
    least = block + int(gaps.min())
    for (lo, hi), period in found.items():
        if hi - lo >= least:
            a, b = np.searchsorted(starts, [lo, hi])
            new[a:b] &= (starts[a:b] + gaps[a:b] + block > hi) | (gaps[a:b] % period != 0)
    return new


def runs(x: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of numbers below 2^31, in order of start and period.

    ``longest`` bounds the length of a run; separators between texts are numbers that occur once.
    """
    n = len(x)
    found: dict[tuple[int, int], int] = {}
    if longest < LEAST_WORDS:
        return []
    running, powers = _prefix(x)

    def grams(width):
        """A small number per place for the ``width`` words there (equal words give equal numbers)."""
        values = np.zeros(n, dtype=np.uint64)
        usable = max(0, n - width + 1)
        for k in range(width):
            values[:usable] = values[:usable] * np.uint64(_ODD) + x[k:k + usable] + np.uint64(1)
        values[usable:] = np.arange(n - usable, dtype=np.uint64)
        order = np.argsort(values, kind="stable")
        rank = np.zeros(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(values[order][1:] != values[order][:-1])])
        return rank, order

    block, known = 2, {}
    while True:
        first, last = _distances(block)
        if LEAST_PERIODS * first > longest:
            break
        last = min(last, longest // LEAST_PERIODS)
        width = min(block, 4)
        if width not in known:
            known[width] = grams(width)
        rank, order = known[width]
        starts, gaps = _seeds(x, rank, order, block, first, last)
        new = _unknown(starts, gaps, block, found)
        starts, gaps = starts[new], gaps[new]
        # A run's first block agrees with its next period for at least 3 q - block + 1 words.
        need = 3 * gaps - block + 1
        fits = starts + gaps + need <= n
        starts, gaps, need = starts[fits], gaps[fits], need[fits]
        here = (running[starts + need] - running[starts]) * powers[gaps]
        same = here == running[starts + gaps + need] - running[starts + gaps]
        starts, gaps = starts[same], gaps[same]
        by_gap = np.lexsort((starts, gaps))
        reach, of_gap = -1, -1
        for s, d in zip(starts[by_gap].tolist(), gaps[by_gap].tolist()):
            if d == of_gap and s < reach:
                continue
            lo = s - _agreeing_before(x, s, d)
            hi = s + _agreeing(x, s, d)
            of_gap, reach = d, hi
            if hi + d - lo >= max(LEAST_WORDS, LEAST_PERIODS * d):
                found.setdefault((lo, hi + d), d)
        block *= 2
    return sorted((lo, hi - lo, d) for (lo, hi), d in found.items())


# --- texts ----------------------------------------------------------------------------------------

def planted_period(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document as the query takes them: of every tenth document (by the crc32 of its id) the words
    from a on repeat with period p."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


class _Numbers(dict):
    def __missing__(self, word):
        value = self[word] = len(self)
        return value


def _batch_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each of some texts, found in one sequence with separators."""
    numbers = _Numbers()
    parts = [np.fromiter(map(numbers.__getitem__, words), dtype=np.uint64, count=len(words)) for words in texts]
    separators = np.arange(len(texts), dtype=np.uint64) + np.uint64(len(numbers))
    sequence = np.concatenate([piece for part, k in zip(parts, separators) for piece in (part, np.array([k]))])
    begins = np.concatenate([[0], np.cumsum([len(words) + 1 for words in texts])])
    out = [[] for _ in texts]
    all_runs = runs(sequence, max(map(len, texts)))
    owner = np.searchsorted(begins, [r[0] for r in all_runs], side="right") - 1
    for (start, length, period), k in zip(all_runs, owner.tolist()):
        out[k].append((start - int(begins[k]), length, period))
    return out


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run holds after its first period."""
    if not found:
        return words
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def _strongest(found):
    """The run with the greatest length / period; the smallest start, then period, among equals."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _answer(batch):
    out = {k: [] for k in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs")}
    for (doc_id, words), found in zip(batch, _batch_runs([words for _, words in batch])):
        best = _strongest(found)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        out["doc_id"].append(doc_id)
        out["n_runs"].append(len(found))
        out["start"].append(best and best[0])
        out["length"].append(best and best[1])
        out["period"].append(best and best[2])
        out["exponent_milli"].append(best and 1000 * best[1] // best[2])
        out["runs_sha256"].append(hashlib.sha256(listed.encode()).hexdigest())
        out["collapsed_sha256"].append(hashlib.sha256(b" ".join(collapse(words, found))).hexdigest())
        out["runs"].append([v for run in found for v in run])
    return out


def _batches(held):
    """Pairs (key, words) in lists of about ``WORDS_AT_ONCE`` words."""
    batch, size = [], 0
    for key, words in held:
        if batch and size + len(words) > WORDS_AT_ONCE:
            yield batch
            batch, size = [], 0
        batch.append((key, words))
        size += len(words)
    if batch:
        yield batch


def find_runs(docs: DataFrame, prepare=lambda words, doc_id: words) -> DataFrame:
    """One row per input row: doc_id, n_runs, the strongest run, digests of all runs and of the text without
    repeated periods, and ``runs``: start, length and period of each run in turn.

    ``prepare`` (words, doc_id) -> words may change a text's words first.
    """
    def run(slices):
        held = ((doc_id, prepare(text.split(), doc_id)) for part in slices
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()))
        for batch in _batches(held):
            yield _answer(batch)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    return map_rows(source, run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
                                 "runs_sha256 string, collapsed_sha256 string, runs array<long>")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) with texts that lose the repeated periods of their runs.

    The words of a text with runs are joined by one space; other texts stay as they are.
    """
    names = docs.columns
    place = names.index("text")

    def run(batches):
        for rows in rows_of(batches):
            old = rows.column(place).to_pylist()
            new = []
            for batch in _batches((text, (text or "").encode().split()) for text in old):
                for (text, words), found in zip(batch, _batch_runs([words for _, words in batch])):
                    new.append(b" ".join(collapse(words, found)).decode() if found else text)
            yield rows.set_column(place, rows.schema.field(place), pa.array(new, rows.schema.field(place).type))
        give_back()

    _reachable(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
