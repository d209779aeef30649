"""Toxicity classifier, ranked search and periodic runs, each against held-out labels or a brute-force version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from carrierbook.llm import lexical_search, periodic_runs, toxicity

# --- op 11 ----------------------------------------------------------------------------------------


def _toxic_rows(n=900, seed=5):
    """Invented prose; a third of the documents holds words made from toxic stems."""
    rnd = random.Random(seed)
    parts = ["an", "er", "th", "on", "es", "ti", "re", "ou", "ing", "ly"]
    word = lambda: "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rnd.randint(5, 300))]
        toxic = rnd.random() < 0.3
        for _ in range(rnd.randint(2, 4) if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(["vrakk", "zumpf", "qolb"]) + rnd.choice(parts))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_documents(spark):
    rows, labels = _toxic_rows()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.train(docs, marks)).collect()}
    truth = dict(labels)
    assert len(got) == len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
               for i, r in got.items())
    out = [i for i, r in got.items() if r["held_out"]]
    caught = [got[i]["predicted"] for i in out if truth[i]]
    wrong = [got[i]["predicted"] for i in out if not truth[i]]
    assert np.mean(caught) > 0.9 and np.mean(wrong) < 0.02
    # Labels of held-out rows are never looked at.
    turned = spark.createDataFrame([(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels], "doc_id long, toxic int")
    again = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.train(docs, turned)).collect()}
    assert max(abs(again[i] - got[i]["score"]) for i in got) < 1e-9


def test_toxicity_odd_rows_and_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(odd, toxicity.train(odd, none)).collect()} == {0.5}
    ids = [i for i in (1, 2, 3, 7, 8, 9, 10, 11, 12, 13, 14) if zlib.crc32(str(i).encode()) % 5]
    one = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, toxic int")
    scores = {r["score"] for r in toxicity.score(odd, toxicity.train(odd, one)).collect()}
    assert len(scores) == 1 and scores.pop() > 0.7
    mixed = spark.createDataFrame([(i, i % 2) for i in ids] + [(None, 1), (ids[0], None), (ids[0], 0)], "doc_id long, toxic int")
    rows = toxicity.score(odd, toxicity.train(odd, mixed)).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(odd.limit(0), toxicity.train(odd.limit(0), mixed)).count() == 0


def test_features_are_the_ngrams_of_distinct_words(monkeypatch):
    rnd = random.Random(1)
    text = " ".join("".join(rnd.choice("abcdeß日") for _ in range(rnd.randint(1, 9))) for _ in range(400))
    grams = {g for w in {f" {w} " for w in text.lower().split()} for n in toxicity.SIZES for g in (w[i:i + n] for i in range(len(w) - n + 1))}
    whole = toxicity.features(text)
    assert 0.98 * len(grams) <= len(whole) <= len(grams) and list(whole) == sorted(set(whole.tolist()))
    monkeypatch.setattr(toxicity, "_PIECE", 97)
    assert np.array_equal(toxicity.features(text), whole)
    wanted = np.zeros(toxicity.DIMS, dtype=bool)
    wanted[whole[::3]] = True
    assert np.array_equal(toxicity.features(text, wanted), whole[::3])
    assert len(toxicity.features("")) == 0 == len(toxicity.features(" \n"))


def test_lbfgs_finds_the_minimum():
    rnd = np.random.default_rng(3)
    a = rnd.normal(size=(30, 6))
    target = rnd.normal(size=30)
    x = toxicity._minimise(lambda v: (float(np.sum((a @ v - target) ** 2)), 2 * a.T @ (a @ v - target)), np.zeros(6), 200)
    assert np.allclose(x, np.linalg.lstsq(a, target, rcond=None)[0], atol=1e-3)


# --- op 12 ----------------------------------------------------------------------------------------

_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _terms(text):
    return _TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _ranked(docs, items, top):
    held = [(i, Counter(t), len(t)) for i, t in ((i, _terms(t)) for i, t in docs) if t]
    n_all, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc_id, counts, n in held:
            m = 100 - 25 + (25 * n * n_all) // length
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10 ** 9 * counts[t]) // (1000 * counts[t] + 12 * m))
                        for t in _terms(text) if t in counts)
            if score > 0 and doc_id is not None:
                scored.append((-score, doc_id))
        out += [(item, k + 1, doc_id, -s) for k, (s, doc_id) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def _rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture
def small_blocks(monkeypatch):
    """Several blocks per stratum, several groups of queries, few first visits."""
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 7)
    monkeypatch.setattr(lexical_search, "FIRST_VISITS", 2)
    monkeypatch.setattr(lexical_search, "TERMS_AT_ONCE", 400)


@pytest.mark.parametrize("top", [1, 20])
def test_search_equals_brute_force(spark, docs, small_blocks, top):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    asked = [(r["item_id"], r["text"]) for r in items.collect()]
    assert _rows(lexical_search.rank(docs, items, top)) == _ranked(rows, asked, top)


def test_search_with_a_whole_index(spark, docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(5)
    index = lexical_search.build_index(docs)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert _rows(lexical_search.search(index, items, 3)) == _ranked(rows, [(r["item_id"], r["text"]) for r in items.collect()], 3)


def test_search_of_odd_rows(spark, odd, small_blocks):
    items = spark.createDataFrame(
        [(1, "Two ALPHA beta", 0), (2, None, 0), (3, "", 0), (4, "one one one ten", 0), (5, "nowhere", 0), (6, "日本語 don't CAFÉ café", 0), (None, "two", 0),
         (7, "text of a row", 0), (7, "text of a row", 0), (8, "x" * 50_000, 0)], "item_id long, text string, score int")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert _rows(lexical_search.rank(odd, items)) == _ranked(rows, [(r["item_id"], r["text"]) for r in items.collect()], 20)
    assert lexical_search.rank(odd.limit(0), items).count() == 0 == lexical_search.rank(odd, items.limit(0)).count()
    assert lexical_search.rank(odd, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


# --- op 13 ----------------------------------------------------------------------------------------

def _brute_runs(words):
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((a, b, q) for (a, b), q in out.items())


def _run_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = _brute_runs(words)
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(kept))


@pytest.mark.parametrize("words_at_once", [50, 400_000])
def test_runs_equal_brute_force(docs, monkeypatch, words_at_once):
    monkeypatch.setattr(periodic_runs, "WORDS_AT_ONCE", words_at_once)
    short = docs.where("length(text) < 4000")
    got = sorted(tuple(r)[:-1] for r in periodic_runs.find_runs(short, periodic_runs.planted_period).collect())
    want = sorted(_run_row(r["doc_id"], r["text"]) for r in short.collect())
    assert got == want and sum(r[1] for r in got) > 0


def test_runs_of_sequences():
    rnd = random.Random(5)
    for _ in range(300):
        texts = []
        for _ in range(rnd.randint(1, 6)):
            k, n = rnd.choice([1, 2, 2, 3, 5, 50]), rnd.choice([0, 1, 5, 6, 8, 30, 100, 300])
            words = [b"%d" % rnd.randrange(k) for _ in range(n)]
            for _ in range(rnd.randint(0, 3) if n > 10 else 0):
                a = rnd.randrange(n)
                p = rnd.randint(1, max(1, (n - a) // 3))
                for i in range(a, min(n, a + rnd.randint(2, 9) * p)):
                    words[i] = words[a + (i - a) % p]
            texts.append(words)
        assert periodic_runs._batch_runs(texts) == [_brute_runs(w) for w in texts]


def test_long_periodic_texts_stay_fast():
    for words in ([b"a"] * 200_000, [b"a", b"b", b"c"] * 50_000):
        period = len(set(words))
        assert periodic_runs._batch_runs([words]) == [[(0, len(words), period)]]


@pytest.mark.parametrize("block", [2, 4, 16, 64])
def test_squared_differences_are_exact(block):
    rnd = np.random.default_rng(block)
    first, last = periodic_runs._distances(block)
    x = rnd.integers(0, 5 if block < 16 else 1 << 30, 10 * block + last).astype(np.uint64)
    starts = np.array([0, block, 3 * block])
    got = periodic_runs.squared_differences(x, starts, block, first, last)
    for row, s in zip(got, starts):
        for d, value in zip(range(first, last + 1), row):
            want = sum((int(a) - int(b)) ** 2 for a, b in zip(x[s:s + block], x[s + d:s + d + block]))
            assert int(value) == want % 2013265921


def test_runs_of_odd_rows(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    short = [r for r in rows if len(r[1] or "") < 5000]
    got = {}
    for r in periodic_runs.find_runs(odd, periodic_runs.planted_period).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[:-1])
    for doc_id, text in short:
        assert _run_row(doc_id, text) in got[doc_id]
    assert sum(map(len, got.values())) == len(rows) and periodic_runs.find_runs(odd.limit(0)).count() == 0
    long_text = next(r for r in periodic_runs.find_runs(odd).collect() if r["doc_id"] == 7)
    assert (long_text["n_runs"], long_text["period"], long_text["start"], long_text["length"]) == (1, 10, 0, 40_000)


def test_texts_without_repeats(odd):
    after = {r["doc_id"]: r for r in periodic_runs.without_repeats(odd).collect()}
    before = {r["doc_id"]: r for r in odd.collect()}
    assert after[7]["text"] == "one two three four five six seven eight nine ten"
    assert after[8]["text"].endswith("ten tail") and after[5]["text"] is None and after[14] == before[14] and after[13] == before[13]
