"""Encoding, packing, exact and near copies, each against a brute-force version."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from carrierbook.llm import bpe, exact_dedup, ngram_join, packing, tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def _same_rows(found, expected):
    assert Counter(tuple(r) for r in found) == Counter(expected)


# --- op 1 -----------------------------------------------------------------------------------------

def _encoded(rows):
    tokenizer = Tokenizer.from_file(BYTES)
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        yield (doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
               hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_bpe_equals_the_library(request, table):
    df = request.getfixturevalue(table)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    _same_rows(bpe.encode(df, BYTES).collect(), _encoded(rows))


def test_bpe_decode_round_trip(odd):
    encoded = bpe.encode(odd, BYTES, with_ids=True)
    back = Counter((r["doc_id"], r["text"]) for r in bpe.decode(encoded, BYTES).collect())
    assert back == Counter((r["doc_id"], r["text"] or "") for r in odd.select("doc_id", "text").collect())


def test_chunks_are_cut_by_content():
    import random

    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    one, two = bpe.chunks("start " * 100 + passage), bpe.chunks(passage + " end")
    assert "".join(one) == "start " * 100 + passage and len(set(one) & set(two)) > 5


# --- op 2 -----------------------------------------------------------------------------------------

def _components(rows):
    sets = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset())
    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j, both in Counter(j for g in s for j in holders[g] if j < i).items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(rows[i][0], len(s), least.get(find(i)) if s else rows[i][0]) for i, s in enumerate(sets)]


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_ngram_components(request, table):
    df = request.getfixturevalue(table)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    found = ngram_join.similarity_components(df).select("doc_id", "n_shingles", "component_id").collect()
    _same_rows(found, _components(rows))


def test_ngram_chain_and_common_passage(spark, monkeypatch):
    """A chain of near copies is one component, texts sharing one passage are not; pivots lose nothing."""
    import random

    monkeypatch.setattr(ngram_join, "PIVOTS", 4)
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(40):
        words = words[1:] + [f"n{k}"] if k else words
        rows.append((k, " ".join(words)))
    passage = " ".join(f"p{k}" for k in range(40))
    for k in range(40, 90):
        rows.append((k, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(60))))
    base = [f"b{k}" for k in range(200)]
    for k in range(90, 150):
        copy = list(base)
        for _ in range(rng.randrange(1, 9)):
            copy[rng.randrange(200)] = f"z{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (1_000_000, 0):  # the order of the shingles does not change the result
        found = ngram_join.similarity_components(df, frequent_most=most).select("doc_id", "n_shingles", "component_id").collect()
        _same_rows(found, _components(rows))
    kept = {r["doc_id"] for r in ngram_join.keep_one(df).collect()}
    assert kept == {c for _, _, c in _components(rows)}


# --- op 10 ----------------------------------------------------------------------------------------

def _copies(rows):
    delete = re.compile(r"[\x20\x09-\x0D]")
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(delete.sub("", text or ""), []).append((-len(text or ""), doc_id is None, doc_id))
    for doc_id, text in rows:
        normal = delete.sub("", text or "")
        best = min(groups[normal], key=lambda x: (x[0], x[1], x[2] or 0))
        yield (doc_id, best[2], len(groups[normal]), doc_id == best[2] and -len(text or "") == best[0],
               hashlib.sha256(normal.encode()).hexdigest())


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_exact_dedup(request, table):
    df = request.getfixturevalue(table)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    _same_rows(exact_dedup.membership(df).collect(), _copies(rows))


def test_exact_dedup_keeps_one_row_per_text(odd):
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns
    normal = Counter(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in kept.collect())
    everything = {re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in odd.collect()}
    assert set(normal) == everything and set(normal.values()) == {1}


# --- op 9 -----------------------------------------------------------------------------------------

@pytest.mark.parametrize("table", ["docs", "odd"])
def test_packing(request, table):
    df = request.getfixturevalue(table)
    rows = packing.pack(df, WORDS, with_ids=True).toPandas()
    tokenizer = Tokenizer.from_file(WORDS)
    expected = Counter()
    for r in df.select("doc_id", "text").collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        for start in range(0, len(ids), 4096):
            part = ids[start:start + 4096].tobytes()
            expected[(r["doc_id"], start, len(part) // 4, zlib.crc32(part), len(ids))] += 1
    found = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows.itertuples())
    assert found == expected
    for _, one in rows.sort_values("offset").groupby("sequence_id"):
        assert (one.offset == one.length.cumsum() - one.length).all() and one.length.sum() <= 4096
    assert sorted(rows.sequence_id.unique()) == list(range(rows.sequence_id.nunique()))


def test_packing_plan_uses_every_piece():
    rng = np.random.default_rng(4)
    histogram = np.bincount(rng.integers(1, 4097, 50_000), minlength=4097)
    made = packing.plan(histogram)
    used = np.zeros_like(histogram)
    for lengths, times in made:
        assert sum(lengths) <= 4096 and times > 0
        for n in lengths:
            used[n] += times
    assert (used == histogram).all()
    assert sum(t for _, t in made) * 4096 <= 1.005 * (histogram * np.arange(4097)).sum()


def test_empty_tables(odd):
    empty = odd.limit(0)
    assert bpe.encode(empty, BYTES).count() == 0
    assert ngram_join.similarity_components(empty).count() == 0
    assert exact_dedup.membership(empty).count() == 0 and exact_dedup.deduplicate(empty).count() == 0
    assert packing.pack(empty, WORDS).count() == 0


def test_foreign_vocabulary_is_refused(tmp_path):
    from tokenizers import Tokenizer, pre_tokenizers

    other = Tokenizer.from_file(BYTES)
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    other.save(str(tmp_path / "other.json"))
    with pytest.raises(ValueError, match="splits"):
        tokens.Vocabulary(str(tmp_path / "other.json"))


def test_word_ids_of_odd_texts():
    vocab = tokens.Vocabulary(WORDS)
    rng = random.Random(5)
    pieces = ["it's", "a.b,c", "Ωσ.", "ΑΣ,", "é.", "e\u0301.", "ß!", "İ.", "<|endoftext|>", "<|ENDOFTEXT|>", "x<|endoftext|>.", " ", "\x85", "\x1c",
              "\u3000", "\n", "12.5%", "don't.'s", "ﬁ,", "日本.", "I'LL;", "#a#b", "\x0b"]
    texts = ["", " \t\n", *("".join(rng.choice(pieces) + rng.choice(["", " ", "  "]) for _ in range(rng.randrange(1, 30))) for _ in range(800))]
    found = tokens.word_ids(vocab, pa.array(texts))
    for text, ids in zip(texts, found):
        assert np.frombuffer(ids, dtype="<u4").tolist() == vocab.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
