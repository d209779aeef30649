"""Byte-level BPE encoding and decoding with reuse of content-defined chunks.

1. *Chunks.*  A text is cut where a rolling hash of its last 16 characters meets a mask, so equal
   passages are cut alike wherever they stand.  Only hashes of chunks are shuffled: they show which
   chunks occur again (in any document) and which occurrence owns each.
2. *Encode once.*  A chunk that occurs again is encoded by its owner; its ids go to the other
   documents by a join.  A chunk that occurs once is encoded where its document is put together.
3. *Joins.*  A chunk encoded alone can differ at its ends from the same place in a document.  Each
   chunk keeps apart its head (up to its first safe place), body and tail (from its last safe place).
   At a join, tail and head are re-encoded together, from safe place to safe place; the ids agree
   with the whole text's there, as the vocabulary's split cannot look across a safe place (see
   ``tokens``).  A chunk without any safe place extends the window into the next chunk, and so on,
   until both ends are safe.

The ids are those of encoding the whole text; strings of special tokens in a text become the special
ids, as the tokenizers library does by default (such a string never holds white space, so it lies
within one part).  Decoding maps ids back to bytes and reads them as UTF-8.
"""

from __future__ import annotations

import hashlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierbook.llm.common import map_rows, pin, text_or_empty
from carrierbook.llm.tokens import SEGMENT, byte_ids, vocabulary

CHUNK_MASK = 0x3FF       # one cut in 1024 characters on average ...
CHUNK_LEAST, CHUNK_MOST = 256, 8192  # ... but chunks have so many characters
MEMO_PARTS = 600_000     # parts whose ids a worker remembers; it decodes as well, and shares its memory with the texts
TEXTS_AT_ONCE = 64       # texts that a worker takes apart at a time


def chunks(text: str) -> list[str]:
    """The content-defined chunks of a text, in order."""
    if len(text) <= CHUNK_LEAST:
        return [text] if text else []
    h = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    factor = 0x9E3779B97F4A7C15
    for width in (1, 2, 4, 8):  # hashes of 2, 4, 8, then 16 characters
        h[width:] = h[width:] + h[:-width] * np.uint64(pow(factor, width, 1 << 64))
    cuts = (np.flatnonzero((h >> np.uint64(40) & np.uint64(CHUNK_MASK)) == 0) + 1).tolist()
    out, last = [], 0
    for cut in [*cuts, len(text)]:
        while cut - last > CHUNK_MOST:
            out.append(text[last:last + CHUNK_MOST])
            last += CHUNK_MOST
        if cut - last >= CHUNK_LEAST or cut == len(text) and cut > last:
            out.append(text[last:cut])
            last = cut
    return out


def split_ends(chunk: str) -> tuple[str, list[str], str] | None:
    """Head, parts of the body, tail; None without a safe place.

    Safe places are before white space that follows a non-space.  The first part may continue what
    the chunk before ends with, the last part may go on in the next chunk.
    """
    parts = SEGMENT.findall(chunk)
    if len(parts) < 2:
        return None
    return parts[0], parts[1:-1], parts[-1]


# --- shared chunks --------------------------------------------------------------------------------

def _hash(chunk: str) -> tuple[int, int]:
    digest = hashlib.blake2b(chunk.encode(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _occurrences(slices):
    for rows in slices:
        out = {k: [] for k in ("doc_id", "text_hash", "n", "c1", "c2")}
        for doc_id, text_hash, text in zip(*(rows.column(k).to_pylist() for k in ("doc_id", "text_hash", "text"))):
            for n, chunk in enumerate(chunks(text)):
                c1, c2 = _hash(chunk)
                for k, v in zip(out, (doc_id, text_hash, n, c1, c2)):
                    out[k].append(v)
        yield out


def _squeeze(slices):
    """Texts compressed for their one shuffle."""
    pack = zstandard.ZstdCompressor(level=1)
    for rows in slices:
        yield {"doc_id": rows.column("doc_id"), "text_hash": rows.column("text_hash"),
               "packed": [pack.compress(t.encode()) for t in rows.column("text").to_pylist()]}


def _owned(slices, path):
    """The ids of owned chunks: ends apart, ids of the body."""
    unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    for rows in slices:
        vocab = vocabulary(path, MEMO_PARTS)
        keys, bodies = [], []
        for packed, owned in zip(rows.column("packed").to_pylist(), rows.column("owned").to_pylist()):
            cut = chunks(unpack.decompress(packed).decode()) if owned else []
            for one in owned or []:
                ends = split_ends(cut[one["n"]])
                if ends is not None:
                    keys.append((one["c1"], one["c2"]))
                    bodies.append(ends[1])
        ids = [pack.compress(b) for b in vocab.join(bodies)]
        yield {"c1": [k[0] for k in keys], "c2": [k[1] for k in keys], "ids": ids}


def _assembled(slices, path, with_ids):
    unpack = zstandard.ZstdDecompressor()
    for rows in slices:
        vocab = vocabulary(path, MEMO_PARTS)
        plans, fresh = [], []  # per document: bytes of known bodies, or places in ``fresh``
        for packed, known in zip(rows.column("packed").to_pylist(), rows.column("known").to_pylist()):
            ready = {one["n"]: one["ids"] for one in known or []}
            plan, open_text = [], ""
            for n, chunk in enumerate(chunks(unpack.decompress(packed).decode())):
                ends = split_ends(chunk)
                if ends is None:  # no safe place: the window goes on
                    open_text += chunk
                    continue
                fresh.append(SEGMENT.findall(open_text + ends[0]))
                plan.append(len(fresh) - 1)
                if n in ready:
                    plan.append(unpack.decompress(ready[n]))
                else:
                    fresh.append(ends[1])
                    plan.append(len(fresh) - 1)
                open_text = ends[2]
            fresh.append(SEGMENT.findall(open_text))
            plan.append(len(fresh) - 1)
            plans.append(plan)
        coded = vocab.join(fresh)
        ids = [b"".join(x if isinstance(x, bytes) else coded[x] for x in plan) for plan in plans]
        out = {"doc_id": rows.column("doc_id"), "n_tokens": [len(b) // 4 for b in ids],
               "ids_sha256": [hashlib.sha256(b).hexdigest() for b in ids],
               "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in vocab.decode(ids)]}
        if with_ids:
            out["ids"] = ids
        yield out


def encode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, digests of the ids and of the decoded text (and the ids)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"),
                         text_or_empty().alias("text"))
    met = pin(map_rows(source, _occurrences, "doc_id long, text_hash long, n long, c1 long, c2 long"))
    tagged = met.withColumn("tag", F.xxhash64("doc_id", "text_hash", "n"))
    again = (tagged.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("times"), F.min("tag").alias("owner"))
             .where("times > 1").drop("times"))
    shared = pin(tagged.join(again, ["c1", "c2"]).select("doc_id", "text_hash", "n", "c1", "c2",
                                                         (F.col("tag") == F.col("owner")).alias("owns")))
    texts = map_rows(source, _squeeze, "doc_id long, text_hash long, packed binary")
    owned = (shared.where("owns").groupBy("doc_id", "text_hash")
             .agg(F.collect_set(F.struct("n", "c1", "c2")).alias("owned")))
    # Both joins are left joins, so that their exchanges of the texts are one and the same.
    first = _on_row(texts, owned, "left").select("packed", "owned")
    coded = map_rows(first, lambda s: _owned(s, path), "c1 long, c2 long, ids binary", TEXTS_AT_ONCE).dropDuplicates(["c1", "c2"])
    known = (shared.join(coded, ["c1", "c2"]).groupBy("doc_id", "text_hash")
             .agg(F.collect_set(F.struct("n", "ids")).alias("known")))
    whole = _on_row(texts, known, "left").select("doc_id", "packed", "known")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if with_ids else "")
    return map_rows(whole, lambda s: _assembled(s, path, with_ids), schema, TEXTS_AT_ONCE)


def _on_row(texts: DataFrame, listed: DataFrame, how: str) -> DataFrame:
    """Join on (doc_id, text hash); rows that repeat both have the same ids, so they may share them."""
    keyed = listed.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    return texts.join(keyed, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), how)


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """doc_id and the text of its ids (4 bytes each); null ids give a null text."""
    def texts(slices):
        for one in slices:
            vocab = vocabulary(path, MEMO_PARTS)
            given = one.column("ids").to_pylist()
            found = vocab.decode([b or b"" for b in given])
            yield {"doc_id": one.column("doc_id"), "text": [None if b is None else t for b, t in zip(given, found)]}

    return map_rows(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(ids).alias("ids")), texts, "doc_id long, text string")
