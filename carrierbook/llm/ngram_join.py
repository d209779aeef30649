"""N-gram Jaccard self-join by grouped prefixes, with the components of its links.

A document's set holds the hashes of its distinct 5-word shingles (words of [^\\x20\\x09-\\x0D]+, A-Z
lower-cased).  Documents link when 100 * |intersection| >= 80 * |union|.

1. *Order.*  Shingles are ordered by (listed as frequent, hash); the list holds at most
   ``frequent_most`` shingles that repeat most within map tasks.  Any fixed order gives the same
   links: the list only keeps common passages out of the prefixes, so that they make no candidates.
2. *Classes and groups.*  Documents with equal sets form a class; classes with equal prefixes (the
   first n - ceil(0.8 n) + 1 shingles) and equal size form a group.  Only groups are indexed.
3. *Group pairs.*  Linked documents share a prefix shingle, so groups meet on prefix shingles.  In
   each shingle's bucket all groups are first paired with one pivot group; group pairs are filtered
   by size and expanded to members.
4. *Verify.*  Member pairs are filtered by an exact upper bound of their intersection from
   parity maps, then compared shingle by shingle.
5. *The rest.*  Components are formed from the links.  Members of one bucket that are already in one
   component need no further comparison, nor does a pivot.  Large buckets whose members lie in several components are
   compared with further pivots, then every pair across components of a bucket is compared.
   No pair is given up: components are those of the full join, without all pairs of a group of copies.

Rows without an id form links among texts but give no component id of their own; the component id is
the smallest id in the component, null if there is none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierbook.llm.common import map_rows, pin, stored, text_or_empty
from carrierbook.llm.components import components, merged
from carrierbook.llm.words import mix, window_hashes, word_hashes

WIDTH = 5
THRESHOLD = 80          # percent
FREQUENT_MOST = 1_000_000  # entries of the frequent-shingle list (8 bytes each), sent to every task
FREQUENT_LEAST = 2      # repeats within map tasks that make a shingle a candidate for the list
PIVOT_ROUNDS = 2        # rounds of pivots in large buckets before the remaining pairs are compared one by one
PIVOTS = 64             # pivots per large bucket and round
HEADS_SENT = 1_000_000  # rows of (id, hash, class) sent to the scan of the texts at most; more are joined by a shuffle
_LOW = (1 << 48) - 1
_MAP_WORDS = 16         # 64-bit words of a parity map at least; a set of n shingles has a map of n bits or more


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; empty without words."""
    return np.unique(window_hashes(word_hashes(text.encode().lower().split()), width))


def _least_common(n: int, threshold: int) -> int:
    """The least intersection that a set of n shingles needs with any set it links to."""
    return -(-n * threshold // 100)


# --- the order ---------------------------------------------------------------------------------

def _repeats(slices, width):
    """Shingles found at least twice in some hundred thousand of a task's shingles, with counts."""
    held, size = [], 0

    def flush():
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        again = counts >= 2
        return {"token": values[again].view(np.int64), "n": counts[again]}

    for rows in slices:
        for text in rows.column("text").to_pylist():
            one = window_hashes(word_hashes(text.encode().lower().split()), width)
            held.append(one)
            size += len(one)
        if size > 4_000_000:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def frequent_shingles(docs: DataFrame, width: int = WIDTH, most: int = FREQUENT_MOST,
                      least: int = FREQUENT_LEAST) -> np.ndarray:
    """The listed shingles, rarest first.  At most ``most`` entries reach the driver."""
    counted = map_rows(docs.select(text_or_empty().alias("text")), lambda s: _repeats(s, width), "token long, n long")
    totals = stored(counted.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    # The least count that leaves at most ``most`` shingles; counts are capped only to find it.
    sizes = dict(totals.groupBy(F.least("n", F.lit(100_000)).alias("n")).count().collect())
    cut, held = 100_001, 0
    for n in sorted(sizes, reverse=True):
        held += sizes[n]
        if held > most:
            break
        cut = n
    top = totals.where(F.col("n") >= cut).toArrow()
    tokens, counts = top["token"].to_numpy(), top["n"].to_numpy()
    return tokens[np.lexsort((tokens, counts))].view(np.uint64)


# --- sets ---------------------------------------------------------------------------------------

def _parity(tokens: np.ndarray) -> list[int]:
    """Bit b is the parity of the tokens that fall on b.

    The number of bits is a power of two, at least the size of the set, so that long texts are told apart
    as well as short ones.  The halves of a map, combined by XOR, are the set's map of half the size.
    """
    size = max(64 * _MAP_WORDS, 1 << (len(tokens) - 1).bit_length())
    bits = np.bincount((tokens >> np.uint64(7) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def _key(tokens: np.ndarray, size: int) -> tuple[int, ...]:
    digest = hashlib.blake2b(tokens.tobytes(), digest_size=8 * size).digest()
    return tuple(np.frombuffer(digest, dtype="<i8").tolist())


def _sets(slices, frequent, width, threshold):
    order = np.argsort(frequent, kind="stable")
    listed = frequent[order]
    seen = set()  # of this task: a set's prefix is handed on once
    for rows in slices:
        out = {k: [] for k in ("doc_id", "text_hash", "n", "set1", "set2", "group_key", "parity", "rare", "often")}
        for doc_id, text_hash, text in zip(*(rows.column(k).to_pylist() for k in ("doc_id", "text_hash", "text"))):
            tokens = shingles(text, width)
            n = len(tokens)
            one = {"doc_id": doc_id, "text_hash": text_hash, "n": n}
            if n:
                take = n - _least_common(n, threshold) + 1
                often = tokens[:0]
                if len(listed):
                    at = np.searchsorted(listed, tokens)
                    at[at == len(listed)] = 0
                    hit = listed[at] == tokens
                    rare = tokens[~hit][:take]
                    if len(rare) < take:
                        often = tokens[hit][np.argsort(order[at[hit]], kind="stable")][:take - len(rare)]
                else:
                    rare = tokens[:take]
                one["set1"], one["set2"] = _key(tokens, 2)
                one["group_key"], = _key(np.concatenate([rare, often]), 1)
                if (one["set1"], one["set2"]) not in seen:
                    seen.add((one["set1"], one["set2"]))
                    one["parity"] = _parity(tokens)
                    one["rare"] = (rare & np.uint64(_LOW)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                    one["often"] = often.view(np.int64)
            for k, values in out.items():
                values.append(one.get(k))
        yield out


def document_sets(docs: DataFrame, frequent: np.ndarray, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """One row per input row: size and key of the set, key of its prefix; the prefix once per task and set."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text"))
    return map_rows(source, lambda s: _sets(s, frequent, width, threshold),
                    "doc_id long, text_hash long, n long, set1 long, set2 long, group_key long, parity array<long>, rare binary, often array<long>")


# --- the index ----------------------------------------------------------------------------------
# Most prefix shingles stand in one set only.  They travel once, packed: per bucket of the hash range
# the sorted low 48 bits as differences, with row numbers, byte planes compressed.  Frequent shingles,
# which could fill a bucket, do not take this way.  Shortened hashes can only add candidates.

def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _packed(slices, buckets):
    pack = zstandard.ZstdCompressor(level=1)
    held, rids, size = [], [], 0

    def flush():
        tokens = np.concatenate(held)
        rid = np.repeat(np.array(rids, dtype=np.uint64), [len(t) for t in held])
        order = np.argsort(tokens, kind="stable")
        tokens, rid = tokens[order], rid[order]
        bucket = tokens * np.uint64(buckets) >> np.uint64(48)
        edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(tokens)]
        out = {"bucket": [], "first": [], "base": [], "data": []}
        for lo, hi in zip(edges, edges[1:]):
            base = int(rid[lo:hi].min())
            out["bucket"].append(int(bucket[lo]))
            out["first"].append(int(tokens[lo]))
            out["base"].append(base)
            steps = np.diff(tokens[lo:hi], prepend=tokens[lo:lo + 1])
            out["data"].append(pack.compress(_planes(steps) + _planes(rid[lo:hi] - np.uint64(base))))
        return out

    for rows in slices:
        for rid, rare in zip(rows.column("rid").to_pylist(), rows.column("rare").to_pylist()):
            wide = np.zeros((len(rare) // 6, 8), dtype=np.uint8)
            wide[:, :6] = np.frombuffer(rare, dtype=np.uint8).reshape(-1, 6)
            held.append(wide.view("<u8").ravel())
            rids.append(rid)
            size += len(rare) // 6
        if size > 1_000_000:
            yield flush()
            held, rids, size = [], [], 0
    if size:
        yield flush()


def _met(slices):
    """Rows that share a shingle, bucket by bucket; shingles with the same rows are told once."""
    unpack = zstandard.ZstdDecompressor()
    now, parts = None, []

    def bucket():
        tokens = np.concatenate([t for t, _ in parts])
        rid = np.concatenate([r for _, r in parts])
        order = np.lexsort((rid, tokens))
        tokens, rid = tokens[order], rid[order]
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        sizes = np.diff(np.append(starts, len(tokens)))
        one, two = (np.add.reduceat(mix(rid * np.uint64(odd)), starts) for odd in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
        several = np.flatnonzero(sizes >= 2)
        _, first = np.unique(np.stack([one[several], two[several], sizes[several].astype(np.uint64)], axis=1), axis=0, return_index=True)
        keep = np.zeros(len(starts), dtype=bool)
        keep[several[first]] = True
        keep = np.repeat(keep, sizes)
        return {"token": tokens[keep].astype(np.int64), "rid": rid[keep].astype(np.int64)}

    for rows in slices:
        for at, first, base, data in zip(*(rows.column(k).to_pylist() for k in ("bucket", "first", "base", "data"))):
            if at != now and parts:
                yield bucket()
                parts = []
            now = at
            raw = unpack.decompress(data)
            half = len(raw) // 2
            parts.append((np.cumsum(_unplanes(raw[:half])) + np.uint64(first), _unplanes(raw[half:]) + np.uint64(base)))
    if parts:
        yield bucket()


def prefix_index(rows: DataFrame) -> DataFrame:
    """(token, rid): rows on prefix shingles, without most of those that stand in one row only."""
    entries = rows.agg(F.sum(F.octet_length("rare") / 6)).first()[0] or 0
    buckets = max(24, int(entries // 4_000_000))
    packed = map_rows(rows.where("rare is not null").select("rid", "rare"), lambda s: _packed(s, buckets),
                      "bucket long, first long, base long, data binary")
    rare = map_rows(packed.repartition(buckets, "bucket").sortWithinPartitions("bucket"), _met, "token long, rid long")
    often = rows.where("often is not null").select(F.explode("often").alias("token"), "rid")
    # Frequent shingles keep their 64 bits; a bit above the low 48 holds the two kinds apart.
    return rare.unionByName(often.select(F.expr("token | (1L << 62)").alias("token"), "rid"))


# --- verification -------------------------------------------------------------------------------

def _verify(slices, width, threshold):
    unpack = zstandard.ZstdDecompressor()
    last, kept = None, None
    for rows in slices:
        out = {"a": [], "b": [], "linked": []}
        for a, b, packed_a, packed_b in zip(*(rows.column(k).to_pylist() for k in ("a", "b", "packed_a", "packed_b"))):
            if a != last:  # pairs come sorted by a: its set is made once
                last, kept = a, np.unique(window_hashes(word_hashes(unpack.decompress(packed_a).split()), width))
            other = np.unique(window_hashes(word_hashes(unpack.decompress(packed_b).split()), width))
            both = len(np.intersect1d(kept, other, assume_unique=True))
            out["a"].append(a)
            out["b"].append(b)
            out["linked"].append(100 * both >= threshold * (len(kept) + len(other) - both))
        yield out


def verify(pairs: DataFrame, docs: DataFrame, rows: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b) of the class pairs whose sets link, pinned.  Only the texts of these pairs are read on and shuffled."""
    pairs = stored(pairs.select("a", "b"))
    if pairs.isEmpty():
        return pairs
    texts = _class_texts(docs, rows, pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct())
    second = texts.select(F.col("cid").alias("b"), F.col("packed").alias("packed_b"))
    first = texts.select(F.col("cid").alias("a"), F.col("packed").alias("packed_a"))
    both = pairs.join(second, "b").join(first, "a").select("a", "b", "packed_a", "packed_b")
    return pin(map_rows(both, lambda s: _verify(s, width, threshold), "a long, b long, linked boolean").where("linked").select("a", "b"))


def _could_link(threshold: int, n1: str = "n1", n2: str = "n2", p1: str = "p1", p2: str = "p2") -> str:
    """Sizes fit, and the parity maps leave room for a large enough intersection.

    Each bit that differs stands for at least one shingle outside the intersection, so
    2 * |intersection| <= n1 + n2 - differing bits; a link needs (100 + t) * |i| >= t * (n1 + n2).
    """
    short = " + ".join(f"bit_count({p1}[{k}] ^ {p2}[{k}])" for k in range(_MAP_WORDS))
    # Sizes that fit differ by less than a factor of two, so the longer map is folded once at most.
    words = f"least(size({p1}), size({p2}))"
    one, two = (f"if(size({p}) = {words}, {p}, zip_with(slice({p}, 1, {words}), slice({p}, {words} + 1, {words}), (x, y) -> x ^ y))"
                for p in (p1, p2))
    long = f"aggregate(zip_with({one}, {two}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    differ = f"if(size({p1}) = {_MAP_WORDS} and size({p2}) = {_MAP_WORDS}, {short}, {long})"
    return (f"100 * least({n1}, {n2}) >= {threshold} * greatest({n1}, {n2}) and "
            f"(100 + {threshold}) * ({n1} + {n2} - ({differ})) >= {2 * threshold} * ({n1} + {n2})")


# --- the join -----------------------------------------------------------------------------------

def similarity_components(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD,
                          frequent_most: int = FREQUENT_MOST) -> DataFrame:
    """One row per input row: doc_id, text_hash, n_shingles, class_id (null without words), component_id."""
    frequent = frequent_shingles(docs, width, frequent_most)
    rows = stored(document_sets(docs, frequent, width, threshold).withColumn("rid", F.monotonically_increasing_id()))
    # A class is named by its first row, a group by its first class.
    classes = (rows.where("n > 0").groupBy("set1", "set2", "n", "group_key")
               .agg(F.min("rid").alias("cid"), F.min("doc_id").alias("least_id")))
    groups = classes.groupBy("group_key", "n").agg(F.min("cid").alias("gid"))
    classes = stored(classes.join(groups, ["group_key", "n"]).select("set1", "set2", "n", "cid", "gid", "least_id"))
    parts = class_components(docs, rows, classes, width, threshold)
    named = (classes.join(parts.withColumnRenamed("node", "cid"), "cid", "left")
             .withColumn("component", F.coalesce("component", "cid")))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    labels = named.join(least, "component").select("set1", "set2", "n", "cid", "component_id")
    return (rows.select("doc_id", "text_hash", "n", "set1", "set2").join(labels, ["set1", "set2", "n"], "left")
            .select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("cid").alias("class_id"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def _class_texts(docs: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, packed): the words of the first row of every wanted class."""
    heads = rows.select("rid", "doc_id", "text_hash").join(wanted.select(F.col("cid").alias("rid")), "rid").select(
        F.col("rid").alias("cid"), F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    heads = stored(heads)
    if heads.count() <= HEADS_SENT:
        heads = F.broadcast(heads)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("h", F.xxhash64("text"))
    met = source.join(heads, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__hash"))).select("cid", "text")
    return stored(map_rows(met, _squeeze, "cid long, packed binary").dropDuplicates(["cid"]))


def _squeeze(slices):
    pack = zstandard.ZstdCompressor(level=3)
    for rows in slices:
        yield {"cid": rows.column("cid"), "packed": [pack.compress(b" ".join(t.encode().lower().split())) for t in rows.column("text").to_pylist()]}


def class_components(docs: DataFrame, rows: DataFrame, classes: DataFrame, width: int, threshold: int) -> DataFrame:
    """(node, component) of the classes that link to another one."""
    member = classes.select("cid", "gid", "n")
    row_group = (rows.where("n > 0").select("rid", "set1", "set2", "n").join(classes, ["set1", "set2", "n"]).select("rid", "gid", "n"))
    met = prefix_index(rows).join(row_group, "rid").select("token", "gid", "n").distinct()
    # Buckets with more than one group; of buckets with the same groups, one is enough.
    met = stored(met)
    kinds = (met.groupBy("token").agg(F.min("gid").alias("lo"), F.max("gid").alias("hi"), F.count(F.lit(1)).alias("m"),
                                      F.sum(F.xxhash64("gid").cast("decimal(38,0)")).alias("s1"),
                                      F.sum(F.xxhash64("gid", F.lit(7)).cast("decimal(38,0)")).alias("s2")).where("lo < hi")
             .groupBy("lo", "hi", "m", "s1", "s2").agg(F.min("token").alias("token")).select("token", "lo"))
    shared = stored(met.join(kinds, "token").select("token", "gid", "n", "lo"))

    # Every class that can be compared: of groups in a bucket, or of groups with several classes.
    several = member.where("cid <> gid").select("gid").distinct()
    open_groups = shared.select("gid").unionByName(several).distinct()
    wanted = stored(member.join(open_groups, "gid", "left_semi"))
    maps = rows.where("parity is not null").select(F.col("rid").alias("cid"), "parity")
    lean = stored(wanted.select("cid", "n").join(maps, "cid"))

    def compare(pairs: DataFrame) -> DataFrame:
        """Class pairs (a < b), filtered by size and parity, then verified."""
        sized = (pairs.join(lean.select(F.col("cid").alias("a"), F.col("n").alias("n1"), F.col("parity").alias("p1")), "a")
                 .join(lean.select(F.col("cid").alias("b"), F.col("n").alias("n2"), F.col("parity").alias("p2")), "b"))
        return verify(sized.where(_could_link(threshold)).select("a", "b"), docs, rows, width, threshold)

    def ordered(pairs: DataFrame, one: str, two: str) -> DataFrame:
        return pairs.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).where("a < b").distinct()

    # Group pairs with the bucket's pivot group (its smallest id), expanded to members of the other
    # group; and every group's members with the group's own head.
    head_n = wanted.where("cid = gid").select(F.col("gid").alias("lo"), F.col("n").alias("lo_n"))
    with_pivot = (shared.where("gid > lo").select("lo", "gid", "n").distinct().join(head_n, "lo")
                  .where(f"100 * least(n, lo_n) >= {threshold} * greatest(n, lo_n)").select("lo", "gid"))
    expanded = with_pivot.join(wanted.select("gid", "cid"), "gid").select("lo", "cid")
    inside = wanted.where("cid <> gid").select(F.col("gid").alias("lo"), "cid")
    labels = components(compare(ordered(expanded.unionByName(inside), "lo", "cid")))

    # What is left: members of one bucket (a shingle, or a group: bit 61) in different components.
    # The pivot has been compared with every other member, so it leaves its bucket; most buckets end there.
    open_rows = (shared.select(F.col("token").alias("key"), "gid", "lo").join(wanted.select("gid", "cid"), "gid").where("cid <> lo").select("key", "cid")
                 .unionByName(wanted.where("cid <> gid").select(F.expr("gid | (1L << 61)").alias("key"), "cid")))
    rule = _could_link(threshold, "l.n", "r.n", "l.parity", "r.parity")
    for attempt in range(PIVOT_ROUNDS + 1):
        marked = (open_rows.select("key", "cid").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
                  .select("key", "cid", F.coalesce("component", "cid").alias("comp")))
        split = stored(marked.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count(F.lit(1)).alias("m"))
                       .where("c1 < c2").select("key", "m"))
        buckets = split.count()
        if not buckets:
            return labels
        # Few buckets stay open as a rule; sent to the rows, they need not be dealt by bucket.
        open_rows = stored(marked.join(F.broadcast(split) if buckets <= HEADS_SENT else split, "key").join(lean, "cid"))
        large = open_rows.where(F.col("m") > 2 * PIVOTS)
        last = attempt == PIVOT_ROUNDS or large.isEmpty()
        # Pairs across components, in their bucket; sizes and parity maps are tested inside the join.
        # Large buckets first compare about PIVOTS members with all: most of their components merge.
        left = open_rows if last else large.where(F.pmod(F.xxhash64("cid", F.lit(attempt)), F.ceil(F.col("m") / PIVOTS)) == 0)
        once = "l.cid < r.cid" if last else "l.cid <> r.cid"
        pairs = left.alias("l").join(open_rows.alias("r"), F.expr(f"l.key = r.key and l.comp <> r.comp and {once} and {rule}"))
        found = verify(ordered(pairs.select(F.col("l.cid").alias("x"), F.col("r.cid").alias("y")), "x", "y"), docs, rows, width, threshold)
        if not found.isEmpty():
            labels = merged(labels, found)
        if last:
            return labels


def keep_one(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with one document of each component, the one with the smallest id.

    Documents without words are linked with nothing and all stay; so do rows without an id.
    """
    found = similarity_components(docs, width, threshold)
    lost = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    gone = stored(lost)
    if gone.count() <= HEADS_SENT:
        gone = F.broadcast(gone)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text_or_empty()) == F.col("__hash"))
    return docs.join(gone, same, "left_anti")
