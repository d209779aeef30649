"""Personal data: patterns, and an information-theoretic search for terms that give an entity away.

Base spans (e-mail, IPv4, payment card, phone) are leftmost and non-overlapping per kind.  Every
base value is a protected entity.  The method then asks, over the whole corpus, how strongly the
terms beside an entity reveal it (C-sanitisation, Sanchez and Batet, 2016):

    information of an entity   IC(e) = log2(N / df(e))
    co-occurrence              PMI(t, e) = log2(N * df(t, e) / (df(t) * df(e)))

with df counting distinct texts, so that copies change nothing (df(t, e): t stands within ``REACH``
words of e).  A term discloses e when PMI(t, e) >= ``DISCLOSURE`` * IC(e), that is when df(t) is at
most df(t, e) * (N / df(e)) ^ (1 - ``DISCLOSURE``), and the pair is seen in ``LEAST_SUPPORT`` texts at
least; entities of a single text are judged too.  Every occurrence of the term, near or far, in each
document that holds e is added with kind ``term``.  ``sanitise`` replaces base values by their kind,
and disclosing terms by a more general one (their shape class), or removes them when they alone
identify the entity (they occur nowhere else).

Terms are runs of three or more letters, compared in lower case.  Null texts are empty.  Only
documents with an entity have their text stored and shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierbook.llm.common import join_sized, map_rows, pin, stored, text_or_empty

KINDS = ("email", "ip", "card", "phone", "term")
REACH = 8
DISCLOSURE = 0.75
LEAST_SUPPORT = 1
_COPIED_SENT = 200_000  # copied texts whose counts are sent to every task; beyond, a shuffled join
_FLUSH = 400_000  # distinct terms counted in a task before they are handed on

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


def _emails(text: str):
    """Leftmost matches of local@domain, found from each @ to its left in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, sorted."""
    found = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def entity(text: str, span: tuple[int, int, int]) -> str:
    """What makes two mentions the same entity: the kind, and the value without its punctuation."""
    start, kind, end = span
    value = text[start:end].lower()
    if kind >= 2:
        value = "".join(c for c in value if c.isdigit())
    return f"{KINDS[kind]}:{value}"


def _terms(text: str) -> list[str]:
    """The terms in lower case.  These two letters change their form by what stands around them."""
    if "\u0130" in text or "\u03a3" in text:
        return [t.lower() for t in _TERM.findall(text)]
    return _TERM.findall(text.lower())


def _outside(words: list[re.Match], starts: list[int], ends: list[int]) -> list[bool]:
    """Which of the words lie outside all spans, given by their sorted starts."""
    reached = list(accumulate(ends, max))  # the furthest end of the spans so far
    found = []
    for m in words:
        before = bisect_left(starts, m.end())
        found.append(not before or reached[before - 1] <= m.start())
    return found


def _beside(text: str, spans: list[tuple[int, int, int]], reach: int) -> list[tuple[str, str]]:
    """Distinct (entity, term) of the terms within ``reach`` words of each span, outside all spans."""
    if not spans:
        return []
    words = list(_TERM.finditer(text))
    outside = _outside(words, [a for a, _, _ in spans], [b for _, _, b in spans])
    starts, ends = [m.start() for m in words], [m.end() for m in words]
    out = {}
    for span in spans:
        name = entity(text, span)
        left, right = bisect_right(ends, span[0]), bisect_left(starts, span[2])
        for k in (*range(max(0, left - reach), left), *range(right, min(len(words), right + reach))):
            if outside[k]:
                out[name, words[k][0].lower()] = None
    return list(out)


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(slices, reach):
    for rows in slices:
        out = {k: [] for k in ("doc_id", "text_hash", "text", "kinds", "starts", "ends", "held", "entities", "terms")}
        for doc_id, text_hash, text in zip(*(rows.column(k).to_pylist() for k in ("doc_id", "text_hash", "text"))):
            spans = base_spans(text)
            near = _beside(text, spans, reach)
            values = (doc_id, text_hash, text if spans else None, [s[1] for s in spans], [s[0] for s in spans], [s[2] for s in spans],
                      list(dict.fromkeys(entity(text, s) for s in spans)), [x[0] for x in near], [x[1] for x in near])
            for k, v in zip(out, values):
                out[k].append(v)
        yield out


def _term_counts(slices):
    """Distinct texts per term, added up within a task: each of n copies counts 1 / n."""
    counts: Counter = Counter()
    for rows in slices:
        for text, copies in zip(rows.column("text").to_pylist(), rows.column("copies").to_pylist()):
            if copies is None:
                counts.update(set(_terms(text)))
            else:
                for term in set(_terms(text)):
                    counts[term] += 1 / copies
        if len(counts) > _FLUSH:
            yield {"term": list(counts.keys()), "n": list(counts.values())}
            counts.clear()
    yield {"term": list(counts.keys()), "n": list(counts.values())}


def _term_rows(slices):
    """One row per text and distinct term."""
    for rows in slices:
        for text_hash, text in zip(rows.column("text_hash").to_pylist(), rows.column("text").to_pylist()):
            terms = list(set(_terms(text)))
            yield {"text_hash": [text_hash] * len(terms), "term": terms}


def _occurrences(slices):
    """The places of the marked terms outside the base spans."""
    for rows in slices:
        out = {k: [] for k in ("text_hash", "term_starts", "term_ends", "alone")}
        for row in rows.to_pylist():
            marked = dict(zip(row["marked"], row["marked_alone"]))
            words = [m for m in _TERM.finditer(row["text"]) if m[0].lower() in marked]
            words = [m for m, free in zip(words, _outside(words, row["starts"], row["ends"])) if free]
            values = (row["text_hash"], [m.start() for m in words], [m.end() for m in words], [marked[m[0].lower()] for m in words])
            for k, v in zip(out, values):
                out[k].append(v)
        yield out


def disclosures(docs: DataFrame, found: DataFrame, mentions: DataFrame, disclosure: float, least_support: int) -> DataFrame:
    """(entity, term, alone, shared) of the terms that disclose an entity; ``alone``: they occur only
    beside it; ``shared``: several texts hold the entity."""
    copied = pin(found.groupBy("text_hash").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    n = found.count() - (copied.agg(F.sum(F.col("copies") - 1)).first()[0] or 0)
    pairs = (mentions.select(F.explode(F.arrays_zip("entities", "terms")).alias("p"))
             .groupBy(F.col("p.entities").alias("entity"), F.col("p.terms").alias("term")).agg(F.count(F.lit(1)).alias("df_both")))
    supported = pin(pairs.where(F.col("df_both") >= least_support))
    of_entity = mentions.select(F.explode("held").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("df_entity"))
    texts = docs.select(text_or_empty().alias("text")).withColumn("text_hash", F.md5("text"))
    texts = join_sized(texts, copied, ["text_hash"], _COPIED_SENT).select("text", "copies")
    of_term = (map_rows(texts, _term_counts, "term string, n double").join(supported.select("term").distinct(), "term", "left_semi")
               .groupBy("term").agg(F.round(F.sum("n")).alias("df_term")))
    scored = supported.join(of_entity, "entity").join(of_term, "term")
    information = F.log2(F.lit(float(n)) / F.col("df_entity"))
    pmi = F.log2(F.lit(float(n)) * F.col("df_both") / (F.col("df_term") * F.col("df_entity")))
    return (scored.where((information > 0) & (pmi >= disclosure * information))
            .select("entity", "term", (F.col("df_term") <= F.col("df_both")).alias("alone"), (F.col("df_entity") > 1).alias("shared")))


def _marks(mentions: DataFrame, told: DataFrame) -> DataFrame:
    """(text_hash, term, alone) of the disclosing terms of the entities a text holds.

    Terms beside the entity meet their pair.  A term that stands apart from the entity here discloses
    it in another text; it is looked for by term, so that an entity of many texts and many terms does
    not pair all of them.
    """
    beside = (mentions.select("text_hash", F.explode(F.arrays_zip("entities", "terms")).alias("p"))
              .select("text_hash", F.col("p.entities").alias("entity"), F.col("p.terms").alias("term"))
              .join(told, ["entity", "term"]).select("text_hash", "term", "alone"))
    spread = told.where("shared and not alone").select("entity", "term")
    holds = pin(mentions.select("text_hash", F.explode("held").alias("entity")).join(spread.select("entity").distinct(), "entity", "left_semi"))
    texts = mentions.select("text_hash", "text").join(holds.select("text_hash").distinct(), "text_hash", "left_semi")
    apart = (map_rows(texts, _term_rows, "text_hash string, term string").join(spread, "term")
             .join(holds, ["text_hash", "entity"], "left_semi").select("text_hash", "term", F.lit(False).alias("alone")))
    return beside.unionByName(apart).groupBy("text_hash", "term").agg(F.max("alone").alias("alone"))


def scan(docs: DataFrame, reach: int = REACH, disclosure: float = DISCLOSURE, least_support: int = LEAST_SUPPORT) -> DataFrame:
    """One row per input row: doc_id, hash of the text, base spans and the disclosing terms' spans as arrays."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("text_hash", F.md5("text"))
    found = stored(map_rows(source, lambda s: _scan(s, reach),
                            "doc_id long, text_hash string, text string, kinds array<int>, starts array<int>, ends array<int>,"
                            "held array<string>, entities array<string>, terms array<string>"))
    mentions = stored(found.where(F.size("kinds") > 0).drop("doc_id", "kinds").dropDuplicates(["text_hash"]))
    told = pin(disclosures(docs, found, mentions, disclosure, least_support))
    marks = _marks(mentions, told).groupBy("text_hash").agg(F.collect_list(F.struct("term", "alone")).alias("m"))
    marked = mentions.select("text_hash", "text", "starts", "ends").join(
        marks.select("text_hash", F.col("m.term").alias("marked"), F.col("m.alone").alias("marked_alone")), "text_hash")
    added = (map_rows(marked, _occurrences, "text_hash string, term_starts array<int>, term_ends array<int>, alone array<boolean>")
             .select(F.col("text_hash").alias("__hash"), F.expr(
                 "transform(term_starts, (a, i) -> struct(a as start, 4 as kind, term_ends[i] as end, alone[i] as alone))").alias("added")))
    base = F.expr("transform(sequence(0, size(kinds) - 1), i -> struct(starts[i] as start, kinds[i] as kind, ends[i] as end, false as alone))")
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,alone:boolean>>)")
    # Most rows hold no entity and need not be shuffled.
    without = found.where(F.size("kinds") == 0).select("doc_id", "text_hash", empty.alias("base"), empty.alias("added"))
    return without.unionByName(
        found.where(F.size("kinds") > 0).select("doc_id", "text_hash", base.alias("base"))
        .join(added, F.col("text_hash") == F.col("__hash"), "left")
        .select("doc_id", "text_hash", "base", F.coalesce("added", empty).alias("added")))


def personal_rows(docs: DataFrame, **rules) -> DataFrame:
    """One row per input row: doc_id, counts per base kind, digest of the base spans, all spans as text."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    text = lambda spans: (f"array_join(transform({spans}, s -> concat_ws(':', element_at(array({names}), s.kind + 1), "  # noqa: E731
                          "cast(s.start as string), cast(s.end as string))), ',')")
    count = lambda k: F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as bigint)")
    return scan(docs, **rules).select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(F.expr(text("base")), 256).alias("base_sha256"),
        F.expr(text("array_sort(concat(base, added))")).alias("spans"))


def _masked(text: str, spans) -> str:
    out, at = [], 0
    for s in spans:
        if s["end"] <= at:
            continue
        if s["start"] >= at:
            out.append(text[at:s["start"]])
            if s["kind"] < 4:
                out.append(f"[{KINDS[s['kind']].upper()}]")
            elif not s["alone"]:
                out.append("[NAME]" if text[s["start"]].isupper() else "[WORD]")
        at = s["end"]
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, **rules) -> DataFrame:
    """doc_id and the sanitised text of every row."""
    spans = scan(docs, **rules).dropDuplicates(["doc_id", "text_hash"]).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.array_sort(F.concat("base", "added")).alias("spans"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("__h", F.md5("text"))
    met = source.join(spans, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash"))).select("doc_id", "text", "spans")

    def run(slices):
        for rows in slices:
            yield {"doc_id": rows.column("doc_id"),
                   "text": [_masked(t, s) for t, s in zip(rows.column("text").to_pylist(), rows.column("spans").to_pylist())]}

    return map_rows(met, run, "doc_id long, text string")
