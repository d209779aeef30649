"""Secret scans: keyword, access-key and hexadecimal patterns, and a battery of randomness tests.

Everything runs in Spark SQL functions.  Pattern spans are leftmost and non-overlapping per kind.
The battery looks at the remaining tokens (20 or more characters of [A-Za-z0-9+/_=-] with a letter
and a digit) and adds spans of kind ``random``:

1. the encoding is inferred from the characters (hex, base32, base36, base64) and gives the alphabet;
2. three tests ask whether the token can be a uniform random string over it: chi-squared on the
   character counts, a runs test on the upper and lower half of the alphabet, and the lag-1 serial
   correlation; the smallest p-value times three must not fall below ``LEAST_RANDOM_P``;
3. the token is tested against ordinary text of its encoding.  base64: prose of n characters gives a
   noncentral chi-squared value whose excess grows with n.  The alphabets of hex, base32 and base36 are
   too small for that; ordinary tokens there are words and numbers, which change between letters
   and digits seldom (``MIXING`` of the places between two characters at most).  The number of changes
   gives a binomial p-value; base32 and base36 join it with the chi-squared one (Fisher's method);
4. false discoveries are controlled over the whole corpus per length band (Benjamini-Hochberg at
   ``ALPHA``), from counts per bin of that p-value, so no ranking passes through one task.

Tokens that touch a pattern span are left to it.  Null texts are empty and have no spans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierbook.llm.common import pin, text_or_empty

KINDS = ("assign", "access", "hex", "random")

# The patterns of the base kinds (letters of the keywords in either case).
ASSIGN = (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
          r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
# No assignment is found without this in the text; it is much cheaper to look for.
ASSIGN_HINT = r"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8}"
# A run that is too short is dropped whole, so the least lengths may stand in the patterns.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"

LEAST_ASSIGNED = 8
ALPHA = 0.01
LEAST_RANDOM_P = 0.001
BANDS = (32, 48, 96)     # lengths at which a new band begins
MIXING = 0.1             # words and numbers of ten characters on average
BLOCK = 64               # matches of a text that are put together at a time
_PER_DECADE, _DECADES = 100, 30
_NO_SPANS = "cast(array() as array<struct<start:int,end:int,kind:int,body:string>>)"

# encoding -> (pattern, alphabet, excess of prose: size * sum of squared character shares - 1).
ENCODINGS = {
    "hex": (r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.13),
    "base32": (r"^[A-Z2-7]+$", "abcdefghijklmnopqrstuvwxyz234567", 0.75),
    "base36": (r"^([0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz", 0.95),
    "base64": (r"^.*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 2.07),
}


def _blocked(items: str, first: str, carry: str, step: str, join: str, around: str = "FOLD") -> str:
    """SQL that folds an array in blocks of ``BLOCK`` items, so that no result grows item by item over all of them.

    ``carry`` is what an item x adds to a running value (joined by ``join``: + or greatest), ``step`` maps
    (acc.at, acc.out, x) to the next struct(at, out), out beginning as ``first`` in each block.  Gives the
    blocks' values of out; ``around`` wraps a block's FOLD.
    """
    cut = f"if(size({items}) = 0, array(), transform(sequence(0, (size({items}) - 1) div {BLOCK}), b -> slice({items}, b * {BLOCK} + 1, {BLOCK})))"
    add = (lambda a, c: f"{a} + {c}") if join == "+" else (lambda a, c: f"greatest({a}, {c})")
    whole = f"transform({cut}, k -> aggregate(k, 0, (a, x) -> {add('a', carry)}))"
    before = (f"aggregate({whole}, struct(0 as at, cast(array() as array<int>) as out), "
              f"(a, w) -> struct({add('a.at', 'w')} as at, concat(a.out, array(a.at)) as out), a -> a.out)")
    fold = f"aggregate(k, struct(before as at, {first} as out), (acc, x) -> {step}, acc -> acc.out)"
    return f"zip_with({cut}, {before}, (k, before) -> {around.replace('FOLD', fold)})"


def _spans(pattern: str, kind: int, hint=None):
    """array<struct<start, end, kind, body>> of a pattern's matches, in code points.

    The text is cut at the matches; the lengths of the pieces and of the matches add up to places.
    """
    text = F.col("__text")
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    pieces = (f"filter(zip_with(regexp_extract_all(__text, '{quoted}', 0), split(__text, '{quoted}', -1), "
              "(m, p) -> struct(m as m, length(p) as gap, length(m) as n)), x -> x.m is not null)")
    step = (f"struct(acc.at + x.gap + x.n as at, concat(acc.out, array(struct(acc.at + x.gap as start, acc.at + x.gap + x.n as end, "
            f"{kind} as kind, x.m as body))) as out)")
    # transform over one item names the pieces, which would else be worked out wherever they are used.
    found = F.expr(f"transform(array({pieces}), pieces -> flatten({_blocked('pieces', _NO_SPANS, 'x.gap + x.n', step, '+')}))[0]")
    return F.when(F.rlike(text, F.lit(hint or pattern)), found).otherwise(F.expr(_NO_SPANS))


def _two_sided(z: str) -> str:
    """P(|Z| >= |z|) for a standard normal Z (Abramowitz and Stegun 26.2.17)."""
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    poly = f"{t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"
    return f"least(1.0D, 2 * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {poly})"


def _upper(z: str) -> str:
    """P(Z >= z)."""
    return f"if({z} >= 0, {_two_sided(z)} / 2, 1 - {_two_sided(z)} / 2)"


def _mixing(e: str) -> str:
    """P(at least ``mixed`` changes in n - 1 places) for a binomial of share ``MIXING``, bounded from above.

    Above the mean the terms of the tail fall faster than a geometric series that begins as they do.
    """
    m, k, q = f"({e}.n - 1)", f"{e}.mixed", MIXING
    first = (f"exp(aggregate(sequence(1, greatest(1, {k})), 0D, (a, i) -> a + ln(({m} - {k} + i) / cast(i as double))) "
             f"+ {k} * ln({q}D) + ({m} - {k}) * ln(1 - {q}D))")
    ratio = f"(({m} - {k}) * {q}D / (({k} + 1) * (1 - {q}D)))"
    return f"if({k} <= {m} * {q}D or {k} = 0, 1D, least(1D, {first} / (1 - {ratio})))"


def _battery() -> str:
    """SQL for __tokens: array of (start, end, length, band, random_p, text_p)."""
    encoding, alphabet, excess = "case", "case", "case"
    for name, (pattern, letters, over) in ENCODINGS.items():
        test = f" when rlike(s.core, '{pattern}')"
        encoding += f"{test} then '{name}'"
        alphabet += f" when e.encoding = '{name}' then '{letters}'"
        excess += f" when e.encoding = '{name}' then {over}D"
    band = "case " + " ".join(f"when n < {b} then {k}" for k, b in enumerate(BANDS)) + f" else {len(BANDS)} end"
    steps = [
        ("s", "__found", "struct(s.start, s.end, translate(rtrim('=', s.body), '-_', '+/') as core)"),
        ("s", None, f"struct(s.start, s.end, {encoding} end as encoding, s.core)"),
        ("e", None, f"struct(e.start, e.end, e.encoding, {alphabet} end as letters, {excess} end as excess, "
                    "if(e.encoding = 'base64', e.core, lower(e.core)) as core)"),
        ("e", None, "struct(e.start, e.end, e.encoding, length(e.core) as n, length(e.letters) as k, e.excess, e.letters, e.core, "
                    "length(e.core) - length(regexp_replace(e.core, '[0-9](?=[^0-9])|[^0-9](?=[0-9])', '')) as mixed, "
                    "transform(split(substring(e.core, 1, length(e.core)), '(?!^)(?!$)'), c -> locate(c, e.letters) - 1) as x)"),
        ("e", None, "struct(e.start, e.end, e.encoding, e.mixed, e.n, e.k, e.excess, e.x, "
                    "aggregate(transform(sequence(0, e.k - 1), i -> size(filter(e.x, v -> v = i))), 0D, (a, c) -> a + c * c) * e.k / e.n - e.n as chi, "
                    "aggregate(e.x, 0D, (a, v) -> a + v) / e.n as mean, size(filter(e.x, v -> v >= e.k / 2)) as high, "
                    "1 + size(filter(sequence(1, e.n - 1), i -> (e.x[i] >= e.k / 2) <> (e.x[i - 1] >= e.k / 2))) as runs)"),
        ("e", None, "struct(e.*, 2D * e.high * (e.n - e.high) / e.n + 1 as runs_mean, "
                    "aggregate(e.x, 0D, (a, v) -> a + (v - e.mean) * (v - e.mean)) as spread, "
                    "aggregate(sequence(1, e.n - 1), 0D, (a, i) -> a + (e.x[i] - e.mean) * (e.x[i - 1] - e.mean)) as lagged)"),
        ("e", None, "struct(e.start, e.end, e.encoding, e.mixed, e.n, "
                    "(pow(greatest(e.chi, 0D) / (e.k - 1), 1D / 3) - (1 - 2D / (9 * (e.k - 1)))) / sqrt(2D / (9 * (e.k - 1))) as z_chi, "
                    "if(e.runs_mean <= 2, -9D, (e.runs - e.runs_mean) / sqrt((e.runs_mean - 1) * (e.runs_mean - 2) / (e.n - 1))) as z_runs, "
                    "if(e.spread = 0, 9D, e.lagged / e.spread * sqrt(e.n)) as z_serial, "
                    "(e.chi - (e.k - 1 + e.excess * e.n)) / sqrt(2D * (e.k - 1 + 2 * e.excess * e.n)) as z_text)"),
        ("e", None, f"struct(e.start, e.end, e.encoding, e.n, e.z_chi, e.z_runs, e.z_serial, greatest(1e-30D, 1 - {_upper('e.z_text')}) as chi_p, "
                    f"greatest(1e-30D, {_mixing('e')}) as mixed_p)"),
    ]
    sql = ""
    for name, source, body in steps:
        sql = f"transform({source or sql}, {name} -> {body.replace('e.*', 'e.start, e.end, e.encoding, e.mixed, e.n, e.k, e.excess, e.x, e.chi, e.mean, e.high, e.runs')})"
    last = (f"struct(e.start as start, e.end as end, e.n as n, {band.replace('n <', 'e.n <')} as band, "
            f"least(1D, 3 * least({_upper('e.z_chi')}, {_two_sided('e.z_runs')}, {_two_sided('e.z_serial')})) as random_p, "
            "case e.encoding when 'base64' then e.chi_p when 'hex' then e.mixed_p "
            "else greatest(1e-30D, least(1D, e.chi_p * e.mixed_p * (1 - ln(e.chi_p * e.mixed_p)))) end as text_p)")
    return f"transform({sql}, e -> {last})"


def _bin(p: str) -> str:
    """The bin of a p-value; its upper edge is 10 ^ -(bin / _PER_DECADE)."""
    return f"cast(least({_DECADES * _PER_DECADE}, floor(-log10({p}) * {_PER_DECADE})) as int)"


def _found(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns ``carry`` with __base (start, kind, end) and __tokens (the battery's values)."""
    texts = docs.select(*carry, text_or_empty().alias("__text"))
    base = F.array_sort(F.transform(F.concat(
        F.filter(_spans(ASSIGN, 0, ASSIGN_HINT), lambda s: F.length(F.regexp_extract(s.body, ASSIGN, 2)) >= LEAST_ASSIGNED),
        _spans(ACCESS, 1), _spans(HEX, 2)), lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end"))))
    tokens = F.when(F.rlike("__text", F.lit("[0-9]")), _spans(TOKEN, 3)).otherwise(F.expr(_NO_SPANS))
    return (texts.withColumn("__base", base).withColumn("__found", tokens)
            .withColumn("__found", F.expr(
                # The spans are named, or the optimiser would work them out anew for every token.
                "transform(array(__base), base -> filter(__found, t -> rlike(t.body, '[0-9]') and rlike(t.body, '[A-Za-z]') and length(rtrim('=', t.body)) >= 20 "
                "and not exists(base, b -> b.start < t.end and t.start < b.end)))[0]"))
            .withColumn("__tokens", F.when(F.size("__found") > 0, F.expr(_battery())))
            .drop("__text", "__found"))


def _discoveries(found: DataFrame, cut: dict[int, int]) -> DataFrame:
    """__tokens replaced by __random, the spans of those that pass."""
    allowed = " or ".join(f"(t.band = {band} and {_bin('t.text_p')} >= {least})" for band, least in sorted(cut.items())) or "false"
    return found.withColumn("__random", F.expr(
        f"transform(filter(coalesce(__tokens, array()), t -> t.random_p >= {LEAST_RANDOM_P}D and ({allowed})), "
        "t -> struct(t.start as start, 3 as kind, t.end as end))")).drop("__tokens")


def _cuts(found: DataFrame, alpha: float) -> dict[int, int]:
    """Per length band the first bin whose tokens are discoveries: at most one row per band is read."""
    tokens = found.where("__tokens is not null").select(F.explode("__tokens").alias("t"))
    bins = tokens.groupBy("t.band", F.expr(_bin("t.text_p")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    best = bins.alias("x").join(bins.alias("y"), F.expr("x.band = y.band and y.bin >= x.bin")).groupBy("x.band", "x.bin").agg(F.sum("y.n").alias("found"))
    whole = bins.groupBy("band").agg(F.sum("n").alias("all"))
    steps = best.join(whole, "band").where(f"pow(10D, -bin / {_PER_DECADE}D) <= {alpha}D * found / all")
    return {r["band"]: r["first"] for r in steps.groupBy("band").agg(F.min("bin").alias("first")).collect()}


def _listed(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return (f"array_join(transform({spans}, s -> concat_ws(':', element_at(array({names}), s.kind + 1), "
            "cast(s.start as string), cast(s.end as string))), ',')")


def secret_rows(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """One row per input row: doc_id, counts per base kind, digest of the base spans, all spans as text."""
    found = pin(_found(docs, ["doc_id"]))
    found = _discoveries(found, _cuts(found, alpha))
    count = lambda k: F.expr(f"cast(size(filter(__base, s -> s.kind = {k})) as bigint)")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.expr(_listed("__base")), 256).alias("base_sha256"),
        F.expr(_listed("array_sort(concat(__base, __random))")).alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]", alpha: float = ALPHA) -> DataFrame:
    """``docs`` with every span replaced by ``mask``; n_chars, where present, follows the text.

    Spans that overlap are masked together.  Rows without spans are unchanged.
    """
    names = docs.columns
    # Texts are scanned twice (for the corpus's cuts, then to mask) rather than stored once more.
    cut = _cuts(pin(_found(docs, []).where("__tokens is not null")), alpha)
    found = _discoveries(_found(docs, names), cut)
    spans = "array_sort(concat(__base, __random))"
    # A block begins where the spans before it end; its text up to its last span is cut out once.
    step = ("struct(greatest(acc.at, x.end) as at, if(x.start < acc.at, acc.out, concat(acc.out, "
            f"substring(part, acc.at - before + 1, x.start - acc.at), '{mask}')) as out)")
    around = "transform(array(substring(text, before + 1, greatest(0, element_at(k, -1).start - before))), part -> FOLD)[0]"
    masked = _blocked("spans", "''", "x.end", step, "greatest", around)
    out = (f"transform(array({spans}), spans -> concat(array_join({masked}, ''), "
           "substring(text, array_max(transform(spans, x -> x.end)) + 1, length(text))))[0]")
    done = found.withColumn("text", F.when((F.size("__base") + F.size("__random")) > 0, F.expr(out)).otherwise(F.col("text")))
    if "n_chars" in names:
        done = done.withColumn("n_chars", F.when((F.size("__base") + F.size("__random")) > 0,
                                                 F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*names)
