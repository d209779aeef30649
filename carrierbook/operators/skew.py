"""Equi-joins of a long table with a keyed table where a few keys hold many of the long table's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

# A key is heavy when it holds more than 1 / HEAVY_SHARE of the rows, so there are fewer than HEAVY_SHARE heavy keys.
HEAVY_SHARE = 200
SALTS = 64
# A table whose values are counted to hold no more than this is broadcast, whatever its plan is estimated to give.
SMALL_BYTES = 1 << 20


def heavy_keys(rows: DataFrame, keys: list[str], share: int = HEAVY_SHARE) -> dict[str, list]:
    """The heavy values of each column of ``keys`` (of one type), NULL among them; one pass over ``rows``."""
    seen = Observation()
    pairs = rows.select(*keys).observe(seen, F.count(F.lit(1)).alias("n")).select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in keys])).alias("x")).select("x.k", "x.v")
    counted = pairs.groupBy("k", "v").agg(F.count(F.lit(1)).alias("_n"))
    # Fewer than ``share`` values of a column can pass, so the largest decide whatever the table's size.
    largest = counted.orderBy(F.col("_n").desc()).limit(share * len(keys)).collect()
    return {k: [r["v"] for r in largest if r["k"] == k and r["_n"] * share > seen.get["n"]] for k in keys}


def join_salted(long: DataFrame, keyed: DataFrame, key: str, heavy: list, deal: list[str], how: str = "left",
                salts: int = SALTS) -> DataFrame:
    """``long.join(keyed, key, how)`` with the rows of the ``heavy`` keys dealt to ``salts`` parts by the hash of their columns
    ``deal`` (so a retried task deals them alike) and the keyed rows of those keys repeated for each.

    Rows without a key meet nothing; where they are many and stay, as in a left join, they are dealt as well.
    """
    if not heavy:
        return long.join(keyed, key, how)
    named = [v for v in heavy if v is not None]
    hot = F.col(key).isin(named) if named else F.lit(False)
    away = hot | F.col(key).isNull() if None in heavy else hot
    dealt = long.withColumn("_salt", F.when(away, F.pmod(F.xxhash64(*deal), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    spread = keyed.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(spread, [key, "_salt"], how).drop("_salt")


def join_heavy(long: DataFrame, keyed: DataFrame, key: str, deal: list[str], how: str = "left",
               share: int = HEAVY_SHARE, salts: int = SALTS, seen_in: DataFrame | None = None) -> DataFrame:
    """:func:`join_salted` with the heavy keys counted first: ``long`` is read twice, the first time for its key alone.

    ``seen_in``: the table to count the keys in, where ``long`` was already joined to others.
    """
    heavy = heavy_keys(long if seen_in is None else seen_in, [key], share)[key]
    return join_salted(long, keyed, key, heavy, deal, how, salts)


def is_small(table: DataFrame, most: int = SMALL_BYTES) -> bool:
    """Whether a table's values, counted, hold at most ``most`` bytes (8 more for each)."""
    bytes_ = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + F.lit(8) for c in table.columns), F.lit(0))
    return (table.agg(F.sum(bytes_)).first()[0] or 0) <= most


def join_dimension(long: DataFrame, keyed: DataFrame, key: str, deal: list[str], how: str = "left",
                   seen_in: DataFrame | None = None) -> DataFrame:
    """``long.join(keyed, key, how)``: a small ``keyed`` is broadcast, else heavy keys are salted.

    A plan's estimate of a derived dimension (the distinct values of a large table) is that of the large table: the long rows were
    shuffled by a key of a few values, each value's rows to one task.
    """
    if is_small(keyed):
        return long.join(F.broadcast(keyed), key, how)
    return join_heavy(long, keyed, key, deal, how, seen_in=seen_in)


def meet_spread(rows: DataFrame, members: DataFrame, keys: list[str], deal: list[str], parts: int = SALTS) -> DataFrame:
    """``rows.join(members, keys)`` where a few keys hold everything: every row of a key meets every member of it.

    The output is rows times members per key whatever the join; a key's rows are dealt to ``parts`` parts by the hash of their columns
    ``deal``, with the key's members in each.  The number of partitions is given: sized by their bytes, the few
    rows would be merged into a few tasks that write most of the output.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*deal), F.lit(parts)).cast("int"))
    each = members.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.repartition(n, *keys, "_part").join(each.repartition(n, *keys, "_part").hint("shuffle_hash"), [*keys, "_part"]).drop("_part")
