"""T4: attempt-burst detector (the reference's login attempt counter), as a batch job.

Rule per key (e.g. client address), attempts in (ts, attempt_id) order:
a window opens at an attempt when none is open (or the open one has expired,
``expires <= ts``) and lasts ``window``; every attempt counts, attempts after
the ``limit``-th in a window are blocked; a successful attempt that is not
blocked closes the window, so the next attempt opens a new one.

This is a sequential fold per key, but one key may hold a third of all
attempts, so it is computed without gathering a key anywhere:

1. positions ``pos`` per key come from range-partitioned numbering;
2. for every attempt ``e`` the start of the window that would follow a window
   opened at ``e`` is ``next(e) = min(A(e), B(e) + 1)`` where ``A(e)`` is the
   first attempt at or after ``ts_e + window`` (found by numbering attempts
   together with one probe per attempt) and ``B(e)`` the first success among
   the ``limit`` attempts from ``e`` on that is still inside the window
   (found through per-class ranks, no per-key window function);
3. window starts are the chain 1, next(1), next(next(1)), ...; every attempt's
   window start is the largest chain position not after it, found by binary
   lifting over ``next`` (log2 levels of self-joins on (key, pos), each level
   pinned by a reliable checkpoint);
4. count = pos − start + 1; blocked = count > limit.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carrierbook.operators.numbering import number_rows
from carrierbook.session import reliable_checkpoint

INF = (1 << 62)


def _micros(df: DataFrame, name: str):
    """Microseconds of a timestamp column; wall-clock (NTZ) values are read as UTC so
    no session time zone (or its daylight-saving jumps) changes the distances."""
    col = F.col(name)
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return F.unix_micros(F.to_utc_timestamp(col.cast("timestamp"), df.sparkSession.conf.get("spark.sql.session.timeZone")))
    return F.unix_micros(col)


def burst_flags(attempts: DataFrame, *, window: _dt.timedelta, limit: int, key: str = "ip",
                ts: str = "ts", ok: str = "ok", id_col: str = "attempt_id") -> DataFrame:
    """(attempt_id, key, ts, ok, attempt_count, blocked) for every attempt."""
    w_us = int(window.total_seconds() * 1_000_000)
    ev = attempts.select(F.col(id_col).alias("_id"), F.col(key).alias("_k"), F.col(ts).alias("_ts"),
                         F.coalesce(F.col(ok), F.lit(False)).alias("_ok"), _micros(attempts, ts).alias("_t"))
    # 1. position per key
    ev = number_rows(ev, ["_t", "_id"], group=["_k"], out="pos")
    # 2a. rank inside the success / failure class → successes before each attempt
    ev = number_rows(ev, ["pos"], group=["_k", "_ok"], out="_crank")
    ev = ev.withColumn("_ok_before", F.when(F.col("_ok"), F.col("_crank") - 1).otherwise(F.col("pos") - F.col("_crank")))
    succ = ev.where(F.col("_ok")).select(F.col("_k").alias("_sk"), F.col("_crank").alias("_okrank"),
                                         F.col("pos").alias("_spos"), F.col("_t").alias("_st"))
    ev = ev.join(succ, (F.col("_k") == F.col("_sk")) & (F.col("_ok_before") + 1 == F.col("_okrank")), "left") \
        .drop("_sk", "_okrank")
    b = F.when((F.col("_spos") <= F.col("pos") + (limit - 1)) & (F.col("_st") < F.col("_t") + w_us), F.col("_spos"))
    ev = ev.withColumn("_b", b).drop("_spos", "_st", "_crank", "_ok_before")
    # 2b. first attempt at or after ts + window: number attempts together with one probe per attempt
    probes = ev.select("_k", (F.col("_t") + w_us).alias("_sort_t"), F.lit(0).alias("_kind"), "_id", "pos")
    items = ev.select("_k", F.col("_t").alias("_sort_t"), F.lit(1).alias("_kind"), "_id",
                      F.lit(None).cast("bigint").alias("pos"))
    ranked = number_rows(probes.unionByName(items), ["_sort_t", "_kind", "_id"], group=["_k"], out="_r")
    a = ranked.where(F.col("_kind") == 0).select("_k", "_id", (F.col("_r") - F.col("pos") + 1).alias("_a"))
    ev = ev.join(a, ["_k", "_id"], "inner")
    nxt = F.least(F.col("_a"), F.coalesce(F.col("_b") + 1, F.lit(INF)))
    ev = reliable_checkpoint(ev.withColumn("_next", nxt).drop("_a", "_b"))
    # 3. binary lifting over next()
    levels = [ev.select("_k", "pos", F.col("_next").alias("_j"))]
    n_per_key = ev.groupBy("_k").agg(F.max("pos").alias("_n"))
    for _ in range(64):   # 2^64 jumps exceed any key's attempt count
        cur = levels[-1]
        # stop when every key's root already jumps past its end at this level
        if cur.where((F.col("pos") == 1) & (F.col("_j") < INF)).join(
                n_per_key, "_k").where(F.col("_j") <= F.col("_n")).limit(1).count() == 0:
            break
        nxt_lvl = cur.alias("x").join(cur.alias("y"), (F.col("x._k") == F.col("y._k")) & (F.col("x._j") == F.col("y.pos")), "left") \
            .select(F.col("x._k").alias("_k"), F.col("x.pos").alias("pos"), F.coalesce(F.col("y._j"), F.lit(INF)).alias("_j"))
        levels.append(reliable_checkpoint(nxt_lvl))
    state = ev.select("_id", "_k", "_ts", "_ok", "pos", F.lit(1).cast("bigint").alias("_start"))
    for lvl in reversed(levels):
        j = lvl.select(F.col("_k").alias("_lk"), F.col("pos").alias("_lpos"), F.col("_j").alias("_jump"))
        state = state.join(j, (state["_k"] == j["_lk"]) & (state["_start"] == j["_lpos"]), "left")
        state = state.withColumn("_start", F.when(F.col("_jump") <= F.col("pos"), F.col("_jump")).otherwise(F.col("_start"))) \
            .drop("_lk", "_lpos", "_jump")
    cnt = (F.col("pos") - F.col("_start") + 1).cast("bigint")
    return state.select(F.col("_id").alias(id_col), F.col("_k").alias(key), F.col("_ts").alias(ts),
                        F.col("_ok").alias(ok), cnt.alias("attempt_count"), (cnt > limit).alias("blocked"))
