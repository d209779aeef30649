"""Burst detector (T4) against the reference's sequential counter, including a hot key."""

import datetime as dt
import random

from carrierbook.operators.burst import burst_flags
from carrierbook.sources import schema as S


def brute_force(rows, window, limit):
    state, out = {}, {}
    for aid, ip, ok, ts in sorted(rows, key=lambda r: (r[3], r[0])):
        cur = state.get(ip)
        if cur is None or cur["exp"] <= ts:
            cur = {"count": 1, "exp": ts + window}
            blocked = False
        else:
            cur["count"] += 1
            blocked = cur["count"] > limit
        state[ip] = cur
        out[aid] = (cur["count"], blocked)
        if not blocked and ok:
            state.pop(ip, None)
    return out


def test_burst_matches_sequential_counter(spark):
    rnd = random.Random(5)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        ip = "hot" if rnd.random() < 0.5 else f"10.0.0.{rnd.randint(1, 6)}"
        rows.append((i + 1, ip, rnd.random() < 0.08, t0 + dt.timedelta(seconds=rnd.randint(0, 6 * 3600))))
    rows.append((5000, "hot", False, rows[10][3]))  # equal timestamps are ordered by id
    df = spark.createDataFrame(rows, S.LOGIN_ATTEMPTS).repartition(5)
    window = dt.timedelta(minutes=15)
    got = {r["attempt_id"]: (r["attempt_count"], r["blocked"]) for r in burst_flags(df, window=window, limit=10).collect()}
    assert got == brute_force(rows, window, 10)


def test_burst_hot_key_at_larger_size(spark):
    rnd = random.Random(9)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i + 1, "hot" if rnd.random() < 0.34 else f"ip{rnd.randint(1, 40)}", rnd.random() < 0.05,
             t0 + dt.timedelta(seconds=rnd.randint(0, 48 * 3600))) for i in range(20000)]
    df = spark.createDataFrame(rows, S.LOGIN_ATTEMPTS).repartition(16)
    window = dt.timedelta(minutes=15)
    got = {r["attempt_id"]: (r["attempt_count"], r["blocked"]) for r in burst_flags(df, window=window, limit=10).collect()}
    assert got == brute_force(rows, window, 10)
