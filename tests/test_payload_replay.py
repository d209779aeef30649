"""Replay with payloads (B6) against a sequential fold of the reference's rules, with a case over many partitions."""

import datetime as dt
import random
import re

import pytest

from carrierbook.operators import lifecycle, payload_replay
from carrierbook.sources import schema as S
from tests.test_lifecycle import FULL, LOCK, REQUIRE_CODE, RIGHTS, ROLES, USERS

CASES = S._s([*[(f.name, f.dataType) for f in S.BOOKING_CASES.fields], ("translogica_transferred", S.B), ("claimed_at", S.TS),
              ("submitted_at", S.TS), ("approved_at", S.TS)])
LOG = S._s([("action_id", S.I), ("case_id", S.I), ("actor_id", S.I), ("action", S.S), ("ts", S.TS), ("department_id", S.I),
            ("license_plate", S.S), ("entrepreneur", S.S), ("note", S.S), ("qty_in", S.I), ("qty_out", S.I),
            ("non_exchangeable_qty", S.I), ("employee_code", S.S), ("product_type", S.S), ("translogica_transferred", S.B)])


def _plate(p):
    p = p.strip().upper()
    if not p:
        return S.ERR_PLATE_REQUIRED
    if "-" in p:
        return S.ERR_PLATE_DASH
    if re.search(r"\s", p):
        return S.ERR_PLATE_SPACE
    return None if len(p) >= 3 else S.ERR_PLATE_SHORT


def _judge(c, a):
    """(reason, changes) of one action on a case row, as the reference decides it."""
    act, actor, st = a["action"], a["actor_id"], c["status"]
    code_sent, nonx = a["employee_code"] is not None, a["non_exchangeable_qty"]
    code = (a["employee_code"] or "").strip().upper() or None
    code_bad = S.ERR_EMPLOYEE_CODE if code and not re.fullmatch("[A-Z0-9]{2}", code) else None
    if actor in LOCK and LOCK[actor] != c["location_id"]:
        return S.ERR_FORBIDDEN, {}
    if act not in FULL:
        return S.ERR_UNKNOWN_ACTION, {}
    if act not in RIGHTS.get(actor, set()):
        return S.ERR_NO_PERMISSION, {}
    stamp = {"applied_action": act, "updated_at": a["ts"]}
    if act == "edit":
        if st not in (1, 2):
            return S.ERR_EDIT_STATUS, {}
        if a["license_plate"] is not None and _plate(a["license_plate"]):
            return _plate(a["license_plate"]), {}
        for name, error in (("qty_in", S.ERR_QTY_IN), ("qty_out", S.ERR_QTY_OUT), ("non_exchangeable_qty", S.ERR_NON_EXCH)):
            if a[name] is not None and a[name] < 0:
                return error, {}
        n_in = a["qty_in"] if a["qty_in"] is not None else c["qty_in"] or 0
        n_out = a["qty_out"] if a["qty_out"] is not None else c["qty_out"] or 0
        if st != 2 and nonx is not None:
            return S.ERR_NON_EXCH_STATUS, {}
        if st == 2 and nonx is not None and nonx > max(n_in - n_out, 0):
            return S.ERR_NON_EXCH_SOLL, {}
        product = None if a["product_type"] is None else (a["product_type"] or "euro").strip().lower()
        if product is not None and product not in S.PRODUCT_TYPES:
            return S.ERR_PRODUCT, {}
        if code_sent and st != 2:
            return S.ERR_EMPLOYEE_CODE_STATUS, {}
        if code_bad:
            return code_bad, {}
        if code_sent and actor in REQUIRE_CODE and not code:
            return S.ERR_EMPLOYEE_CODE_REQUIRED, {}
        new = {k: a[k] for k in ("qty_in", "qty_out", "non_exchangeable_qty") if a[k] is not None}
        new |= {k: a[k].strip() for k in ("entrepreneur", "note") if (a[k] or "").strip()}
        if a["department_id"]:
            new["department_id"] = a["department_id"]
        if a["license_plate"] is not None:
            new["license_plate"] = a["license_plate"].strip().upper()
        if product is not None:
            new["product_type"] = product
        if code_sent:
            new["employee_code"] = code
        return None, new | stamp
    if act == "claim":
        return (None, {"status": 2, "claimed_by": actor, "claimed_at": a["ts"]} | stamp) if st == 1 else (S.ERR_CLAIM_STATUS, {})
    if act == "submit":
        if st != 2:
            return S.ERR_SUBMIT_STATUS, {}
        if nonx is not None and nonx < 0:
            return S.ERR_NON_EXCH, {}
        if nonx is not None and nonx > max((c["qty_in"] or 0) - (c["qty_out"] or 0), 0):
            return S.ERR_NON_EXCH_SOLL, {}
        if code_bad:
            return code_bad, {}
        after = code if code_sent else c["employee_code"]
        if actor in REQUIRE_CODE and not after:
            return S.ERR_EMPLOYEE_CODE_REQUIRED, {}
        new = {"status": 3, "submitted_by": actor, "submitted_at": a["ts"], "employee_code": after}
        if nonx is not None:
            new["non_exchangeable_qty"] = nonx
        return None, new | stamp
    if act == "approve":
        return (None, {"status": 4, "approved_by": actor, "approved_at": a["ts"]} | stamp) if st == 3 else (S.ERR_APPROVE_STATUS, {})
    if act == "set_translogica":
        if st != 4:
            return S.ERR_TRANSLOGICA_STATUS, {}
        if a["translogica_transferred"] is None:
            return S.ERR_TRANSLOGICA_BOOL, {}
        return None, {"translogica_transferred": a["translogica_transferred"]} | stamp
    if st == 4:
        return S.ERR_CANCEL_BOOKED, {}
    return (S.ERR_CANCEL_CANCELLED, {}) if st == 0 else (None, {"status": 0} | stamp)


def fold(cases, log):
    """The sequential answer: reason per action and the case rows."""
    rows = {c["id"]: dict(c, applied_action=None, updated_at=None) for c in cases}
    reasons = {}
    for a in sorted(log, key=lambda a: (a["ts"], a["action_id"])):
        if a["case_id"] not in rows:
            reasons[a["action_id"]] = (None, S.ERR_NOT_FOUND)
            continue
        c = rows[a["case_id"]]
        reason, new = _judge(c, a)
        reasons[a["action_id"]] = (c["status"], reason)
        c.update(new)
    return reasons, rows


def make(seed, n_cases=40, n=900, hot=0.4, hot_actions=None):
    rnd = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    cases = [dict({f.name: None for f in CASES.fields}, id=i, location_id=rnd.choice([1, 2, 3]), created_by=4,
                  status=1 if i == 3 else rnd.choice([0, 1, 1, 2, 2, 3, 4]), license_plate="HH1", qty_in=rnd.choice([None, 0, 5, 9]),
                  qty_out=rnd.choice([None, 0, 2, 7]), non_exchangeable_qty=0, employee_code=rnd.choice([None, "A7"]), created_at=t0,
                  translogica_transferred=False) for i in range(1, n_cases + 1)]
    log = []
    for k in range(n):
        in_hot = rnd.random() < hot
        few = hot_actions or ["edit"] * 12 + ["claim", "submit", "submit", "approve", "set_translogica", "bogus"]
        act = rnd.choice(few if in_hot else ["edit", "edit", "claim", "submit", "approve", "set_translogica", "cancel", "bogus"])
        pick = lambda *v: rnd.choice(v)
        log.append(dict(
            action_id=k + 1, case_id=3 if in_hot else rnd.randint(1, n_cases + 3), actor_id=pick(1, 1, 1, 2, 3, 4, 5, 6), action=act,
            ts=t0 + dt.timedelta(minutes=rnd.randint(0, 300)), department_id=pick(None, 0, 2), license_plate=pick(None, None, None, " hb 1", "hb12 ", "a"),
            entrepreneur=pick(None, " ", " X "), note=pick(None, "n"), qty_in=pick(None, None, 3, 12, 20, -1) if rnd.random() < 0.5 else None,
            qty_out=pick(None, None, 1, 4, 9, -1) if rnd.random() < 0.5 else None, non_exchangeable_qty=pick(None, None, 0, 1, 3, 6, 11, -1),
            employee_code=pick(None, None, None, "", "b2", "xxx"), product_type=pick(None, None, "H1 ", "wood", ""),
            translogica_transferred=pick(None, True, False)))
    return cases, log


@pytest.fixture
def many_partitions(spark):
    """Range shuffles keep all their partitions, so that cases lie over partition edges."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _frames(spark, cases, log):
    return (spark.createDataFrame([tuple(a[f.name] for f in LOG.fields) for a in log], LOG),
            spark.createDataFrame([tuple(c[f.name] for f in CASES.fields) for c in cases], CASES),
            spark.createDataFrame(USERS, S.USERS), spark.createDataFrame(ROLES, S.ROLES))


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_log_with_payloads_equals_a_sequential_fold(spark, many_partitions, seed):
    cases, log = make(seed)
    frames = _frames(spark, cases, log)
    reasons, rows = fold(cases, log)
    out = payload_replay.replay(*frames).cache()
    assert {r["action_id"]: (r["start_status"], r["reason"]) for r in out.collect()} == reasons
    got = {r["id"]: r.asDict() for r in payload_replay.case_rows(out, frames[1]).collect()}
    assert got == rows and len(got) == len(cases)


def test_all_actions_on_one_case_and_a_case_that_stays_claimed(spark, many_partitions):
    cases, log = make(9, n_cases=3, n=600, hot=1.0, hot_actions=["edit"] * 9 + ["claim"])
    frames = _frames(spark, cases, log)
    reasons, rows = fold(cases, log)
    assert rows[3]["status"] == 2
    out = payload_replay.replay(*frames)
    assert {r["action_id"]: (r["start_status"], r["reason"]) for r in out.collect()} == reasons


def test_empty_log_and_empty_cases(spark):
    cases, log = make(5, n=30)
    actions, table, users, roles = _frames(spark, cases, log)
    assert payload_replay.replay(actions.limit(0), table, users, roles).count() == 0
    new, rejects = payload_replay.apply_log(actions, table.limit(0), users, roles)
    assert new.count() == 0 and {r["reason"] for r in rejects.collect()} == {S.ERR_NOT_FOUND}


def test_maps_equal_the_fold_of_their_moves(monkeypatch):
    rnd = random.Random(11)
    cut = 0
    for k in range(400):
        monkeypatch.setattr(payload_replay, "MOST_BRANCHES", 64 if k % 2 else 9)
        moves = [(rnd.choice([0, 1, 2, 3, 4, 5, 6, 6, 6, 6, 2]), rnd.choice([None, None, 0, 3, 8]), rnd.choice([None, None, 0, 2, 6]),
                  rnd.choice([0, 0, 1, 2, 5, 9]), rnd.choice([0, 0, 1, 2]), rnd.random() < 0.4) for _ in range(rnd.randint(0, 40))]
        maps = payload_replay.maps_of(moves)
        cut += len(maps) > 1
        for _ in range(60):
            state = want = (rnd.randint(0, 4), rnd.randint(0, 12), rnd.randint(0, 12), rnd.random() < 0.5)
            for move in moves:
                want = payload_replay.step(want, move)
            got = state
            for one in maps:
                got = payload_replay.apply_map(one, got)
            assert got == want
    assert cut > 0


def test_rights_are_those_of_the_batch_operators(spark):
    users, roles = spark.createDataFrame(USERS, S.USERS), spark.createDataFrame(ROLES, S.ROLES)
    rights = {r["actor_id"]: r for r in lifecycle.actor_rights(users, roles).collect()}
    assert all(rights[u]["_p_cases_edit"] == ("edit" in RIGHTS[u]) for u in RIGHTS)
