"""Replay (B6) and batch apply (B5) against a brute-force sequential fold of the
reference rules, on a small fixture that includes one hot case spread over
many partitions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from carrierbook.operators import lifecycle
from carrierbook.sources import schema as S

ROLES = [(1, "Standard", '{"bookings":{"edit":false}}'),
         (2, "Lager", '{"cases":{"claim":true,"submit":true,"require_employee_code":true}}'),
         (3, "Leitung", '{"admin":{"full_access":true}}'),
         (4, "Editor", '{"cases":{"edit":true,"cancel":true,"approve":true}}')]
# id, username, role, location_id, role_id, is_active, fixed_department_id
USERS = [(1, "admin", "admin", None, None, True, None), (2, "lager", "disponent", 1, 2, True, None),
         (3, "chef", "disponent", 2, 3, True, None), (4, "plain", "disponent", None, None, True, None),
         (5, "editor", "disponent", None, 4, True, None)]
# Effective rights of the users above (written out independently of the library).
FULL = {"edit", "claim", "submit", "approve", "set_translogica", "cancel"}
RIGHTS = {1: FULL, 2: {"claim", "submit"}, 3: FULL, 4: set(), 5: {"edit", "cancel", "approve"}}
REQUIRE_CODE = {2}
LOCK = {2: 1, 3: 2}
ACTIONS = ["edit", "claim", "submit", "approve", "set_translogica", "cancel", "bogus"]


def brute_force(cases, actions):
    """Sequential fold per case in (ts, action_id) order, rules as in the reference."""
    state = {c["id"]: c["status"] for c in cases}
    info = {c["id"]: c for c in cases}
    out = {}
    for a in sorted(actions, key=lambda a: (a["ts"], a["action_id"])):
        cid, act, actor = a["case_id"], a["action"], a["actor_id"]
        if cid not in info:
            out[a["action_id"]] = (None, None, S.ERR_NOT_FOUND)
            continue
        s = state[cid]
        c = info[cid]
        reason, to = None, s
        if actor in LOCK and LOCK[actor] != c["location_id"]:
            reason = S.ERR_FORBIDDEN
        elif act not in FULL:
            reason = S.ERR_UNKNOWN_ACTION
        elif act not in RIGHTS.get(actor, set()):
            reason = S.ERR_NO_PERMISSION
        elif act == "edit":
            reason = None if s in (1, 2) else S.ERR_EDIT_STATUS
        elif act == "claim":
            reason, to = (None, 2) if s == 1 else (S.ERR_CLAIM_STATUS, s)
        elif act == "submit":
            if s != 2:
                reason = S.ERR_SUBMIT_STATUS
            elif actor in REQUIRE_CODE and not c["employee_code"]:
                reason = S.ERR_EMPLOYEE_CODE_REQUIRED
            else:
                to = 3
        elif act == "approve":
            reason, to = (None, 4) if s == 3 else (S.ERR_APPROVE_STATUS, s)
        elif act == "set_translogica":
            reason = S.ERR_TRANSLOGICA_STATUS if s != 4 else S.ERR_TRANSLOGICA_BOOL
        elif act == "cancel":
            reason = S.ERR_CANCEL_BOOKED if s == 4 else (S.ERR_CANCEL_CANCELLED if s == 0 else None)
            to = 0 if reason is None else s
        if reason is not None:
            to = s
        out[a["action_id"]] = (s, to, reason)
        state[cid] = to
    return out, state


def make_fixture(seed, n_cases=12, n_actions=600, hot_share=0.4):
    rnd = random.Random(seed)
    cases = [dict(id=i, location_id=rnd.choice([1, 2, 3]), status=rnd.choice([0, 1, 1, 1, 2, 3, 4]),
                  employee_code=rnd.choice([None, "A7"])) for i in range(1, n_cases + 1)]
    t0 = dt.datetime(2024, 1, 1)
    actions = []
    for k in range(n_actions):
        cid = 1 if rnd.random() < hot_share else rnd.randint(1, n_cases + 2)   # ids > n_cases do not exist
        actions.append(dict(action_id=k + 1, case_id=cid, actor_id=rnd.randint(1, 6),
                            action=rnd.choice(ACTIONS), ts=t0 + dt.timedelta(minutes=rnd.randint(0, 400))))
    return cases, actions


def _frames(spark, cases, actions):
    cdf = spark.createDataFrame(
        [(c["id"], c["location_id"], None, 4, c["status"], "HH1", None, None, 5, 2, 0, None, c["employee_code"],
          dt.datetime(2024, 1, 1), None, None, None, None) for c in cases], S.BOOKING_CASES)
    adf = spark.createDataFrame([(a["action_id"], a["case_id"], a["actor_id"], a["action"], a["ts"]) for a in actions],
                                S.CASE_ACTIONS)
    users = spark.createDataFrame(USERS, S.USERS)
    roles = spark.createDataFrame(ROLES, S.ROLES)
    return cdf, adf, users, roles


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay_equals_sequential_fold(spark, seed):
    cases, actions = make_fixture(seed)
    cdf, adf, users, roles = _frames(spark, cases, actions)
    adf = adf.repartition(7)  # the hot case's actions start out spread over many partitions
    got = {r["action_id"]: (r["start_status"], r["end_status"], r["reason"])
           for r in lifecycle.replay(adf, cdf, users, roles).collect()}
    want, final = brute_force(cases, actions)
    assert got == want
    fin = {r["case_id"]: r["status"] for r in lifecycle.final_state(lifecycle.replay(adf, cdf, users, roles), cdf).collect()}
    touched = {a["case_id"] for a in actions if a["case_id"] <= len(cases)}
    assert fin == {c: final[c] for c in touched}


def test_replay_in_two_batches_equals_one(spark):
    """Property: replaying the log in two consecutive parts (state carried) equals one replay."""
    from carrierbook.streaming.case_feed import advance_cases
    cases, actions = make_fixture(7)
    cdf, adf, users, roles = _frames(spark, cases, actions)
    cut = dt.datetime(2024, 1, 1, 3, 0)
    mid, _ = advance_cases(cdf, adf.where(F.col("ts") < cut), users, roles)
    end, _ = advance_cases(mid, adf.where(F.col("ts") >= cut), users, roles)
    once, _ = advance_cases(cdf, adf, users, roles)
    assert sorted(map(tuple, end.select("id", "status", "claimed_by", "submitted_by", "approved_by").collect())) == \
        sorted(map(tuple, once.select("id", "status", "claimed_by", "submitted_by", "approved_by").collect()))


def test_transition_table_all_actions_by_admin(spark):
    """Rule table: every action from every status by an unrestricted actor (one case per pair)."""
    cases, actions = [], []
    for s_ in range(5):
        for i, a in enumerate(ACTIONS):
            cid = 10 * (s_ + 1) + i
            cases.append(dict(id=cid, location_id=1, status=s_, employee_code="A7"))
            actions.append(dict(action_id=cid, case_id=cid, actor_id=1, action=a, ts=dt.datetime(2024, 1, 1)))
    cdf, adf, users, roles = _frames(spark, cases, actions)
    got = {r["action_id"]: (r["start_status"], r["end_status"], r["reason"])
           for r in lifecycle.replay(adf, cdf, users, roles).collect()}
    want, _ = brute_force(cases, actions)
    assert got == want


def test_batch_apply_sets_stamps(spark):
    cases = [dict(id=1, location_id=1, status=1, employee_code=None), dict(id=2, location_id=1, status=3, employee_code=None)]
    acts = [dict(action_id=1, case_id=1, actor_id=1, action="claim", ts=dt.datetime(2024, 1, 1)),
            dict(action_id=2, case_id=2, actor_id=3, action="approve", ts=dt.datetime(2024, 1, 1))]
    cdf, adf, users, roles = _frames(spark, cases, acts)
    new, rejects = lifecycle.apply_batch(adf, cdf, users, roles)
    rows = {r["id"]: r for r in new.collect()}
    assert rows[1]["status"] == 2 and rows[1]["claimed_by"] == 1
    assert rows[2]["status"] == 3  # user 3 is locked to location 2: Forbidden
    assert [r["reason"] for r in rejects.collect()] == [S.ERR_FORBIDDEN]


def _edit_expect(case, e, req_code):
    """The reference's edit route for one case and payload (NULL = field not sent)."""
    s = case["status"]
    if e["actor_id"] in LOCK and LOCK[e["actor_id"]] != case["location_id"]:
        return S.ERR_FORBIDDEN
    if "edit" not in RIGHTS.get(e["actor_id"], set()):
        return S.ERR_NO_PERMISSION
    if s not in (1, 2):
        return S.ERR_EDIT_STATUS
    if e["plate"] is not None:
        p = e["plate"].strip().upper()
        if not p:
            return S.ERR_PLATE_REQUIRED
        if "-" in p:
            return S.ERR_PLATE_DASH
        if any(ch.isspace() for ch in p):
            return S.ERR_PLATE_SPACE
        if len(p) < 3:
            return S.ERR_PLATE_SHORT
    if e["qin"] is not None and e["qin"] < 0:
        return S.ERR_QTY_IN
    if e["nonx"] is not None and e["nonx"] < 0:
        return S.ERR_NON_EXCH
    soll = max((e["qin"] if e["qin"] is not None else 5) - 2, 0)
    if s != 2 and e["nonx"] is not None:
        return S.ERR_NON_EXCH_STATUS
    if s == 2 and e["nonx"] is not None and e["nonx"] > soll:
        return S.ERR_NON_EXCH_SOLL
    if e["code"] is not None:
        if s != 2:
            return S.ERR_EMPLOYEE_CODE_STATUS
        c = e["code"].strip().upper()
        if c and not (len(c) == 2 and c.isalnum()):
            return S.ERR_EMPLOYEE_CODE
        if req_code and not c:
            return S.ERR_EMPLOYEE_CODE_REQUIRED
    return None


def test_edit_rule_table(spark):
    combos = []
    payloads = [dict(plate=None, qin=None, nonx=None, code=None), dict(plate="hh-1", qin=None, nonx=None, code=None),
                dict(plate="ab", qin=None, nonx=None, code=None), dict(plate=" hb12 ", qin=-1, nonx=None, code=None),
                dict(plate=None, qin=4, nonx=3, code=None), dict(plate=None, qin=9, nonx=3, code=None),
                dict(plate=None, qin=None, nonx=None, code="x"), dict(plate=None, qin=None, nonx=None, code=" a7 "),
                dict(plate=None, qin=None, nonx=-2, code=None)]
    cases, edits = [], []
    cid = 0
    for status in (1, 2, 3):
        for actor in (1, 2, 4, 5):
            for p in payloads:
                cid += 1
                cases.append(dict(id=cid, location_id=1 if cid % 2 else 2, status=status, employee_code=None))
                edits.append(dict(action_id=cid, case_id=cid, actor_id=actor, **p))
    cdf = spark.createDataFrame(
        [(c["id"], c["location_id"], None, 4, c["status"], "HH1", None, None, 5, 2, 0, None, None,
          dt.datetime(2024, 1, 1), None, None, None, None) for c in cases], S.BOOKING_CASES)
    edf = spark.createDataFrame(
        [(e["action_id"], e["case_id"], e["actor_id"], dt.datetime(2024, 1, 2), None, e["plate"], None, None,
          e["qin"], None, e["nonx"], e["code"], None) for e in edits], S.CASE_EDITS)
    users = spark.createDataFrame(USERS, S.USERS)
    roles = spark.createDataFrame(ROLES, S.ROLES)
    new, rejects = lifecycle.apply_edits(edf, cdf, users, roles)
    got = {r["action_id"]: r["reason"] for r in rejects.collect()}
    want = {e["action_id"]: _edit_expect(c, e, e["actor_id"] in REQUIRE_CODE) for c, e in zip(cases, edits)}
    assert got == {k: v for k, v in want.items() if v is not None}
    rows = {r["id"]: r for r in new.collect()}
    for c, e in zip(cases, edits):
        if want[e["action_id"]] is None and e["code"] is not None:
            assert rows[c["id"]]["employee_code"] == e["code"].strip().upper()
        if want[e["action_id"]] is None and e["plate"] is not None:
            assert rows[c["id"]]["license_plate"] == e["plate"].strip().upper()


def test_submit_payload_rule_table(spark):
    """B5 submit with payloads (non_exchangeable_qty against stored quantities, employee code)."""
    payloads = [(None, None), (-1, None), (3, None), (4, None), (None, "b7"), (None, "toolong"), (None, "  "), (2, " c9 ")]
    cases, acts = [], []
    cid = 0
    for status in (1, 2):
        for stored_code in (None, "A7"):
            for actor in (1, 2, 3):
                for nonx, code in payloads:
                    cid += 1
                    cases.append(dict(id=cid, location_id=1, status=status, employee_code=stored_code))
                    acts.append(dict(action_id=cid, case_id=cid, actor_id=actor, nonx=nonx, code=code))
    cdf = spark.createDataFrame(
        [(c["id"], c["location_id"], None, 4, c["status"], "HH1", None, None, 5, 2, 0, None, c["employee_code"],
          dt.datetime(2024, 1, 1), None, None, None, None) for c in cases], S.BOOKING_CASES)
    adf = spark.createDataFrame([(a["action_id"], a["case_id"], a["actor_id"], "submit", dt.datetime(2024, 1, 2),
                                  a["nonx"], a["code"]) for a in acts],
                                "action_id int, case_id int, actor_id int, action string, ts timestamp_ntz, "
                                "non_exchangeable_qty int, employee_code string")
    users = spark.createDataFrame(USERS, S.USERS)
    roles = spark.createDataFrame(ROLES, S.ROLES)
    new, rejects = lifecycle.apply_batch(adf, cdf, users, roles)
    got = {r["action_id"]: r["reason"] for r in rejects.collect()}
    rows = {r["id"]: r for r in new.collect()}
    for c, a in zip(cases, acts):
        actor = a["actor_id"]
        want, code = None, c["employee_code"]
        if actor in LOCK and LOCK[actor] != c["location_id"]:
            want = S.ERR_FORBIDDEN
        elif "submit" not in RIGHTS[actor]:
            want = S.ERR_NO_PERMISSION
        elif c["status"] != 2:
            want = S.ERR_SUBMIT_STATUS
        elif a["nonx"] is not None and a["nonx"] < 0:
            want = S.ERR_NON_EXCH
        elif a["nonx"] is not None and a["nonx"] > 3:       # stored 5 in − 2 out
            want = S.ERR_NON_EXCH_SOLL
        else:
            if a["code"] is not None:
                v = a["code"].strip().upper() or None
                if v is not None and not (len(v) == 2 and v.isalnum()):
                    want = S.ERR_EMPLOYEE_CODE
                code = v
            if want is None and actor in REQUIRE_CODE and not code:
                want = S.ERR_EMPLOYEE_CODE_REQUIRED
        assert got.get(a["action_id"]) == want, (c, a)
        r = rows[c["id"]]
        if want is None:
            assert (r["status"], r["submitted_by"], r["employee_code"]) == (3, actor, code)
            assert r["non_exchangeable_qty"] == (a["nonx"] if a["nonx"] is not None else 0)
        else:
            assert r["status"] == c["status"] and r["employee_code"] == c["employee_code"]


def test_replay_hot_case_at_larger_size(spark):
    """One case holds a third of 20,000 actions spread over 16 partitions: still exact."""
    cases, actions = make_fixture(11, n_cases=40, n_actions=20000, hot_share=0.34)
    cdf, adf, users, roles = _frames(spark, cases, actions)
    got = {r["action_id"]: (r["start_status"], r["end_status"], r["reason"])
           for r in lifecycle.replay(adf.repartition(16), cdf, users, roles).collect()}
    want, _ = brute_force(cases, actions)
    assert got == want
