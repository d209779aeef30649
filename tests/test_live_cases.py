"""Live cases (T3, T2, S5, B1 in a stream) against the sequential fold: any arrival, retried batches, receipts, notices."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from carrierbook.operators import audience
from carrierbook.sources import schema as S
from carrierbook.streaming.allocator import NumberAllocator
from carrierbook.streaming.live_cases import LiveCases
from tests.test_lifecycle import ROLES, USERS
from tests.test_payload_replay import CASES, LOG, fold, make

DEPARTMENTS = [(2, "HIGH"), (3, "LOW")]
LOCATIONS = [(1, "Nord 7"), (2, "Süd"), (3, "West")]
READERS = [(i, r, loc) for i, r, loc in [(10, 2, 1), (11, 2, 2), (12, 3, 1), (13, 3, 3)]]


def _users(spark):
    more = [(i, f"reader{i}", "disponent", loc, None, True, dep) for i, dep, loc in READERS]
    return spark.createDataFrame(USERS + more, S.USERS)


def _live(spark, folder, cases, notices=None, **more):
    frame = spark.createDataFrame([tuple(c[f.name] for f in CASES.fields) for c in cases], CASES)
    return LiveCases(spark, str(folder), _users(spark), spark.createDataFrame(ROLES, S.ROLES),
                     spark.createDataFrame(LOCATIONS, "id int, name string"), spark.createDataFrame(DEPARTMENTS, "id int, name string"),
                     frame, notices=notices, buckets=5, **more)


def _batch(spark, log):
    return spark.createDataFrame([tuple(a[f.name] for f in LOG.fields) for a in log], LOG)


def _rows(live):
    return {r["id"]: {k: v for k, v in r.asDict().items() if k != "receipt_no"} for r in live.cases().collect()}


def _want(rows):
    return {i: {k: v for k, v in r.items() if k not in ("receipt_no", "applied_action", "updated_at")} for i, r in rows.items()}


def _want_notices(cases, log):
    """Per case the live titles, from the accepted actions in order."""
    reasons, rows = fold(cases, log)
    live = {}
    for a in sorted(log, key=lambda a: (a["ts"], a["action_id"])):
        if a["case_id"] in rows and reasons[a["action_id"]][1] is None:
            c = rows[a["case_id"]]
            if a["action"] == "submit" and c["department_id"]:
                live[c["id"]] = (c["department_id"], a["actor_id"])
            elif a["action"] in ("approve", "cancel"):
                live.pop(c["id"], None)
    return {(u, i, S.TITLE_DEPARTMENT) for i, (dep, by) in live.items() for u, d, _ in READERS if d == dep and u != by}


def test_shuffled_arrival_ends_in_the_fold(spark, tmp_path):
    cases, log = make(21, n_cases=12, n=240, hot=0.3)
    arrival = sorted(log, key=lambda a: (a["ts"], a["action_id"]))
    random.Random(4).shuffle(arrival)
    live = _live(spark, tmp_path, cases)
    for k in range(2):
        live(_batch(spark, arrival[k::2]), k)
    reasons, rows = fold(cases, log)
    assert _rows(live) == _want(rows)
    seen = {tuple(r) for r in audience.for_readers(live.notices(), audience.members(_users(spark))).select("user_id", "case_id", "title").collect()}
    assert seen == _want_notices(cases, log)
    booked = {i: c for i, c in rows.items() if c["approved_at"] is not None}
    lines = {}
    for r in live.lines().collect():
        lines.setdefault(r["case_id"], []).append(r)
    posted = {i for i, c in booked.items() if max((c["qty_in"] or 0) - (c["non_exchangeable_qty"] or 0), 0) > 0 or (c["qty_out"] or 0) > 0}
    assert set(lines) == posted
    ids = [r["id"] for one in lines.values() for r in one]
    assert len(ids) == len(set(ids))
    for i, one in lines.items():
        c = booked[i]
        assert {(r["type"], r["quantity"]) for r in one} == {(t, q) for t, q in (
            ("IN", max((c["qty_in"] or 0) - (c["non_exchangeable_qty"] or 0), 0)), ("OUT", c["qty_out"] or 0)) if q > 0}
        assert {r["created_at"] for r in one} == {c["approved_at"]} and len({r["receipt_no"] for r in one}) == 1
    numbers = [r["receipt_no"] for r in live.cases().where(F.col("approved_at").isNotNull()).collect()]
    assert len(set(numbers)) == len(numbers) == len(booked) and None not in numbers


def _steps(*steps):
    base = {f.name: None for f in LOG.fields}
    return [dict(base, action_id=k + 1, case_id=c, actor_id=1, action=a, ts=dt.datetime(2024, 3, 1, 8, k), **more)
            for k, (c, a, more) in enumerate(steps)]


def _case(i, **more):
    return dict({f.name: None for f in CASES.fields}, id=i, location_id=1, department_id=2, created_by=4, status=1, license_plate="HH1", qty_in=9,
                qty_out=2, non_exchangeable_qty=0, created_at=dt.datetime(2024, 1, 1), **more)


def test_a_killed_batch_gives_the_same_numbers_and_lines(spark, tmp_path):
    log = _steps(*[(i, a, {}) for i in (1, 2, 3) for a in ("claim", "submit", "approve")])
    live = _live(spark, tmp_path / "a", [_case(i) for i in (1, 2, 3)], receipt_start=40, line_start=100)
    live(_batch(spark, log[:3]), 0)
    once = sorted(map(tuple, live.lines().collect()))

    stop = live.store.commit
    live.store.commit = lambda *a: (_ for _ in ()).throw(RuntimeError("killed"))
    with pytest.raises(RuntimeError):
        live(_batch(spark, log[3:]), 1)
    live.store.commit = stop
    assert sorted(map(tuple, live.lines().collect())) == once and live.last_batch() == 0
    again = _live(spark, tmp_path / "a", [_case(i) for i in (1, 2, 3)], receipt_start=40, line_start=100)
    again(_batch(spark, log[3:]), 1)
    numbers = sorted(int(r["receipt_no"].rsplit("-", 1)[1]) for r in again.cases().collect())
    assert numbers == [40, 41, 42]
    first = sorted(map(tuple, again.lines().collect()))
    again(_batch(spark, log[3:]), 1)  # delivered again after its commit
    assert sorted(map(tuple, again.lines().collect())) == first
    assert sorted(r["id"] for r in again.lines().collect()) == [100, 101, 102, 103, 104, 105]


def test_the_allocator_refuses_another_count(spark, tmp_path):
    numbers = NumberAllocator(spark, str(tmp_path), start=7)
    assert [numbers.take("a", 0, 3), numbers.take("a", 1, 0), numbers.take("a", 2, 2), numbers.take("a", 0, 3), numbers.take("b", 2, 1)] == [7, 10, 10, 7, 7]
    with pytest.raises(ValueError):
        numbers.take("a", 2, 5)


def test_a_notice_made_in_one_batch_goes_in_the_next(spark, tmp_path):
    log = _steps((1, "claim", {}), (1, "submit", {}), (1, "approve", {}))
    given = spark.createDataFrame([(1, S.TITLE_LOCATION, "user", 10, None, "m", None)],
                                  "case_id int, title string, audience string, audience_id int, except_user int, message string, created_at timestamp_ntz")
    live = _live(spark, tmp_path, [_case(1), _case(2)], notices=given)
    members = audience.members(_users(spark))
    live(_batch(spark, log[:1]), 0)
    assert [r["title"] for r in audience.for_readers(live.notices(), members).collect()] == [S.TITLE_LOCATION]
    live(_batch(spark, log[1:2]), 1)
    assert {(r["user_id"], r["title"]) for r in audience.for_readers(live.notices(), members).collect()} == {(10, S.TITLE_DEPARTMENT), (11, S.TITLE_DEPARTMENT)}
    came = [(r["channel"], r["event"]) for r in live.events(1).collect() if r["user_id"] is not None]
    assert sorted(came) == [("user:10", "notificationCreated"), ("user:10", "notificationsDeleted"), ("user:11", "notificationCreated")]
    live(_batch(spark, log[2:]), 2)
    assert live.notices().count() == 0
    events = {(r["channel"], r["event"], r["receipt_no"] is not None) for r in live.events(2).collect()}
    assert events == {("loc:1", "casesUpdated", False), ("loc:1", "stockUpdated", False), ("loc:1", "bookingsUpdated", True),
                      ("user:10", "notificationsDeleted", False), ("user:11", "notificationsDeleted", False)}


def test_a_case_created_in_the_stream_is_announced_and_its_earlier_actions_count(spark, tmp_path):
    log = _steps((8, "create", dict(department_id=3, license_plate="HB77", qty_in=5, qty_out=1)), (8, "claim", {}), (8, "submit", {}))
    for a in log:
        a["location_id"] = 1 if a["action"] == "create" else None
    frame = lambda rows: spark.createDataFrame(
        [(*[a[f.name] for f in LOG.fields], a["location_id"]) for a in rows], S._s([*[(f.name, f.dataType) for f in LOG.fields], ("location_id", S.I)]))
    live = _live(spark, tmp_path, [_case(1)])
    live(frame(log[1:2]), 0)
    assert live.cases().count() == 1
    live(frame(log[:1]), 1)
    row = live.cases().where("id = 8").first()
    assert (row["status"], row["claimed_by"], row["created_by"], row["qty_in"]) == (2, 1, 1, 5)
    readers = audience.for_readers(live.notices(), audience.members(_users(spark)))
    assert {(r["user_id"], r["title"]) for r in readers.collect()} == {(2, S.TITLE_LOCATION), (10, S.TITLE_LOCATION), (12, S.TITLE_LOCATION)}
    live(frame(log[2:]), 2)
    readers = audience.for_readers(live.notices(), audience.members(_users(spark)))
    assert {(r["user_id"], r["title"]) for r in readers.collect()} == {(12, S.TITLE_DEPARTMENT), (13, S.TITLE_DEPARTMENT)}


def test_only_touched_buckets_are_written(spark, tmp_path):
    live = _live(spark, tmp_path, [_case(i) for i in range(1, 31)])
    live(_batch(spark, _steps((1, "claim", {}))), 0)
    assert len(list((tmp_path / "cases" / "v=0").glob("bucket=*"))) == 1 and live.cases().count() == 30


def test_counts_by_audience_equal_the_readers_rows(spark):
    rnd = random.Random(3)
    rows = [(i, S.TITLE_LOCATION, *rnd.choice([("location", rnd.randint(1, 3)), ("department", rnd.randint(2, 3)), ("user", rnd.randint(9, 13))]),
             rnd.choice([None, 2, 10, 11, 12]), "m") for i in range(60)]
    notices = spark.createDataFrame(rows, "case_id int, title string, audience string, audience_id int, except_user int, message string")
    members = audience.members(_users(spark))
    each = audience.for_readers(notices, members)
    marks = each.where("case_id % 3 = 0").select("user_id", "case_id", "title")
    want = {r["user_id"]: (r["n"], r["u"]) for r in each.groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("case_id") % 3 != 0).alias("u")).collect()}
    assert {r["user_id"]: (r["items"], r["unread"]) for r in audience.unread_counts(notices, members, marks).collect()} == want
    some = spark.createDataFrame([(10,)], "user_id int")
    assert audience.for_readers(notices, members, some).count() == want[10][0]
